"""Leakage-safe folds over geographic blocks, and exact checks of what they separate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtally.functions import dims, geometry
from groundtally.operators.scoring import ratio
from groundtally.session import cut_lineage

STRATEGIES = ("country", "grid_1deg", "s2_tile")


def block_key(strategy: str) -> Column:
    if strategy == "country":
        return F.col("country")
    if strategy == "s2_tile":
        return F.col("tile")
    if strategy != "grid_1deg":
        raise ValueError(f"unknown blocking strategy {strategy}")
    cell = F.concat_ws("_", F.floor("lat").cast("string"), F.floor("lon").cast("string"))
    refuse = F.raise_error(F.lit("grid_1deg needs a coordinate for every patch")).cast("string")
    return F.when(F.col("lat").isNull() | F.col("lon").isNull(), refuse).otherwise(cell)


def with_blocks(patches: DataFrame, strategy: str) -> DataFrame:
    return patches.withColumn("block", block_key(strategy))


def _in_turn(blocks: DataFrame, schema: str, k: int, place: Callable[[dict], int]) -> DataFrame:
    """(block, fold): ``place`` sees one block after another, in the order of ``blocks``.

    The pass is sequential by definition. It streams through the sorted block table in one task and keeps
    nothing but what ``place`` does, so neither memory nor a plan row grows with the number of blocks.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for batch in batches:
            folds = [place(row) for row in batch.to_dict("records")]
            seen += len(folds)
            yield pd.DataFrame({"block": batch["block"], "fold": folds})
        if 0 < seen < k:
            raise ValueError("fewer blocks than folds")

    return blocks.mapInPandas(run, schema)


def _least_loaded(k: int) -> Callable[[dict], int]:
    load = [0] * k

    def place(row: dict) -> int:
        at = load.index(min(load))
        load[at] += row["n"]
        return at

    return place


def _most_gain(k: int, size_weight: float) -> Callable[[dict], int]:
    load, covered = [0] * k, [set() for _ in range(k)]

    def place(row: dict) -> int:
        scores = []
        for f in range(k):
            gain = 0.0
            for cls, w in zip(row["classes"], row["weights"]):  # in class order, so that ties fall the same way everywhere
                gain += 0.0 if cls in covered[f] else w
            scores.append(gain - size_weight * max((load[f] + row["n"] - row["mean"]) / row["mean"], 0.0))
        at = scores.index(max(scores))
        load[at] += row["n"]
        covered[at].update(row["classes"])
        return at

    return place


def pack_folds(sizes: DataFrame, k: int = 5) -> DataFrame:
    """(block, n) -> (block, fold): largest block first into the least-loaded fold, ties to the lowest fold."""
    if k < 2:
        raise ValueError("k must be at least 2")
    ordered = sizes.select("block", "n").repartition(1).sortWithinPartitions(F.desc("n"), "block")
    return _in_turn(ordered, "block string, fold int", k, _least_loaded(k))


def pack_folds_stratified(sizes: DataFrame, contents: DataFrame, k: int = 5, size_weight: float = 0.15) -> DataFrame:
    """(block, n), (block, cls) -> (block, fold): rarest contents first, to the fold that gains most new classes.

    A class weighs one over the number of blocks that hold it; imbalance above the mean costs ``size_weight``.
    A block's row holds its classes, of which a nomenclature has a few dozen.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    c = contents.select("block", "cls").distinct()
    weight = c.groupBy("cls").agg((1.0 / F.count("*")).alias("w"))
    packed = c.join(weight, "cls").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("cls", "w"))).alias("has"))
    total = F.aggregate("has", F.lit(0.0), lambda acc, x: acc + x["w"])
    mean = sizes.agg((F.sum("n") / k).alias("mean"))
    rows = (sizes.join(packed, "block", "left").withColumn("has", F.coalesce("has", F.expr("cast(array() as array<struct<cls:int,w:double>>)")))
            .withColumn("rare", total).join(F.broadcast(mean)))  # one row
    ordered = (rows.select("block", "n", "mean", "rare", F.transform("has", lambda x: x["cls"]).alias("classes"), F.transform("has", lambda x: x["w"]).alias("weights"))
               .repartition(1).sortWithinPartitions(F.desc("rare"), F.desc("n"), "block"))
    return _in_turn(ordered, "block string, fold int", k, _most_gain(k, size_weight))


def assign_folds(patches: DataFrame, strategy: str, k: int = 5, contents: DataFrame | None = None) -> DataFrame:
    """Patches with block and fold; whole blocks stay together."""
    d = with_blocks(patches, strategy)
    sizes = d.groupBy("block").agg(F.count("*").alias("n"))
    folds = pack_folds(sizes, k) if contents is None else pack_folds_stratified(sizes, contents, k)
    return d.join(folds, "block")


def random_folds(patches: DataFrame, k: int = 5, seed: int = 1337) -> DataFrame:
    key = F.concat_ws(":", F.lit(str(seed)), F.col("patch_id"))
    return patches.withColumn("fold", (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % k).cast("int"))


def folds_per_block(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("block").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("n_folds")).withColumn("spans", F.col("n_folds") > 1)


def _neighbour_join(pos: DataFrame, cols: list[str]) -> DataFrame:
    """Each touching pair of positions of a tile once, by four forward steps and an equi-join."""
    steps = F.expr("array(named_struct('dr', 0, 'dc', 1), named_struct('dr', 1, 'dc', -1), named_struct('dr', 1, 'dc', 0), named_struct('dr', 1, 'dc', 1))")
    a = pos.select("tile", F.explode(steps).alias("s"), "row", "col", *[F.col(c).alias(c + "_1") for c in cols]).select(
        "tile", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), *[c + "_1" for c in cols])
    b = pos.select("tile", "row", "col", *[F.col(c).alias(c + "_2") for c in cols])
    return a.join(b, ["tile", "row", "col"])


def severed_pairs(assigned: DataFrame) -> DataFrame:
    """Touching patches in different folds; a repeated position is stood for by its largest patch id."""
    pos = assigned.groupBy("tile", "row", "col").agg(F.max(F.struct("patch_id", "fold")).alias("p")).select("tile", "row", "col", "p.*")
    j = _neighbour_join(pos, ["patch_id", "fold"]).filter("fold_1 <> fold_2")
    first = F.col("patch_id_1") < F.col("patch_id_2")
    return j.select(F.least("patch_id_1", "patch_id_2").alias("patch_a"), F.greatest("patch_id_1", "patch_id_2").alias("patch_b"),
                    F.when(first, F.col("fold_1")).otherwise(F.col("fold_2")).alias("fold_a"), F.when(first, F.col("fold_2")).otherwise(F.col("fold_1")).alias("fold_b"))


def touching_pairs(patches: DataFrame) -> DataFrame:
    """Number of touching positions per tile."""
    pos = patches.select("tile", "row", "col").distinct()
    return _neighbour_join(pos, []).groupBy("tile").agg(F.count("*").alias("n_pairs"))


def same_block_rate(assigned: DataFrame) -> DataFrame:
    """Exact share of cross-fold ordered pairs that lie in one block, from counts alone."""
    def sq(c):
        return F.col(c).cast("decimal(19,0)") * F.col(c).cast("decimal(19,0)")
    bf = assigned.groupBy("block", "fold").agg(F.count("*").alias("n"))
    b = bf.groupBy("block").agg(F.sum("n").alias("nb"), F.sum(sq("n")).alias("s")).agg(F.sum(sq("nb") - F.col("s")).cast("double").alias("same"), F.sum("nb").alias("n"))
    f = bf.groupBy("fold").agg(F.sum("n").alias("nf")).agg(F.sum(sq("nf")).alias("sf"))
    return b.join(F.broadcast(f)).select("same", (sq("n") - F.col("sf")).cast("double").alias("cross")).withColumn("rate", ratio(F.col("same"), F.col("cross")))


LEVELS = 26            # cube sides from the whole globe (4 Earth radii) down to about 0.8 m
MAX_POINT_PAIRS = 20_000_000


def _cube(side: float) -> list[Column]:
    return [F.floor((F.col(c) + 1.0) / side).alias("c" + c) for c in ("x", "y", "z")]


def _bounds(side: float) -> tuple[Column, Column]:
    """Squared chord bounds between two cubes: nearest and farthest corners."""
    gap = [F.abs(F.col(f"c{c}1") - F.col(f"c{c}2")) for c in ("x", "y", "z")]
    near = sum((F.pow(F.greatest(g - 1, F.lit(0)) * side, 2) for g in gap), F.lit(0.0))
    far = sum((F.pow((g + 1) * side, 2) for g in gap), F.lit(0.0))
    return near, far


def min_fold_distance(assigned: DataFrame) -> DataFrame:
    """Exact smallest great-circle distance between patches of different folds, in kilometres.

    Points sit on the unit sphere, where chord and arc order pairs alike and no pole or date line
    needs care. One pass over nested cubes finds the finest that still holds two folds, which bounds
    the chord. Neighbouring cubes of that size are the candidates; while they would compare too many
    points, cubes are split in four and every pair whose nearest corners are farther apart than the
    best farthest corners is dropped. Only then do points meet.
    """
    lat, lon = F.radians("lat"), F.radians("lon")
    pts = cut_lineage(assigned.filter("lat is not null and lon is not null").select("lat", "lon", "fold").distinct().select(
        "lat", "lon", "fold", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z")))
    at = F.pow(F.lit(2.0), F.lit(2) - F.col("level"))
    cells = pts.select(F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"), "x", "y", "z", "fold").groupBy(
        "level", *[F.floor((F.col(c) + 1.0) / at).alias("c" + c) for c in ("x", "y", "z")]).agg(F.min("fold").alias("a"), F.max("fold").alias("b"))
    finest = cells.filter("a <> b").agg(F.max("level")).first()[0]
    if finest is None:  # one fold only
        return pts.limit(0).agg(F.min("lat").alias("min_km"))
    side = 2.0 ** (2 - finest) * 3.0 ** 0.5

    def counted(s, n):
        return pts.groupBy(*[c.alias(f"{name}{n}") for c, name in zip(_cube(s), ("cx", "cy", "cz"))], F.col("fold").alias(f"f{n}")).agg(F.count("*").alias(f"n{n}"))

    keys1, keys2 = ["cx1", "cy1", "cz1", "f1"], ["cx2", "cy2", "cz2", "f2"]
    steps = F.expr("flatten(transform(array(-1, 0, 1), i -> flatten(transform(array(-1, 0, 1), j -> transform(array(-1, 0, 1), k -> named_struct('i', i, 'j', j, 'k', k))))))")
    left = counted(side, 1).select("*", F.explode(steps).alias("s"))
    pairs = left.withColumns({"cx2": F.col("cx1") + F.col("s.i"), "cy2": F.col("cy1") + F.col("s.j"), "cz2": F.col("cz1") + F.col("s.k")}).drop("s").join(
        counted(side, 2), ["cx2", "cy2", "cz2"]).filter("f1 < f2")
    while True:
        near, far = _bounds(side)
        pairs = cut_lineage(pairs.withColumns({"near": near, "far": far}))
        best = pairs.agg(F.min("far")).first()[0]
        pairs = pairs.filter(F.col("near") <= best)
        work = pairs.agg(F.sum(F.col("n1").cast("double") * F.col("n2"))).first()[0]
        if work <= MAX_POINT_PAIRS or side < 1e-8:
            break
        side /= 4.0
        parents = pairs.select(*[F.col(c).alias("p" + c) for c in (*keys1[:3], *keys2[:3])], "f1", "f2")
        for n in (1, 2):
            child = counted(side, n).select("*", *[F.floor(F.col(f"c{c}{n}") / 4).alias(f"pc{c}{n}") for c in "xyz"])
            parents = parents.join(child, [f"pcx{n}", f"pcy{n}", f"pcz{n}", f"f{n}"])
        pairs = parents.select(*keys1, "n1", *keys2, "n2")

    def placed(n):
        return pts.select(*[c.alias(f"{name}{n}") for c, name in zip(_cube(side), ("cx", "cy", "cz"))], F.col("fold").alias(f"f{n}"), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}"))
    met = pairs.select(*keys1, *keys2).join(placed(1), keys1).join(placed(2), keys2)
    return met.agg(F.min(geometry.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))).alias("min_km"))


def repeat_acquisitions(assigned: DataFrame) -> DataFrame:
    """Positions acquired more than once: how many, patches involved, the most at one, and how many span folds."""
    pos = assigned.groupBy("tile", "row", "col").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("f")).filter("n > 1")
    return pos.agg(F.count("*").alias("locations"), F.coalesce(F.sum("n"), F.lit(0)).alias("patches_involved"), F.coalesce(F.max("n"), F.lit(0)).alias("max_at_one"),
                   F.count_if(F.col("f") > 1).alias("spanning_folds"))


def fold_balance(assigned: DataFrame) -> DataFrame:
    n = assigned.groupBy("fold").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_folds"), F.min("n").alias("smallest"), F.max("n").alias("largest")).withColumn("balance", F.col("smallest") / F.col("largest"))


def class_presence(assigned: DataFrame, contents: DataFrame) -> DataFrame:
    """(fold, cls) pairs present, from block contents (block, cls)."""
    return assigned.select("block", "fold").distinct().join(contents, "block").select("fold", "cls").distinct()


def absent_classes(assigned: DataFrame, contents: DataFrame, k: int = 5) -> DataFrame:
    """Classes missing from a fold, and whether any allocation could have avoided it."""
    present = class_presence(assigned, contents)
    per = contents.select("block", "cls").distinct().groupBy("cls").agg(F.count("*").alias("n_blocks"))
    wanted = per.withColumn("fold", F.explode(dims.literal_array(range(k))))
    return wanted.join(present, ["fold", "cls"], "left_anti").withColumn("irreducible", F.col("n_blocks") < k)


def contamination(manifest: DataFrame, patches: DataFrame, split: str) -> DataFrame:
    """Ids of a manifest that belong to another split; must be empty."""
    return manifest.join(patches.filter(F.col("split") != split).select("patch_id"), "patch_id", "left_semi")
