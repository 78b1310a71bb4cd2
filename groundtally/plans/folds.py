"""Queries H1-H15: blocks, folds and exact leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundtally.functions import fixed_values as V
from groundtally.functions import geometry
from groundtally.operators import splits as S
from groundtally.plans.sqlviews import PATCHES, PIXELS, TAX, chain
from groundtally.sources import fixture as fx

K = 5


def contents(spark, sf):
    """Every class code that occurs in a tile; the pixels of patch n lie in tile T(10+n)."""
    met = fx.pixels(spark, sf).filter(F.col("code") != V.UNCLASSIFIED_CODE).select("patch_id", "code").distinct()
    return met.select(F.concat(F.lit("T"), (10 + F.col("patch_id")).cast("string"), F.lit("ABC")).alias("block"), F.col("code").alias("cls"))


def by(spark, sf, strategy="s2_tile", stratified=False):
    return S.assign_folds(fx.patches(spark, sf), strategy, K, contents(spark, sf) if stratified else None)


def h1(spark, sf):
    p = fx.patches(spark, sf)
    out = None
    for s in S.STRATEGIES:
        one = S.with_blocks(p, s).groupBy("block").agg(F.count("*").alias("n")).withColumn("strategy", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def folds_of(assigned):
    return assigned.groupBy("block", "fold").agg(F.count("*").alias("n"))


def h8(spark, sf):
    p = fx.patches(spark, sf)
    corner = p.groupBy("tile").agg(F.min("lat").alias("lat0"), F.min("lon").alias("lon0"))
    d = geometry.haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    return p.join(corner, "tile").select("patch_id", F.round(d, 6).alias("km"))


def h9(spark, sf):
    tile = S.min_fold_distance(by(spark, sf)).withColumn("strategy", F.lit("s2_tile"))
    country = S.min_fold_distance(by(spark, sf, "country")).withColumn("strategy", F.lit("country"))
    return tile.unionByName(country).withColumn("min_km", F.round("min_km", 6))


def h10(spark, sf):
    r = S.random_folds(S.with_blocks(fx.patches(spark, sf), "s2_tile"), K)
    n = S.severed_pairs(r).agg(F.count("*").alias("severed"))
    all_n = S.touching_pairs(r).agg(F.sum("n_pairs").alias("touching"))
    return n.join(F.broadcast(all_n)).join(F.broadcast(S.same_block_rate(r).select(F.col("rate").alias("same_block_rate")))).withColumn(
        "severed_rate", F.col("severed") / F.col("touching"))


def h11(spark, sf):
    tile = S.repeat_acquisitions(by(spark, sf)).withColumn("strategy", F.lit("s2_tile"))
    rnd = S.repeat_acquisitions(S.random_folds(fx.patches(spark, sf), K)).withColumn("strategy", F.lit("random"))
    return tile.unionByName(rnd)


def h12(spark, sf):
    out = None
    for s in S.STRATEGIES:
        one = S.fold_balance(by(spark, sf, s)).withColumn("strategy", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def h13(spark, sf):
    return S.class_presence(by(spark, sf), contents(spark, sf)).groupBy("cls").agg(F.count("*").alias("n_folds"))


def h14(spark, sf):
    sized = S.absent_classes(by(spark, sf), contents(spark, sf), K).withColumn("allocation", F.lit("size"))
    strat = S.absent_classes(by(spark, sf, stratified=True), contents(spark, sf), K).withColumn("allocation", F.lit("stratified"))
    return sized.unionByName(strat)


def h15(spark, sf):
    p = fx.patches(spark, sf).withColumn("split", F.when(F.col("country") == "BUILDING", "validation").otherwise("train"))
    manifest = p.filter((F.col("split") == "train") | (F.col("row") == 3)).select("patch_id")
    return S.contamination(manifest, p, "train")


QUERIES = {
    "H1_block_keys": h1,
    "H2_greedy_folds": lambda s, d: folds_of(by(s, d)),
    "H3_stratified_folds": lambda s, d: folds_of(by(s, d, stratified=True)),
    "H4_blocks_spanning": lambda s, d: S.folds_per_block(by(s, d, "country").withColumn("block", F.col("tile"))),
    "H5_severed_pairs": lambda s, d: S.severed_pairs(by(s, d, "country")),
    "H6_touching_pairs": lambda s, d: S.touching_pairs(fx.patches(s, d)),
    "H7_same_block_rate": lambda s, d: S.same_block_rate(by(s, d, "country").withColumn("block", F.col("tile"))),
    "H8_haversine": h8, "H9_min_fold_distance": h9, "H10_random_baseline": h10, "H11_repeat_acquisitions": h11,
    "H12_fold_balance": h12, "H13_class_presence": h13, "H14_absent_classes": h14, "H15_contamination": h15,
}

_KEY = {"country": "country", "s2_tile": "tile", "grid_1deg": "CAST(FLOOR(lat) AS BIGINT) || '_' || CAST(FLOOR(lon) AS BIGINT)"}


def greedy(name, strategy):
    """CTEs ending in `{name}` = patches with block and fold."""
    return [
        f"{name}z AS (SELECT {_KEY[strategy]} AS block, COUNT(*) AS n FROM patches GROUP BY 1)",
        f"{name}o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, block) AS i FROM {name}z)",
        f"{name}g(i, load, fold, block) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], 0, '' UNION ALL SELECT o.i, LIST_TRANSFORM(load, lambda x, j: CASE WHEN j = LIST_POSITION(load, LIST_MIN(load)) THEN x + o.n ELSE x END), "
        f"CAST(LIST_POSITION(load, LIST_MIN(load)) - 1 AS INT), o.block FROM {name}g g JOIN {name}o o ON o.i = g.i + 1)",
        f"{name} AS MATERIALIZED (SELECT p.*, g.block, g.fold FROM patches p JOIN {name}g g ON g.block = {_KEY[strategy]} AND g.i > 0)",
    ]


CONTENTS = "cont AS MATERIALIZED (SELECT DISTINCT 'T' || (10 + patch_id) || 'ABC' AS block, code AS cls FROM pixels WHERE code <> 999)"
STRAT = [
    TAX, PIXELS, PATCHES, CONTENTS,
    "wt AS (SELECT cls, 1.0::DOUBLE / COUNT(*) AS w FROM cont GROUP BY cls)",
    "hs AS (SELECT block, LIST({'cls': cls, 'w': w} ORDER BY cls) AS has FROM cont JOIN wt USING (cls) GROUP BY block)",
    "sz AS (SELECT tile AS block, COUNT(*) AS n FROM patches GROUP BY tile)",
    "so AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (ORDER BY rare DESC, n DESC, block) AS i, (SELECT SUM(n) FROM sz) / 5.0::DOUBLE AS mean FROM (SELECT s.*, COALESCE(has, []) AS has, "
    "COALESCE(LIST_SUM(LIST_TRANSFORM(has, lambda x: x.w)), 0) AS rare FROM sz s LEFT JOIN hs USING (block)))",
    "sg(i, load, covered, fold, block) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], [[], [], [], [], []]::INT[][], 0, '' UNION ALL "
    "SELECT i, LIST_TRANSFORM(load, lambda x, j: CASE WHEN j = b THEN x + n ELSE x END), LIST_TRANSFORM(covered, lambda x, j: CASE WHEN j = b THEN LIST_CONCAT(x, LIST_TRANSFORM(has, lambda h: h.cls)) ELSE x END), CAST(b - 1 AS INT), block FROM ("
    "SELECT *, LIST_POSITION(sc, LIST_MAX(sc)) AS b FROM (SELECT o.i, o.n, o.block, o.has, g.load, g.covered, LIST_TRANSFORM(RANGE(1, 6), lambda f: COALESCE(LIST_SUM(LIST_TRANSFORM(o.has, lambda x: "
    "CASE WHEN LIST_CONTAINS(g.covered[f], x.cls) THEN 0.0::DOUBLE ELSE x.w END)), 0) - 0.15::DOUBLE * GREATEST((g.load[f] + o.n - o.mean) / o.mean, 0)) AS sc FROM sg g JOIN so o ON o.i = g.i + 1)))",
    "strat AS MATERIALIZED (SELECT p.*, g.block, g.fold FROM patches p JOIN sg g ON g.block = p.tile AND g.i > 0)",
]
RANDOM = "rnd AS (SELECT *, tile AS block, CAST(('0x' || SUBSTR(MD5('1337:' || patch_id), 1, 8))::BIGINT % 5 AS INT) AS fold FROM patches)"


def severed(src):
    pos = f"(SELECT tile, row, col, MAX(patch_id) AS patch_id, ARG_MAX(fold, patch_id) AS fold FROM {src} GROUP BY ALL)"
    return (f"SELECT a.patch_id AS patch_a, b.patch_id AS patch_b, a.fold AS fold_a, b.fold AS fold_b FROM {pos} a JOIN {pos} b ON a.tile = b.tile AND ABS(a.row - b.row) <= 1 AND ABS(a.col - b.col) <= 1 "
            "AND a.patch_id < b.patch_id AND (a.row, a.col) <> (b.row, b.col) WHERE a.fold <> b.fold")


TOUCH = ("SELECT a.tile, COUNT(*) AS n_pairs FROM (SELECT DISTINCT tile, row, col FROM patches) a JOIN (SELECT DISTINCT tile, row, col FROM patches) b ON a.tile = b.tile AND ABS(a.row - b.row) <= 1 "
         "AND ABS(a.col - b.col) <= 1 AND (a.row, a.col) < (b.row, b.col) GROUP BY a.tile")


def rate(src, block="block"):
    return (f"SELECT same::DOUBLE AS same, \"cross\"::DOUBLE AS \"cross\", CASE WHEN \"cross\" = 0 THEN 0 ELSE same::DOUBLE / \"cross\"::DOUBLE END AS rate FROM (SELECT COUNT(*) FILTER (a.b = b.b) AS same, COUNT(*) AS \"cross\" "
            f"FROM (SELECT {block} AS b, fold FROM {src}) a JOIN (SELECT {block} AS b, fold FROM {src}) b ON a.fold <> b.fold)")


_HAV = ("2 * 6371.0088::DOUBLE * ASIN(SQRT(POWER(SIN((RADIANS({b}.lat) - RADIANS({a}.lat)) / 2), 2) + COS(RADIANS({a}.lat)) * COS(RADIANS({b}.lat)) * POWER(SIN(RADIANS({b}.lon - {a}.lon) / 2), 2)))")
_DP = "(SELECT DISTINCT lat, lon, fold FROM {})"


def nearest(src):
    return f"SELECT ROUND(MIN({_HAV.format(a='a', b='b')}), 6) AS min_km FROM {_DP.format(src)} a JOIN {_DP.format(src)} b ON a.fold < b.fold"


def repeats(src):
    return (f"SELECT COUNT(*) AS locations, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS patches_involved, COALESCE(MAX(n), 0) AS max_at_one, COUNT(*) FILTER (f > 1) AS spanning_folds FROM "
            f"(SELECT COUNT(*) AS n, COUNT(DISTINCT fold) AS f FROM {src} GROUP BY tile, row, col HAVING COUNT(*) > 1)")


def absent(src, label):
    return (f"SELECT w.fold, w.cls, w.n_blocks, w.n_blocks < 5 AS irreducible, '{label}' AS allocation FROM (SELECT cls, COUNT(*) AS n_blocks, UNNEST(RANGE(5))::INT AS fold FROM cont GROUP BY cls) w "
            f"ANTI JOIN (SELECT DISTINCT a.fold, c.cls FROM {src} a JOIN cont c ON c.block = a.block) p ON p.fold = w.fold AND p.cls = w.cls")


_CT, _TI = greedy("ct", "country"), greedy("ti", "s2_tile")
_P = [PATCHES]
ORACLES = {
    "H1_block_keys": chain(PATCHES) + " UNION ALL ".join(f"SELECT {k} AS block, COUNT(*) AS n, '{s}' AS strategy FROM patches GROUP BY 1" for s, k in _KEY.items()),
    "H2_greedy_folds": chain(PATCHES, *_TI) + "SELECT block, fold, COUNT(*) AS n FROM ti GROUP BY ALL",
    "H3_stratified_folds": chain(*STRAT) + "SELECT block, fold, COUNT(*) AS n FROM strat GROUP BY ALL",
    "H4_blocks_spanning": chain(PATCHES, *_CT) + "SELECT tile AS block, COUNT(*) AS n, COUNT(DISTINCT fold) AS n_folds, COUNT(DISTINCT fold) > 1 AS spans FROM ct GROUP BY tile",
    "H5_severed_pairs": chain(PATCHES, *_CT) + severed("ct"),
    "H6_touching_pairs": chain(PATCHES) + TOUCH,
    "H7_same_block_rate": chain(PATCHES, *_CT) + rate("ct", "tile"),
    "H8_haversine": chain(PATCHES) + f"SELECT p.patch_id, ROUND({_HAV.format(a='c', b='p')}, 6) AS km FROM patches p JOIN (SELECT tile, MIN(lat) AS lat, MIN(lon) AS lon FROM patches GROUP BY tile) c USING (tile)",
    "H9_min_fold_distance": chain(PATCHES, *_CT, *_TI) + f"SELECT *, 's2_tile' AS strategy FROM ({nearest('ti')}) UNION ALL SELECT *, 'country' FROM ({nearest('ct')})",
    "H10_random_baseline": chain(PATCHES, RANDOM) + f"SELECT severed, touching, (SELECT rate FROM ({rate('rnd')})) AS same_block_rate, severed::DOUBLE / touching AS severed_rate FROM "
        f"(SELECT COUNT(*) AS severed FROM ({severed('rnd')})), (SELECT CAST(SUM(n_pairs) AS BIGINT) AS touching FROM ({TOUCH}))",
    "H11_repeat_acquisitions": chain(PATCHES, *_TI, RANDOM) + f"SELECT *, 's2_tile' AS strategy FROM ({repeats('ti')}) UNION ALL SELECT *, 'random' FROM ({repeats('rnd')})",
    "H12_fold_balance": chain(PATCHES, *_CT, *_TI, *greedy("gr", "grid_1deg")) + " UNION ALL ".join(
        f"SELECT COUNT(*) AS n_folds, MIN(n) AS smallest, MAX(n) AS largest, MIN(n)::DOUBLE / MAX(n) AS balance, '{s}' AS strategy FROM (SELECT fold, COUNT(*) AS n FROM {t} GROUP BY fold)"
        for s, t in (("country", "ct"), ("grid_1deg", "gr"), ("s2_tile", "ti"))),
    "H13_class_presence": chain(TAX, PIXELS, PATCHES, CONTENTS, *_TI) + "SELECT c.cls, COUNT(DISTINCT a.fold) AS n_folds FROM ti a JOIN cont c ON c.block = a.block GROUP BY c.cls",
    "H14_absent_classes": chain(*STRAT, *_TI) + absent("ti", "size") + " UNION ALL " + absent("strat", "stratified"),
    "H15_contamination": chain(PATCHES) + "SELECT patch_id FROM patches WHERE country = 'BUILDING' AND row = 3",
}
