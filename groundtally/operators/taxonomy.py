"""Class nomenclature operators over the long pixel table (patch_id, row, col, code)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtally.functions import dims
from groundtally.functions import fixed_values as V

LEVEL_COLUMN = {"l1": "l1", "l2": "l2", "l3": "idx", "c19": "c19_id", "coarse7": "coarse7_id"}


def _with_class(px: DataFrame) -> DataFrame:
    dim = dims.class_dim(px.sparkSession).withColumnRenamed("code", "_code")
    return px.join(F.broadcast(dim), F.col("code") == F.col("_code"), "left").drop("_code")


def level_lookup(code: Column, level: str) -> Column:
    """Class id of a code at ``level`` by position in a constant array; null for unknown codes."""
    at = {r[0]: r[("code idx name l2 l1 c19 c19_id coarse7 coarse7_id".split()).index(LEVEL_COLUMN[level])]
          for r in dims.class_rows()}
    first, last = min(at), max(at)
    return F.get(dims.literal_array([at.get(c) for c in range(first, last + 1)]), code - first)


def to_level(px: DataFrame, level: str) -> DataFrame:
    """Adds `cls`, the class id at ``level``; -1 has no equivalent there, -2 is unclassified."""
    return px.select(*px.columns, level_class(F.col("code"), level).alias("cls"))


def level_class(code: Column, level: str) -> Column:
    if level not in LEVEL_COLUMN:
        raise ValueError(f"unknown level {level}")
    unknown = F.raise_error(F.concat(F.lit("code outside the nomenclature: "), code.cast("string"))).cast("int")
    known = F.coalesce(level_lookup(code, level), unknown)
    return F.when(code == V.UNCLASSIFIED_CODE, F.lit(V.UNCLASSIFIED_ID)).otherwise(known)


def level_counts(px: DataFrame, levels: Sequence[str]) -> DataFrame:
    """(patch_id, level, cls, n_px): the pixels are counted once by code, and the counts are mapped to every level."""
    by_code = px.groupBy("patch_id", "code").agg(F.count("*").alias("n"))
    mapped = [F.struct(F.lit(level).alias("level"), level_class(F.col("code"), level).alias("cls")) for level in levels]
    return by_code.select("patch_id", "n", F.inline(F.array(*mapped))).groupBy("patch_id", "level", "cls").agg(F.sum("n").alias("n_px"))


def classified(px: DataFrame, level: str) -> DataFrame:
    """Pixels that carry a class at ``level``: the input of every measurement."""
    return to_level(px, level).filter(F.col("cls") >= 0).select("patch_id", "row", "col", "cls")


def class_mask(px: DataFrame, class_name: str, level: str = "c19") -> DataFrame:
    """Pixels of one class, masked after aggregation to the queried level."""
    wanted = resolve_literal(class_name, level)
    return to_level(px, level).filter(F.col("cls") == wanted).select("patch_id", "row", "col", "cls")


def codes_to_indices(px: DataFrame) -> DataFrame:
    return to_level(px, "l3").withColumnRenamed("cls", "idx")


def indices_to_codes(df: DataFrame) -> DataFrame:
    codes = dims.literal_array([r[0] for r in dims.class_rows()])
    code = F.when(F.col("idx") < 0, F.lit(V.UNCLASSIFIED_CODE)).otherwise(F.element_at(codes, F.col("idx") + 1))
    return df.withColumn("code", code)


def resolve_literal(query: str | int, level: str) -> int:
    """Class id of one name or id at ``level``; used when an operator takes the class as a parameter."""
    for lvl, text, target in resolution_rows():
        if lvl == level and text == _query_key(str(query), level):
            return target
    raise ValueError(f"{query!r} is not a class at level {level}")


def _query_key(text: str, level: str) -> str:
    return text.strip() if level in ("c19", "coarse7") else text.strip().lower()


def resolution_rows() -> list[tuple[str, str, int]]:
    """(level, accepted text, id at level) for every name and id that may be asked for."""
    rows = [("c19", n, i) for i, n in enumerate(dims.C19_NAMES)]
    rows += [("coarse7", n, i) for i, n in enumerate(V.COARSE7)]
    for lvl, names in (("l1", V.L1_NAMES), ("l2", V.L2_NAMES)):
        rows += [(lvl, n.lower(), k) for k, n in names.items()] + [(lvl, str(k), k) for k in names]
    for code, idx, name, *_ in dims.class_rows():
        rows += [("l3", name.lower(), idx), ("l3", str(code), idx), ("l3", str(idx), idx)]
    return rows


def resolve_queries(asked: DataFrame) -> DataFrame:
    """(level, query) -> adds `target`, null where the query names nothing at that level."""
    table = dims.literal_table(asked.sparkSession, resolution_rows(), "level string, _key string, target int")
    key = F.when(F.col("level").isin("c19", "coarse7"), F.trim("query")).otherwise(F.lower(F.trim("query")))
    return asked.withColumn("_key", key).join(F.broadcast(table), ["level", "_key"], "left").drop("_key")


def nomenclature_audit(px: DataFrame) -> DataFrame:
    """Per observed code: pixels, and whether its place in the hierarchy holds together."""
    seen = px.groupBy("code").agg(F.count("*").alias("n_px"))
    l2, l1 = [F.lit(k) for k in V.L2_NAMES], [F.lit(k) for k in V.L1_NAMES]
    return _with_class(seen).select(
        "code", "n_px",
        F.coalesce(F.col("idx"), F.lit(V.UNCLASSIFIED_ID)).alias("idx"),
        F.coalesce(F.floor(F.col("code") / 10) == F.col("l2"), F.col("code") == V.UNCLASSIFIED_CODE).alias("l3_nested"),
        F.coalesce(F.floor(F.col("l2") / 10) == F.col("l1"), F.col("code") == V.UNCLASSIFIED_CODE).alias("l2_nested"),
        F.coalesce(F.col("l2").isin(*l2) & F.col("l1").isin(*l1), F.col("code") == V.UNCLASSIFIED_CODE).alias("parents_known"),
    )


def relatives(px: DataFrame) -> DataFrame:
    """Observed code -> siblings (same L2, not itself) and L1 branch, with their pixels."""
    seen = px.groupBy("code").agg(F.count("*").alias("n_px"))
    dim = dims.class_dim(px.sparkSession)
    me = _with_class(seen).filter("idx is not null").select("code", "n_px", "l1", "l2")
    other = dim.select(F.col("code").alias("other"), F.col("l1"), F.col("l2").alias("other_l2"))
    pair = me.join(F.broadcast(other), "l1")
    return pair.groupBy("code", "n_px").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(
            (F.col("l2") == F.col("other_l2")) & (F.col("code") != F.col("other")), F.col("other").cast("string")))), ",").alias("siblings"),
        F.array_join(F.array_sort(F.collect_set(F.col("other").cast("string"))), ",").alias("branch"),
    )


def confusion_penalty(truth: Column, predicted: Column) -> Column:
    """0 when right, 1.0 inside the L1 branch, 1.5 across branches."""
    return (
        F.when(truth == predicted, F.lit(0.0))
        .when(F.floor(truth / 100) == F.floor(predicted / 100), F.lit(V.SIBLING_PENALTY))
        .otherwise(F.lit(V.CROSS_L1_PENALTY))
    )


def confusion_cost(pairs: DataFrame) -> DataFrame:
    """(truth, predicted) code pairs -> counts and hierarchy-weighted cost."""
    return (
        pairs.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
        .withColumn("penalty", confusion_penalty(F.col("truth"), F.col("predicted")))
        .withColumn("cost", F.col("penalty") * F.col("n"))
    )


def coarse_comparison(px: DataFrame, foreign: DataFrame) -> DataFrame:
    """Coarse-7 pixel counts of our nomenclature beside a foreign scheme (patch_id, row, col, value)."""
    ours = _with_class(px).filter("coarse7 is not null").groupBy("coarse7").agg(F.count("*").alias("corine_px"))
    scheme = dims.literal_table(px.sparkSession, list(V.WORLDCOVER_COARSE7.items()), "value int, coarse7 string")
    theirs = foreign.join(F.broadcast(scheme), "value").groupBy("coarse7").agg(F.count("*").alias("foreign_px"))
    return ours.join(theirs, "coarse7", "full").select(
        "coarse7", F.coalesce("corine_px", F.lit(0)).alias("corine_px"),
        F.coalesce("foreign_px", F.lit(0)).alias("foreign_px"))


def resolve_forms(df: DataFrame, form: str = "form") -> DataFrame:
    """Adds canonical, observed, approximate for a surface-form column; null when unresolved."""
    from groundtally.functions.text import normal_form

    table = dims.literal_table(
        df.sparkSession, list(dims.surface_forms()), "_norm string, canonical string, observed boolean, approximate boolean")
    return df.withColumn("_norm", normal_form(F.col(form))).join(F.broadcast(table), "_norm", "left").drop("_norm")


def class_inventory(px: DataFrame) -> DataFrame:
    """Pixel and patch counts and shares per code, over every pixel."""
    per = px.groupBy("code", "patch_id").agg(F.count("*").alias("n"))
    by_code = per.groupBy("code").agg(F.sum("n").alias("n_px"), F.count("*").alias("n_patches"))
    totals = per.agg(F.sum("n").alias("all_px"), F.count_distinct("patch_id").alias("all_patches"))
    return by_code.join(F.broadcast(totals)).select(
        "code", "n_px", "n_patches", (F.col("n_px") / F.col("all_px")).alias("px_share"),
        (F.col("n_patches") / F.col("all_patches")).alias("patch_share"))


def mine_mapping(px: DataFrame, labels: DataFrame, keep: int = 3) -> DataFrame:
    """Code -> best labels by co-occurrence within a patch: rank, support, confidence."""
    from pyspark.sql import Window

    codes = px.select("patch_id", "code").distinct()
    support = codes.join(labels.select("patch_id").distinct(), "patch_id", "left_semi") \
        .groupBy("code").agg(F.count("*").alias("support"))
    pairs = codes.join(labels.select("patch_id", "label").distinct(), "patch_id") \
        .groupBy("code", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("code").orderBy(F.desc("n"), "label")
    return (
        pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
        .join(F.broadcast(support), "code")
        .select("code", "rank", "label", "n", "support", (F.col("n") / F.col("support")).alias("confidence"))
    )
