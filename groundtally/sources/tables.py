"""Scans, guards, harvests, sinks and manifests of the annotation and raster tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundtally.functions import fixed_values as V


class SealedSplitError(RuntimeError):
    """A sealed split was asked for, or sealed rows were found where none may be."""


def benchmark_access(flag: str | None) -> bool:
    """Only the exact string "1" unlocks the sealed split."""
    return flag == "1"


def read_annotations(spark: SparkSession, path: str, columns: list[str] | None = None,
                     splits: tuple[str, ...] = V.OPEN_SPLITS, unlock: str | None = None) -> DataFrame:
    return scan_annotations(spark.read.parquet(path), columns, splits, unlock)


def scan_annotations(df: DataFrame, columns: list[str] | None = None, splits: tuple[str, ...] = V.OPEN_SPLITS,
                     unlock: str | None = None) -> DataFrame:
    """Projection and split filter; both reach the scan. The sealed split is refused at plan time."""
    if V.SEALED_SPLIT in splits and not benchmark_access(unlock):
        raise SealedSplitError("the sealed split may not be read")
    out = df.filter(F.col("split").isin(*splits))
    return out.select(*columns) if columns else out


def assert_unsealed(df: DataFrame) -> DataFrame:
    """Fails the job when a sealed row passes through; costs one predicate per row."""
    ok = F.assert_true(F.col("split") != V.SEALED_SPLIT, F.lit("sealed row found"))
    return df.filter(F.coalesce(ok.cast("boolean"), F.lit(True)))


def split_audit(df: DataFrame, permitted: tuple[str, ...] = V.OPEN_SPLITS) -> DataFrame:
    """Rows per split seen in a full pass, and whether the split is permitted."""
    return df.groupBy("split").agg(F.count("*").alias("n_rows")).withColumn("permitted", F.col("split").isin(*permitted))


def quota_harvest(df: DataFrame, keys: list[str], order: str, per_key: int, skip: int = 0) -> DataFrame:
    """Rows skip+1 .. skip+per_key of every key in ``order``.

    The rank bound lets Spark cut each key map-side (window group limit) before it shuffles.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= skip + per_key).filter(F.col("rn") > skip)


def fold_quota_harvest(df: DataFrame, folds: DataFrame, order: str, limit: int, k: int) -> DataFrame:
    """At most limit/k rows of every fold, so no fold dominates."""
    return quota_harvest(df.join(folds, "patch_id"), ["fold"], order, max(1, limit // k))


def write_class_maps(px: DataFrame, path: str, mode: str = "append") -> None:
    px.write.mode(mode).partitionBy("tile").parquet(path)


def read_class_maps(spark: SparkSession, path: str, tiles: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if tiles is None else df.filter(F.col("tile").isin(*tiles))


def to_dense(px: DataFrame) -> DataFrame:
    """Long pixels -> one array of codes per raster row (a row is bounded by the raster width)."""
    packed = F.array_sort(F.collect_list(F.struct("col", "code")))
    return px.groupBy("patch_id", "row").agg(F.transform(packed, lambda x: x["code"]).alias("codes"))


def to_long(dense: DataFrame) -> DataFrame:
    return dense.select("patch_id", "row", F.posexplode("codes").alias("col", "code"))


def pending_ingest(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rasters with the tile they go to and whether they are new, stored or without a tile."""
    tile = F.regexp_extract("patch_id", V.PATCH_ID_TAIL, 1)
    seen = stored.select("patch_id", F.lit(True).alias("_seen")).distinct()
    return incoming.join(seen, "patch_id", "left").select(
        "patch_id", F.when(tile != "", tile).alias("tile"),
        F.when(tile == "", F.lit("no_tile")).when(F.col("_seen"), F.lit("stored")).otherwise(F.lit("new")).alias("status"))


def manifest_summary(folds: DataFrame, strategy: str, k: int, seed: int) -> DataFrame:
    """(patch_id, block, fold) -> one JSON summary row; the assignment itself stays a table."""
    sizes = folds.groupBy("fold").agg(F.count("*").alias("n"))
    per = sizes.agg(F.array_sort(F.collect_list(F.struct("fold", "n"))).alias("s"), F.sum("n").alias("n_patches"))
    blocks = folds.agg(F.count_distinct("block").alias("block_count"))
    return per.join(F.broadcast(blocks)).select(F.to_json(F.struct(
        F.lit(strategy).alias("strategy"), F.lit(k).alias("k"), F.lit(seed).alias("seed"), "block_count", "n_patches",
        F.transform("s", lambda x: x["n"]).alias("fold_sizes"))).alias("summary"))


ASSIGNMENT_SCHEMA = "patch_id string, block string, fold int"


def write_manifest(folds: DataFrame, path: str) -> None:
    """The assignment itself, as a table of (patch_id, block, fold)."""
    folds.select("patch_id", "block", F.col("fold").cast("int").alias("fold")).write.mode("error").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The assignment written by :func:`write_manifest`; a table of another shape or a row without a fold is an error."""
    found = spark.read.parquet(path)
    if [f"{n} {t}" for n, t in found.dtypes] != ASSIGNMENT_SCHEMA.split(", "):
        raise ValueError(f"split manifest is malformed: {found.schema.simpleString()}")
    whole = F.assert_true(F.col("patch_id").isNotNull() & F.col("fold").isNotNull(), F.lit("split manifest is malformed"))
    return found.filter(F.coalesce(whole.cast("boolean"), F.lit(True)))


MANIFEST_SCHEMA = "strategy string, k int, seed int, block_count long, n_patches long, fold_sizes array<long>"


def read_manifest_summary(df: DataFrame) -> DataFrame:
    """Parsed summaries; malformed ones carry an error instead of values."""
    s = F.from_json("summary", MANIFEST_SCHEMA)
    bad = s.isNull() | s["strategy"].isNull() | s["k"].isNull() | s["fold_sizes"].isNull()
    return df.select(s["strategy"].alias("strategy"), s["k"].alias("k"), s["seed"].alias("seed"),
                     s["block_count"].alias("block_count"), s["n_patches"].alias("n_patches"),
                     F.array_join(F.transform(s["fold_sizes"], lambda x: x.cast("string")), ",").alias("fold_sizes"),
                     F.when(bad, F.lit("split manifest is malformed")).otherwise(F.lit("")).alias("error"))


def row_digest(columns: list[str]) -> Column:
    """63-bit number from the md5 of a row's text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free fingerprint: row count and sum of row digests, one pass with partial sums."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(row_digest(columns)).cast("string").alias("digest_sum"))


def sample_hash(df: DataFrame, group: str, column: str, digits: int = 4) -> DataFrame:
    """Digest of a sample list of any length: ids are hashed in sorted chunks by md5 prefix, and the hashes level by level.

    A level shortens the prefix by two digits, so a task holds 256 hashes at most, and about 1/16^digits
    of a group's ids at the bottom.
    """
    joined = lambda key, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))), lambda x: x["v"]), ""), 256)
    rows = df.select(group, F.col(column).cast("string").alias("v")).withColumn("p", F.substring(F.md5("v"), 1, digits))
    level = rows.groupBy(group, "p").agg(joined("v", "v").alias("h"), F.count("*").alias("n"))
    for length in range(digits - 2, -1, -2):
        level = level.groupBy(group, F.substring("p", 1, length).alias("q")).agg(joined("p", "h").alias("h"), F.sum("n").alias("n")).withColumnRenamed("q", "p")
    return level.select(group, F.col("h").alias("hash"), F.col("n").alias("n_samples"))
