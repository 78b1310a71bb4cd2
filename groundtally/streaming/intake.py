"""Incremental intake: sealed rows dropped, running band sums, resumable raster ingest.

All three run with ``availableNow``: they take what has arrived, commit it to the checkpoint and stop.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from groundtally.functions import fixed_values as V
from groundtally.session import cut_lineage
from groundtally.sources import tables


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).parquet(folder)


def take_available(writer, checkpoint: str) -> None:
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def annotation_intake(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends open rows to a table partitioned by split; sealed rows never reach it."""
    take_available(tables.scan_annotations(stream).writeStream.format("parquet").partitionBy("split").option("path", out).outputMode("append"), checkpoint)


def running_band_sums(stream: DataFrame, out: str, checkpoint: str, value: Callable | None = None) -> None:
    """Running n, sum and sum of squares per band (band, value); each batch replaces the small result table."""
    v = F.col("value")
    sums = stream.groupBy("band").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("total_sq"))

    def replace(batch: DataFrame, _: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(out)  # one row per band

    take_available(sums.writeStream.outputMode("complete").foreachBatch(replace), checkpoint)


# ------------------------------------------------------------------------------ resumable raster store
INDEX = "take string, tile string, least string, greatest string, n_rows long"
PROGRESS = "take string, seen long, written long, stored long, no_tile long"


def _folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, folders below it included; empty while nothing is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    nested = path.rsplit("/", 1)[-1].startswith("_")  # one folder a take, not a partition
    return spark.read.schema(schema).option("recursiveFileLookup", str(nested).lower()).parquet(path)


def _columns(schema: StructType, *folders: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"{name} string" for name in folders)])


def store_index(spark: SparkSession, out: str) -> DataFrame:
    """Committed writes: the tiles of each take with their key range and number of rows."""
    return _folder(spark, f"{out}/_index", INDEX)


def ingest_progress(spark: SparkSession, out: str) -> DataFrame:
    """Rasters seen, written, already stored and without a tile, by committed take."""
    return _folder(spark, f"{out}/_progress", PROGRESS)


def stored_rasters(spark: SparkSession, out: str, schema: StructType, index: DataFrame | None = None) -> DataFrame:
    """Rasters of committed takes. Given part of the index, only files of its takes and tiles are read."""
    names = _columns(schema, "take", "tile")
    wanted = (store_index(spark, out) if index is None else index).select("take", "tile").distinct()
    return _folder(spark, f"{out}/data", names).join(F.broadcast(wanted), ["take", "tile"])  # a row a take and tile: prunes folders


def raster_ingest(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Stores rasters that are not stored yet, by tile, each batch exactly once.

    A batch is one take, named by its stream's checkpoint and its number. Its rows go to folders of its own, then its line in the index commits
    them: a batch that is replayed after a crash writes the same folders again, and rows without a line are not part of the store. A batch
    looks up its keys in the index first and reads keys only from takes and tiles whose range they fall into. Of rows that repeat a
    key, one is stored; rows without a tile in their key are counted and left out.
    """
    owner = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def store(batch: DataFrame, number: int) -> None:
        spark, take = batch.sparkSession, f"{owner}-{number}"
        tiled = cut_lineage(batch.withColumn("tile", F.regexp_extract(F.coalesce("patch_id", F.lit("")), V.PATCH_ID_TAIL, 1)))
        keyed = tiled.filter("tile <> ''").dropDuplicates(["patch_id"])
        range_of = keyed.groupBy("tile").agg(F.min("patch_id").alias("lo"), F.max("patch_id").alias("hi"))
        near = store_index(spark, out).filter(F.col("take") != take).join(F.broadcast(range_of), "tile").filter("least <= hi and lo <= greatest")
        known = stored_rasters(spark, out, batch.schema, near).select("patch_id")
        fresh = keyed.join(known, "patch_id", "left_anti")
        fresh.write.mode("overwrite").partitionBy("tile").parquet(f"{out}/data/take={take}")
        commit(spark, out, take, tiled, batch.schema)

    take_available(stream.writeStream.foreachBatch(store), checkpoint)


def commit(spark: SparkSession, out: str, take: str, tiled: DataFrame, schema: StructType) -> None:
    """Writes the take's progress, then its line in the index."""
    written = _folder(spark, f"{out}/data/take={take}", _columns(schema, "tile"))
    lines = written.groupBy("tile").agg(F.min("patch_id").alias("least"), F.max("patch_id").alias("greatest"), F.count("*").alias("n_rows")).select(
        F.lit(take).alias("take"), "tile", "least", "greatest", "n_rows")
    counts = tiled.agg(F.count("*").alias("seen"), F.count_if(F.col("tile") == "").alias("no_tile")).join(F.broadcast(written.agg(F.count("*").alias("written"))))
    progress = counts.select(F.lit(take).alias("take"), "seen", "written", (F.col("seen") - F.col("written") - F.col("no_tile")).alias("stored"), "no_tile")
    progress.write.mode("overwrite").parquet(f"{out}/_progress/{take}")
    lines.write.mode("overwrite").parquet(f"{out}/_index/{take}")
