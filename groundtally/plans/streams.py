"""Queries K1-K3: file streams over the driver's tables, read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundtally.functions import dims
from groundtally.plans.bands import LB, SEVEN
from groundtally.plans.scans import scratch
from groundtally.plans.sqlviews import ANNOTATIONS, PATCHES, chain
from groundtally.sources import fixture as fx
from groundtally.streaming import intake


def stream(spark, sf, name):
    return intake.file_stream(spark, sf, fx.table(spark, sf, name).schema, f"{name}.parquet")


def k1(spark, sf):
    cls = dims.literal_table(spark, list(enumerate(dims.C19_NAMES)), "k bigint, name string")
    ann = spark.sql(fx.ANNOTATION_SELECT, orders=stream(spark, sf, "orders"), cls=F.broadcast(cls))
    out = scratch(spark, "annotations")
    intake.annotation_intake(ann, out, scratch(spark, "state"))
    return spark.read.parquet(out).groupBy("split", "type", "category").agg(F.count("*").alias("n_rows"), F.sum("id").alias("id_sum"))


def k2(spark, sf):
    li = stream(spark, sf, "lineitem").select(F.get(dims.literal_array(SEVEN), F.col("l_linenumber") - 1).alias("band"), F.col("l_quantity").alias("value"))
    out = scratch(spark, "sums")
    intake.running_band_sums(li, out, scratch(spark, "state"))
    return spark.read.parquet(out)


def k3(spark, sf):
    """The same arrivals taken twice under two checkpoints: the second pass must add nothing."""
    out = scratch(spark, "rasters")
    nation = F.col("c_nationkey")
    pos = F.col("c_custkey") % 120
    pid = F.concat(F.lit("S2A_"), F.col("c_custkey").cast("string"), F.lit("_T"), (10 + nation).cast("string"), F.lit("ABC_"),
                   F.floor(pos / 12).cast("string"), F.lit("_"), (pos % 12).cast("string"))
    arriving = stream(spark, sf, "customer").select(pid.alias("patch_id"), F.col("c_mktsegment").alias("country"))
    for _ in range(2):
        intake.raster_ingest(arriving, out, scratch(spark, "state"))
    return intake.stored_rasters(spark, out, arriving.schema).groupBy("tile").agg(F.count("*").alias("n_rows"), F.count_distinct("patch_id").alias("n_patches"))


QUERIES = {"K1_annotation_intake": k1, "K2_running_band_sums": k2, "K3_resumable_ingest": k3}

ORACLES = {
    "K1_annotation_intake": chain(ANNOTATIONS) + "SELECT split, type, category, COUNT(*) AS n_rows, CAST(SUM(id) AS BIGINT) AS id_sum FROM ann GROUP BY ALL",
    "K2_running_band_sums": chain(LB) + "SELECT band, COUNT(*) AS n, SUM(l_quantity) AS total, SUM(l_quantity * l_quantity) AS total_sq FROM lb GROUP BY band",
    "K3_resumable_ingest": chain(PATCHES) + "SELECT tile, COUNT(*) AS n_rows, COUNT(DISTINCT patch_id) AS n_patches FROM patches GROUP BY tile",
}
