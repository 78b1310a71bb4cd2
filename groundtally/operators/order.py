"""Order statistics of groups of any size: rows dealt by range, with what the ranges before hold carried along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtally.session import cut_lineage


def dealt(df: DataFrame, group: str, value: str) -> DataFrame:
    """``df`` range-partitioned by (group, value) and written, with ``_part``: ranges of a group follow one another by number.

    A large group spans many ranges, and equal values of a group are in one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, group, value).withColumn("_part", F.spark_partition_id()))


def neighbour_gaps(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, previous): each distinct value beside the next smaller one of its group, null for the smallest."""
    rows = dealt(values.select(group, value).distinct(), group, value)
    borders = rows.groupBy(group, "_part").agg(F.max(value).alias("_last")).select(
        group, "_part", F.lag("_last").over(Window.partitionBy(group).orderBy("_part")).alias("_before"))  # one row per range
    inside = rows.withColumn("_prev", F.lag(value).over(Window.partitionBy(group, "_part").orderBy(value)))
    return inside.join(borders, [group, "_part"]).select(group, value, F.coalesce("_prev", "_before").alias("previous"))


def exact_quantiles(counts: DataFrame, group: str, value: str, n: str, probs: dict[str, float]) -> DataFrame:
    """(group, one column for each of ``probs``): interpolated quantiles of values met ``n`` times each.

    Counts by range tell which range holds a wanted rank; only rows of such ranges are ranked.
    """
    rows = dealt(counts.select(group, value, F.col(n).alias("_n")), group, value)
    order = Window.partitionBy(group).orderBy("_part")
    ranges = rows.groupBy(group, "_part").agg(F.sum("_n").alias("_held")).select(
        group, "_part", "_held", (F.sum("_held").over(order) - F.col("_held")).alias("_first"), F.sum("_held").over(Window.partitionBy(group)).alias("_all"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(p) * (F.col("_all") - 1)).alias("at")) for k, p in probs.items()])).alias("q")
    ends = F.explode(F.array(F.floor("q.at"), F.ceil("q.at"))).alias("rank")
    asked = ranges.select("*", wanted).select("*", ends).filter((F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_first") + F.col("_held")))
    within = Window.partitionBy(group, "_part").orderBy(value)
    touched = rows.join(asked.select(group, "_part", "_first").distinct(), [group, "_part"])  # one row for each of a few ranges
    placed = touched.withColumn("_from", F.col("_first") + F.sum("_n").over(within) - F.col("_n"))
    hit = placed.join(asked.select(group, "_part", "q", "rank").distinct(), [group, "_part"]).filter(
        (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_from") + F.col("_n")))
    found = hit.groupBy(group, F.col("q.k").alias("k"), F.col("q.at").alias("at")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))

    def interpolated() -> Column:
        low = F.floor("at")
        return F.when(F.col("at") == low, F.col("lo")).otherwise((low + 1 - F.col("at")) * F.col("lo") + (F.col("at") - low) * F.col("hi"))

    return found.groupBy(group).agg(*[F.max(F.when(F.col("k") == k, interpolated())).alias(k) for k in probs])
