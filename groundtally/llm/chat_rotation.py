"""Chat formatting by perspective rotation: each participant in turn is the assistant.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtally.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Roles that speak for nobody: rendered as they are, never a perspective.
NARRATORS = ("system",)
#: A part holds the turns of so many successive numbers (a power of two).
PART_TURNS = 64


def _piece(turn: Column, speaker: Column) -> Column:
    """One turn as rendered for ``speaker``."""
    named = F.when(turn.role == speaker, F.lit("assistant")).when(turn.role.isin(*NARRATORS), turn.role).otherwise(F.concat(F.lit("user name="), turn.role))
    return F.concat(F.lit(OPEN), named, F.lit("\n"), turn.text, F.lit(CLOSE), F.lit("\n"))


def _cut(rows: DataFrame) -> DataFrame:
    """Adds ``cut``, the position in the part by :data:`PART_TURNS`: 0 unless numbers are lost or repeated.

    Rows are range-partitioned in their order, numbered inside a partition and moved by what the partitions before hold,
    so a part of any size spreads.
    """
    order = ["conv_id", "part", "turn", "role", "text", "salt"]
    placed = written(rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("bucket", F.spark_partition_id()))
    counts = placed.groupBy("conv_id", "part", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id", "part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ahead = ahead.filter("ahead > 0").select(F.col("conv_id").alias("of"), F.col("part").alias("of_part"), F.col("bucket").alias("of_bucket"), "ahead")
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "conv_id", "part").orderBy(*order[2:])) - 1)
    met = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")) & (F.col("bucket") == F.col("of_bucket"))
    return numbered.join(ahead, met, "left").withColumn("cut", F.floor((F.col("at") + F.coalesce("ahead", F.lit(0))) / PART_TURNS)).drop("salt", "bucket", "of", "of_part", "of_bucket", "ahead", "at")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, speaker, part, start, n_turns, rendered, n_chars, targets): dialogues rendered for each participant.

    A dialogue comes in parts of at most 64 successive turn numbers; where numbers are lost or repeated, a part of
    more than 64 turns comes in several rows, so that no row grows with a conversation. ``start`` is the code point at which a part begins in the whole. ``targets`` lists the
    spans to train on, start:end in code points of the part: what the speaker says, with the closing mark.

    Turns are ordered by number, role and text; a missing number comes first, in a part of its own. A null role
    or text is empty, an empty role being called "unknown"; null conversation ids make one
    conversation. Repeated rows are repeated turns. Marks of the format inside a role or text are
    broken by a blank, so that no turn can forge another. A conversation of narrators alone has no
    perspective and no rows, as has an empty table.
    """
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    role = F.regexp_replace(safe(turns[role_col]), r"\s+", " ")
    number = F.coalesce(turns[turn_col].cast("long"), F.lit(-(1 << 62)))
    rows = turns.select(turns[conv_col].alias("conv_id"), number.alias("turn"), F.when(role == "", F.lit("unknown")).otherwise(role).alias("role"), safe(turns[text_col]).alias("text"))
    speakers = rows.filter(~F.col("role").isin(*NARRATORS)).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    parts = (_cut(rows.withColumn("part", F.shiftright("turn", PART_TURNS.bit_length() - 1))).groupBy("conv_id", "part", "cut")
             .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")))
    views = (parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
             .withColumn("pieces", F.transform("turns", lambda t: F.struct(_piece(t, F.col("speaker")).alias("text"), (t.role == F.col("speaker")).alias("own"))))
             .withColumn("rendered", F.array_join(F.transform("pieces", lambda p: p.text), "")))
    head = len(OPEN) + len("assistant\n")
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        end = acc.at + F.char_length(p.text)
        span = F.concat((acc.at + head).cast("string"), F.lit(":"), (end - 1).cast("string"))
        return F.struct(end.alias("at"), F.when(p.own, F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))

    told = (views.withColumn("n_turns", F.size("turns").cast("long")).withColumn("n_chars", F.char_length("rendered").cast("long"))
            .withColumn("targets", F.array_join(F.aggregate("pieces", empty, walk).spans, ",")))
    before = Window.partitionBy("conv_id", "speaker").orderBy("part", "cut").rowsBetween(Window.unboundedPreceding, -1)
    return told.withColumn("start", F.coalesce(F.sum("n_chars").over(before), F.lit(0))).select(
        "conv_id", "speaker", F.when(F.col("part") >= -(1 << 40), F.col("part")).alias("part"), "start", "n_turns", "rendered", "n_chars", "targets")
