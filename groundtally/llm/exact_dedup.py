"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtally.llm.common import lower_ascii, written

#: Slots of the tables of crowded keys, which are broadcast: at most so many longs, whatever the corpus.
LENGTH_SLOTS, PREFIX_SLOTS = 1 << 16, 1 << 19
PREFIX_CHARS = 96


def _crowded(keys: DataFrame, slots: int) -> DataFrame:
    """Slots that hold two rows or more; a row elsewhere has no equal. At most ``slots`` rows."""
    return keys.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("slot")


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False,
           prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(id, n_bytes, prefix_hash, full_hash, sha): hashes are null where an earlier step told the text apart.

    Each step's keys fall into a bounded number of slots; the crowded slots are broadcast, and the
    next step hashes only rows in them, so a full content is hashed only where length and prefix
    have both met before. With ``digest_all`` the digest of every text is returned as ``sha`` too.
    """
    text = lower_ascii(F.coalesce(F.col("t"), F.lit("")))
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    n_bytes = F.octet_length(F.coalesce(F.col("t"), F.lit("")))
    length_slot = F.pmod(F.xxhash64(F.col("n_bytes")), F.lit(LENGTH_SLOTS))
    prefix_hash = F.xxhash64(F.col("n_bytes"), lower_ascii(F.substring(F.coalesce(F.col("t"), F.lit("")), 1, prefix_chars)))
    prefix_slot = F.pmod(F.col("prefix_hash"), F.lit(PREFIX_SLOTS))

    lengths = written(_crowded(base.select(n_bytes.alias("n_bytes")).select(length_slot.alias("slot")), LENGTH_SLOTS))
    second = (base.withColumn("n_bytes", n_bytes).withColumn("slot", length_slot)
              .join(F.broadcast(lengths.withColumn("met_length", F.lit(True))), "slot", "left").drop("slot")
              .withColumn("prefix_hash", F.when(F.col("met_length"), prefix_hash)))
    prefixes = written(_crowded(second.filter("met_length").select(prefix_slot.alias("slot")), PREFIX_SLOTS))
    third = (second.withColumn("slot", prefix_slot)
             .join(F.broadcast(prefixes.withColumn("met_prefix", F.lit(True))), "slot", "left").drop("slot"))
    digest = F.sha2(F.encode(text, "UTF-8"), 256)
    if digest_all:
        third = third.withColumn("sha", digest).withColumn("full_hash", F.when(F.col("met_prefix"), F.col("sha")))
    else:
        third = third.withColumn("full_hash", F.when(F.col("met_prefix"), digest)).withColumn("sha", F.col("full_hash"))
    return third.select("id", "n_bytes", "prefix_hash", "full_hash", "sha")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False,
                prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, and the digest where one was made.

    Texts are equal when they are identical after lower-casing A-Z; the largest id of a group stays.
    Null and empty texts are equal to each other. Rows that repeat an id with an equal text are one
    group; just one of them has ``kept``. A null id is smaller than any other and stays only where no
    row of its group has an id. An empty table gives no rows. Other columns are not read, so
    their names are free.

    Equal rows are counted before they move, and a row joins its group's totals by key, so that a
    group of a third of all rows meets in no task.
    """
    keyed = written(refine(docs, id_col, text_col, digest_all, prefix_chars))
    key = ["n_bytes", "prefix_hash", "full_hash"]
    alone = keyed.filter("full_hash is null").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    met = keyed.filter("full_hash is not null")
    copies = met.groupBy(*key, "id", "sha").agg(F.count(F.lit(1)).alias("n"))
    groups = met.groupBy(*key).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    told = (copies.join(groups, key)
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
            .select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "sha"))
    return alone.unionByName(told)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with their columns.

    Rows meet their mark by one key of id and digest, and repeated rows are dropped in the same partitions.
    """
    key = lambda i, sha: F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), sha)
    marks = exact_dedup(docs, id_col, text_col, digest_all=True)
    kept = marks.filter("kept").select(key(F.col("id"), F.col("sha")).alias("doc_key"))
    digest: Column = F.sha2(F.encode(lower_ascii(F.coalesce(docs[text_col], F.lit(""))), "UTF-8"), 256)
    packed = docs.select(F.struct("*").alias("doc"), key(docs[id_col], digest).alias("doc_key"))
    return packed.join(kept, "doc_key", "left_semi").dropDuplicates(["doc_key"]).select("doc.*")
