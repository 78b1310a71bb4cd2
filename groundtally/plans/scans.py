"""Queries A1-A14: scans, guards, harvests, sinks and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from groundtally.functions import fixed_values as V
from groundtally.plans.sqlviews import ANNOTATIONS, PATCHES, PIXELS, TAX, chain
from groundtally.session import ensure_checkpoint_dir
from groundtally.sources import files as D
from groundtally.sources import fixture as fx
from groundtally.sources import tables as T

PROJECTED = ["id", "patch_id", "type", "category", "split"]


def scratch(spark, name):
    """A fresh folder beside the checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def a1(spark, sf):
    return T.scan_annotations(fx.annotations(spark, sf), PROJECTED)


def a2(spark, sf):
    ann = fx.annotations(spark, sf)
    refused = []
    for split in (*V.OPEN_SPLITS, V.SEALED_SPLIT):
        try:
            T.scan_annotations(ann, splits=(split,))
        except T.SealedSplitError:
            refused.append(split)
    return ann.groupBy("split").agg(F.count("*").alias("n_rows")).withColumn("refused", F.col("split").isin(*refused))


def a3(spark, sf):
    df = T.assert_unsealed(T.scan_annotations(fx.annotations(spark, sf)))
    return df.groupBy("split", "type").agg(F.count("*").alias("n_rows"))


def a4(spark, sf):
    return T.scan_annotations(fx.annotations(spark, sf))


def a5(spark, sf):
    return T.split_audit(fx.annotations(spark, sf))


def with_task(df):
    return df.withColumn("task", F.concat_ws("|", "type", "category"))


def a6(spark, sf):
    return T.quota_harvest(with_task(fx.open_annotations(spark, sf)), ["task"], "id", 40, 10).select("task", "rn", "id")


def a7(spark, sf):
    ann = fx.open_annotations(spark, sf)
    folds = ann.select("patch_id").distinct().withColumn("fold", F.col("patch_id") % 5)
    return T.fold_quota_harvest(ann, folds, "id", 400, 5).select("fold", "rn", "id", "patch_id")


def a8(spark, sf):
    tile = F.concat(F.lit("T"), (10 + F.col("patch_id") % 5).cast("string"), F.lit("ABC"))
    path = scratch(spark, "maps")
    T.write_class_maps(fx.pixels(spark, sf).withColumn("tile", tile), path)
    maps = T.read_class_maps(spark, path, [f"T{10 + i}ABC" for i in range(5)])
    return maps.groupBy("tile", "patch_id").agg(F.count("*").alias("n_px"), F.sum("code").alias("code_sum"))


def a9(spark, sf):
    back = T.to_long(T.to_dense(fx.pixels(spark, sf)))
    return back.groupBy("patch_id").agg(
        F.count("*").alias("n_px"), F.sum(F.col("code") * (F.col("col") + 1)).alias("weighted"))


def a10(spark, sf):
    p = fx.patches(spark, sf)
    incoming = p.select(F.when(F.col("country") == "MACHINERY", F.concat(F.lit("X_"), "patch_id", F.lit("_x"))).otherwise(F.col("patch_id")).alias("patch_id"))
    return T.pending_ingest(incoming, p.filter(F.col("country") == "BUILDING"))


#: Bytes of html in a file, about, and the least number of files; bytes of a range.
FILE_BYTES, LEAST_FILES, PAGE_RANGE = 4 << 20, 8, 1 << 16


def a11(spark, sf):
    """Pages go to text files of some MB; the files are read back by ranges and held against a manifest with planted faults.

    The manifest's digests are made of the table's rows as they pass, in the order in which they are written.
    """
    pages = fx.table(spark, sf, "pages").select(F.coalesce("page_id", F.lit(0)).alias("page_id"), F.coalesce("html", F.lit("")).alias("html"))
    total = pages.agg((F.max("page_id") + 1).alias("ids"), F.sum(F.octet_length("html")).alias("bytes")).select(
        F.ceil(F.col("ids") / F.greatest(F.lit(LEAST_FILES), F.ceil(F.col("bytes") / FILE_BYTES))).cast("long").alias("run"))
    shard = F.floor(F.col("page_id") / F.col("run")).cast("long")
    dealt = pages.crossJoin(F.broadcast(total)).withColumn("shard", shard).select("shard", "page_id", F.col("html").alias("line"))  # one row of totals
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "page_id", "line")
    path = scratch(spark, "pages")
    dealt.select("shard", "line").write.partitionBy("shard").text(path)
    per = D.stream_digests(dealt.select(F.concat(F.lit("shard="), F.col("shard").cast("string")).alias("name"), "line"), range_bytes=PAGE_RANGE)
    number = F.substring_index("name", "=", -1).cast("long") % 8
    faulty = per.select("name", F.when(number == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
                        F.when(number == 3, F.md5("name")).otherwise(F.col("digest")).alias("digest")).filter(number != 5)
    lost = spark.range(1).select(F.lit("shard=lost").alias("name"), F.lit(1).cast("long").alias("size"), F.md5(F.lit("lost")).alias("digest"))
    return D.verify_digests(D.file_digests(spark, path, range_bytes=PAGE_RANGE), faulty.unionByName(lost))


def tile_folds(spark, sf):
    return fx.patches(spark, sf).select(
        "patch_id", F.col("tile").alias("block"), (F.substring("tile", 2, 2).cast("int") % 5).alias("fold"))


def a12(spark, sf):
    path = scratch(spark, "manifest")
    T.write_manifest(tile_folds(spark, sf), path)
    whole = T.manifest_summary(T.read_manifest(spark, path), "s2_tile", 5, 1337)
    cut = whole.select(F.substring("summary", 1, 25).alias("summary"))
    return T.read_manifest_summary(whole.unionByName(cut))


TRACKED = {"part": ["p_partkey", "p_name", "p_size"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus"]}


def a13(spark, sf):
    out = None
    for name, cols in TRACKED.items():
        df = fx.table(spark, sf, name)
        now = T.fingerprint(df, cols).withColumn("source", F.lit(name))
        then = T.fingerprint(df, cols[:2] if name == "part" else cols).select(F.col("digest_sum").alias("recorded"))
        row = now.join(F.broadcast(then)).select("source", "n_rows", "digest_sum", (F.col("digest_sum") != F.col("recorded")).alias("stale"))
        out = row if out is None else out.unionByName(row)
    return out


def a14(spark, sf):
    return T.sample_hash(fx.patches(spark, sf), "country", "patch_id")


QUERIES = {
    "A1_annotation_scan": a1, "A2_sealed_guard": a2, "A3_leak_assertion": a3, "A4_full_load": a4,
    "A5_quarantine_audit": a5, "A6_quota_harvest": a6, "A7_fold_quota_harvest": a7, "A8_class_map_source": a8,
    "A9_dense_long": a9, "A10_resumable_ingest": a10, "A11_integrity_check": a11, "A12_split_manifest": a12,
    "A13_input_fingerprint": a13, "A14_sample_hash": a14,
}


def _hex(text):
    return f"('0x' || SUBSTR(MD5({text}), 1, 15))::BIGINT"


def _fp(name, cols):
    text = " || '|' || ".join(f"COALESCE({c}::VARCHAR, '<null>')" for c in cols)
    return f"(SELECT CAST(SUM({_hex(text)}) AS VARCHAR) FROM {name})"


ORACLES = {
    "A1_annotation_scan": chain(ANNOTATIONS) + "SELECT id, patch_id, type, category, split FROM ann",
    "A2_sealed_guard": chain(ANNOTATIONS) + "SELECT split, COUNT(*) AS n_rows, split = 'bench' AS refused FROM ann_all GROUP BY split",
    "A3_leak_assertion": chain(ANNOTATIONS) + "SELECT split, type, COUNT(*) AS n_rows FROM ann GROUP BY split, type",
    "A4_full_load": chain(ANNOTATIONS) + "SELECT * FROM ann",
    "A5_quarantine_audit": chain(ANNOTATIONS) + "SELECT split, COUNT(*) AS n_rows, split IN ('train', 'validation') AS permitted FROM ann_all GROUP BY split",
    "A6_quota_harvest": chain(ANNOTATIONS) + "SELECT task, rn, id FROM (SELECT type || '|' || category AS task, id, CAST(ROW_NUMBER() OVER "
        "(PARTITION BY type, category ORDER BY id) AS INT) AS rn FROM ann) WHERE rn BETWEEN 11 AND 50",
    "A7_fold_quota_harvest": chain(ANNOTATIONS) + "SELECT fold, rn, id, patch_id FROM (SELECT patch_id % 5 AS fold, id, patch_id, CAST(ROW_NUMBER() OVER "
        "(PARTITION BY patch_id % 5 ORDER BY id) AS INT) AS rn FROM ann) WHERE rn <= 80",
    "A8_class_map_source": chain(TAX, PIXELS) + "SELECT 'T' || (10 + patch_id % 5) || 'ABC' AS tile, patch_id, COUNT(*) AS n_px, "
        "CAST(SUM(code) AS BIGINT) AS code_sum FROM pixels GROUP BY ALL",
    "A9_dense_long": chain(TAX, PIXELS) + "SELECT patch_id, COUNT(*) AS n_px, CAST(SUM(code * (col + 1)) AS BIGINT) AS weighted FROM pixels GROUP BY patch_id",
    "A10_resumable_ingest": chain(PATCHES) + "SELECT patch_id, CASE WHEN country <> 'MACHINERY' THEN tile END AS tile, CASE WHEN country = 'MACHINERY' THEN 'no_tile' "
        "WHEN country = 'BUILDING' THEN 'stored' ELSE 'new' END AS status FROM (SELECT CASE WHEN country = 'MACHINERY' THEN 'X_' || patch_id || '_x' "
        "ELSE patch_id END AS patch_id, tile, country FROM patches)",
    "A11_integrity_check": f"WITH t AS (SELECT CAST(CEIL((MAX(page_id) + 1) / GREATEST({LEAST_FILES}, CEIL(SUM(STRLEN(COALESCE(html, ''))) / {FILE_BYTES}))) AS BIGINT) AS run FROM pages), "
        "s AS (SELECT page_id // run AS shard, HEX(ENCODE(STRING_AGG(COALESCE(html, '') || CHR(10), '' ORDER BY page_id))) AS h FROM pages, t GROUP BY shard), "
        f"r AS (SELECT shard, LEN(h) // 2 AS size, UNNEST(RANGE(0, LEN(h), {2 * PAGE_RANGE})) AS pos, h FROM s), "
        f"d AS (SELECT shard, size, pos, MD5(UNHEX(SUBSTR(h, pos + 1, {2 * PAGE_RANGE}))) AS leaf FROM r), "
        "f AS (SELECT shard, size, COUNT(*) AS n_ranges, CASE COUNT(*) WHEN 1 THEN MIN(leaf) ELSE MD5(STRING_AGG(leaf, '' ORDER BY pos)) END AS digest FROM d GROUP BY shard, size) "
        "SELECT 'shard=' || shard AS name, size, n_ranges, digest, CASE shard % 8 WHEN 2 THEN 'size_mismatch' WHEN 3 THEN 'digest_mismatch' WHEN 5 THEN 'unlisted' ELSE 'ok' END AS status FROM f "
        "UNION ALL SELECT 'shard=lost', NULL, NULL, NULL, 'missing'",
    "A12_split_manifest": chain(PATCHES, "f AS (SELECT patch_id, tile, CAST(SUBSTR(tile, 2, 2) AS INT) % 5 AS fold FROM patches)") +
        "SELECT 's2_tile' AS strategy, 5 AS k, 1337 AS seed, (SELECT COUNT(DISTINCT tile) FROM f) AS block_count, COUNT(*) AS n_patches, "
        "(SELECT STRING_AGG(n::VARCHAR, ',' ORDER BY fold) FROM (SELECT fold, COUNT(*) AS n FROM f GROUP BY fold)) AS fold_sizes, '' AS error FROM f "
        "UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'split manifest is malformed'",
    "A13_input_fingerprint": " UNION ALL ".join(
        f"SELECT '{n}' AS source, (SELECT COUNT(*) FROM {n}) AS n_rows, {_fp(n, c)} AS digest_sum, "
        f"{_fp(n, c)} <> {_fp(n, c[:2] if n == 'part' else c)} AS stale" for n, c in TRACKED.items()),
    "A14_sample_hash": chain(PATCHES, "b0 AS (SELECT country, SUBSTR(MD5(patch_id), 1, 4) AS p, SHA256(STRING_AGG(patch_id, '' ORDER BY patch_id)) AS h, COUNT(*) AS n FROM patches GROUP BY ALL)",
        "b1 AS (SELECT country, SUBSTR(p, 1, 2) AS q, SHA256(STRING_AGG(h, '' ORDER BY p)) AS h, SUM(n) AS n FROM b0 GROUP BY ALL)") +
        "SELECT country, SHA256(STRING_AGG(h, '' ORDER BY q)) AS hash, CAST(SUM(n) AS BIGINT) AS n_samples FROM b1 GROUP BY country",
}
