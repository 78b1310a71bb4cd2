"""Queries B1-B12: ids, tasks, catalogue rules, sanitising, redaction and skeletons."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundtally.functions import dims, text
from groundtally.functions import fixed_values as V
from groundtally.operators import quality as Q
from groundtally.plans.sqlviews import ANNOTATIONS, PATCHES, chain, q
from groundtally.sources import fixture as fx


def b1(spark, sf):
    ids = fx.patches(spark, sf).select(F.when(F.col("country") == "MACHINERY", F.concat("patch_id", F.lit("x"))).otherwise(F.col("patch_id")).alias("patch_id"))
    return Q.parse_patch_ids(ids)


def b2(spark, sf):
    nation = fx.table(spark, sf, "customer").select((F.col("c_custkey") % 40).cast("int").alias("patch_id")).distinct()
    return Q.attach_coordinates(nation, fx.open_annotations(spark, sf))


def b3(spark, sf):
    ann = fx.open_annotations(spark, sf).withColumn("type", F.when(F.col("season") == "Winter", F.lit("mcq")).otherwise(F.col("type")))
    return Q.task_intents(ann).groupBy("task", "intent").agg(F.count("*").alias("n"))


def scenes(spark, sf):
    s = fx.table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("scene"), F.when(F.col("s_nationkey") % 7 != 0, F.concat(F.lit("EPSG:"), (32600 + F.col("s_nationkey") % 3).cast("string"))).alias("crs"),
        (F.col("s_nationkey") % 11 != 3).alias("rectilinear"), F.col("s_acctbal").alias("gsd_x"), F.floor(F.col("s_acctbal") / 1000).cast("double").alias("gsd_y"),
        (F.col("s_suppkey") % 14).cast("int").alias("band_count"), (F.lit(120) + F.col("s_nationkey") % 2).alias("height"), F.lit(120).alias("width"))


def b4(spark, sf):
    return Q.catalogue_checks(scenes(spark, sf), (120, 120)).select("scene", "modality", "check")


def b5(spark, sf):
    t = F.array(F.lit(10.0), F.lit(0.0), F.col("s_nationkey").cast("double"), F.lit(0.0), F.lit(-10.0),
                F.when(F.col("s_suppkey") % 5 == 0, F.lit(1e-9)).otherwise(F.lit(0.0)))
    pairs = fx.table(spark, sf, "supplier").select(
        (F.col("s_nationkey") * 10 + F.floor(F.col("s_acctbal") / 2000)).cast("long").alias("request"), F.col("s_suppkey").alias("scene"),
        (F.lit(120) + F.col("s_suppkey") % 2).alias("height"), F.lit(120).alias("width"),
        F.concat(F.lit("EPSG:"), (F.col("s_suppkey") % 3).cast("string")).alias("crs"), t.alias("transform"))
    return Q.pair_checks(pairs)


def b6(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_returnflag"), F.col("l_linestatus")).alias("scene"),
        F.col("l_tax").alias("value"), F.when(F.col("l_suppkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.lit(0.0)).alias("nodata"))
    return Q.nodata_flags(li)


def b7(spark, sf):
    d = fx.table(spark, sf, "documents")
    raw = F.concat(F.lit(" \u0007​"), F.regexp_replace("text", " ", "  \n"), F.lit(" "))
    clean = text.sanitise(raw)
    query = text.sanitise(raw, V.QUERY_LIMIT)
    return d.select("doc_id", F.length(clean).alias("n"), F.md5(clean).alias("digest"), F.length(query).alias("query_n"), (query != "").alias("accepted"))


def b8(spark, sf):
    d = fx.table(spark, sf, "documents")
    planted = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" AKIA"), F.upper(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16)))).otherwise(F.col("text"))
    token = F.regexp_extract("text", r'token = "([0-9a-f]{40})"', 1)
    fields = F.create_map(F.lit("text"), planted, F.lit("Api_Token"), token, F.lit("lang"), F.col("lang"))
    red = d.select("doc_id", text.redact_map(fields).alias("m"))
    return red.select("doc_id", F.md5(F.element_at("m", "text")).alias("text_digest"), (F.element_at("m", "text") == V.REDACTED).alias("masked"),
                      F.element_at("m", "Api_Token").alias("token_field"), F.element_at("m", "lang").alias("lang_field"))


def b9(spark, sf):
    p = fx.table(spark, sf, "pages")
    say = (F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/srv/app/data/"), F.col("page_id").cast("string")))
           .when(F.col("page_id") % 4 == 1, F.concat(F.lit("read /srv/app/maps/"), F.col("page_id").cast("string"), F.lit(" and /etc/x y configs/m.yaml from "), F.col("url")))
           .when(F.col("page_id") % 4 == 2, F.concat(F.lit("/etc/shadow "), F.col("url"))).otherwise(F.concat(F.lit("rel/path "), F.col("url"))))
    return p.select("page_id", text.redact_paths(say, "/srv/app").alias("redacted"))


def b10(spark, sf):
    return fx.open_annotations(spark, sf).groupBy(text.skeleton(F.col("input")).alias("skeleton")).agg(F.count("*").alias("n"))


def b11(spark, sf):
    return fx.open_annotations(spark, sf).groupBy(text.answer_bucket(F.col("output")).alias("answer")).agg(F.count("*").alias("n"))


def b12(spark, sf):
    d = fx.table(spark, sf, "documents")
    norm = text.normal_form(F.concat(F.lit("  "), "text", F.lit(".. ")))
    return d.select("doc_id", F.length(norm).alias("n"), F.md5(norm).alias("digest"))


QUERIES = {
    "B1_patch_id_parts": b1, "B2_first_coordinate": b2, "B3_task_intent": b3, "B4_catalogue_rules": b4, "B5_pair_rules": b5,
    "B6_nodata_flags": b6, "B7_sanitise": b7, "B8_redact_secrets": b8, "B9_redact_paths": b9, "B10_skeleton": b10,
    "B11_answer_bucket": b11, "B12_normal_form": b12,
}

_INTENT = "CASE " + " ".join(f"WHEN task = {q(k)} THEN {q(v)}" for k, v in V.TASK_INTENTS.items()) + " END"
_SECRET = "|".join(V.SECRET_VALUES)
_CLEAN = ("TRIM(REGEXP_REPLACE(REGEXP_REPLACE(' ' || CHR(7) || CHR(8203) || REPLACE(text, ' ', '  ' || CHR(10)) || CHR(57344) || ' ', "
          "'[\\p{Cc}\\p{Cf}\\p{Co}]', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))")
_PLANT = "CASE WHEN doc_id % 10 = 0 THEN text || ' AKIA' || UPPER(SUBSTR(MD5(doc_id::VARCHAR), 1, 16)) ELSE text END"
_NORM = ("REGEXP_REPLACE(REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(LOWER('  ' || text || '.. '), '^\\s+|\\s+$', '', 'g'), '\\.+$', ''), ',', ''), '\\s+', ' ', 'g')")

ORACLES = {
    "B1_patch_id_parts": chain(PATCHES) + "SELECT CASE WHEN bad THEN patch_id || 'x' ELSE patch_id END AS patch_id, CASE WHEN NOT bad THEN tile END AS tile, "
        "CASE WHEN NOT bad THEN row END AS row, CASE WHEN NOT bad THEN col END AS col FROM (SELECT *, country = 'MACHINERY' AS bad FROM patches)",
    "B2_first_coordinate": chain(ANNOTATIONS) + "SELECT p.patch_id, a.lat, a.lon FROM (SELECT DISTINCT CAST(c_custkey % 40 AS INT) AS patch_id FROM customer) p LEFT JOIN "
        "(SELECT patch_id, ARG_MIN(latitude, id) AS lat, ARG_MIN(longitude, id) AS lon FROM ann GROUP BY patch_id) a USING (patch_id)",
    "B3_task_intent": chain(ANNOTATIONS) + f"SELECT task, {_INTENT} AS intent, COUNT(*) AS n FROM (SELECT CASE WHEN season = 'Winter' THEN 'mcq' ELSE type END || '|' || category AS task FROM ann) GROUP BY task",
    "B4_catalogue_rules": "SELECT s_suppkey AS scene, CASE WHEN n = 2 THEN 'SAR' WHEN n IN (10, 12, 13) THEN 'OPTICAL' END AS modality, "
        "CASE WHEN s_nationkey % 7 = 0 THEN 'crs_present' WHEN s_nationkey % 11 = 3 THEN 'geotransform_present' "
        "WHEN s_acctbal = 0 OR FLOOR(s_acctbal / 1000) = 0 THEN 'gsd_positive' WHEN n NOT IN (2, 10, 12, 13) THEN 'modality_inference' "
        "WHEN s_nationkey % 2 = 1 THEN 'expected_shape' ELSE 'ok' END AS \"check\" FROM (SELECT *, s_suppkey % 14 AS n FROM supplier)",
    "B5_pair_rules": "WITH s AS (SELECT CAST(s_nationkey * 10 + FLOOR(s_acctbal / 2000) AS BIGINT) AS request, * FROM supplier), "
        "g AS (SELECT request, COUNT(*) AS n_inputs, MIN(s_suppkey) AS a, MAX(s_suppkey) AS b FROM s GROUP BY request) "
        "SELECT g.request, n_inputs, CASE WHEN n_inputs > 2 THEN 'input_count' WHEN n_inputs = 1 THEN 'ok' WHEN x.s_suppkey % 2 <> y.s_suppkey % 2 THEN 'pair_shape' "
        "WHEN x.s_suppkey % 3 <> y.s_suppkey % 3 THEN 'pair_crs' WHEN x.s_nationkey <> y.s_nationkey THEN 'pair_co_registration' ELSE 'ok' END AS \"check\" "
        "FROM g JOIN supplier x ON x.s_suppkey = g.a JOIN supplier y ON y.s_suppkey = g.b",
    "B6_nodata_flags": "SELECT l_suppkey || '-' || l_linenumber || '-' || l_returnflag || '-' || l_linestatus AS scene, "
        "BOOL_AND(l_suppkey % 9 <> 0 AND l_tax = 0) AS all_nodata, BOOL_OR(l_suppkey % 9 = 0) AS nan_nodata, COUNT(*) AS n_values FROM lineitem GROUP BY scene",
    "B7_sanitise": f"SELECT doc_id, LENGTH(c) AS n, MD5(c) AS digest, LENGTH(r) AS query_n, r <> '' AS accepted FROM (SELECT doc_id, LEFT({_CLEAN}, 512) AS c, LEFT({_CLEAN}, 4096) AS r FROM documents)",
    "B8_redact_secrets": f"SELECT doc_id, MD5(CASE WHEN hit THEN '***REDACTED***' ELSE t END) AS text_digest, hit AS masked, '***REDACTED***' AS token_field, lang AS lang_field "
        f"FROM (SELECT doc_id, lang, t, REGEXP_MATCHES(t, {q(_SECRET)}) AS hit FROM (SELECT doc_id, lang, {_PLANT} AS t FROM documents))",
    "B9_redact_paths": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'data/' || page_id WHEN 1 THEN 'read maps/' || page_id || ' and <external-path> y configs/m.yaml from ' || "
        "REGEXP_REPLACE(url, '[A-Za-z]:[\\\\/][^\\n\\r\"''<>|*?]*', '<external-path>', 'g') "
        "WHEN 2 THEN '<external-path>' ELSE 'rel/path ' || REGEXP_REPLACE(url, '[A-Za-z]:[\\\\/][^\\n\\r\"''<>|*?]*', '<external-path>', 'g') END AS redacted FROM pages",
    "B10_skeleton": chain(ANNOTATIONS) + "SELECT REGEXP_REPLACE(input, '\\d[\\d,\\.]*', '<N>', 'g') AS skeleton, COUNT(*) AS n FROM ann GROUP BY skeleton",
    "B11_answer_bucket": chain(ANNOTATIONS) + "SELECT CASE WHEN LENGTH(output) < 40 THEN output ELSE '<LONG>' END AS answer, COUNT(*) AS n FROM ann GROUP BY answer",
    "B12_normal_form": f"SELECT doc_id, LENGTH({_NORM}) AS n, MD5({_NORM}) AS digest FROM documents",
}
