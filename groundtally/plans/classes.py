"""Queries C1-C11: the class nomenclature over whole pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundtally.functions import dims, questions
from groundtally.functions import fixed_values as V
from groundtally.operators import taxonomy as X
from groundtally.plans.sqlviews import ANNOTATIONS, C19, PIXELS, TAX, chain, q, values
from groundtally.sources import fixture as fx

FOREIGN = sorted(V.WORLDCOVER_COARSE7)


def c1(spark, sf):
    return X.nomenclature_audit(fx.pixels(spark, sf))


def c2(spark, sf):
    idx = X.codes_to_indices(fx.pixels(spark, sf))
    back = X.indices_to_codes(idx.drop("code"))
    return back.groupBy("idx", "code").agg(F.count("*").alias("n_px"))


def c3(spark, sf):
    return X.level_counts(fx.pixels(spark, sf), dims.LEVELS)


def c4(spark, sf):
    px = fx.pixels(spark, sf)
    masks = X.class_mask(px, "Arable land").unionByName(X.class_mask(px, "11", "l2")).unionByName(X.class_mask(px, "wetland", "coarse7"))
    return masks.groupBy("patch_id", "cls").agg(F.count("*").alias("n_px"), F.sum(F.col("row") * 1000 + F.col("col")).alias("where_sum"))


def _asked(*pairs):
    return F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), c.alias("query")) for lv, c in pairs])).alias("a")


def c5(spark, sf):
    code = F.col("code")
    codes = fx.pixels(spark, sf).select("code").distinct()
    per = codes.select(_asked(
        ("l3", code.cast("string")), ("l2", F.floor(code / 10).cast("string")),
        ("l1", F.floor(code / 100).cast("string")), ("l3", (code % 50).cast("string")))).select("a.*")
    names = fx.open_annotations(spark, sf).select(F.explode(questions.mentions(F.col("input"))).alias("name")).distinct()
    named = names.select(_asked(("c19", F.col("name")), ("c19", F.upper("name")), ("l2", F.upper("name")),
                                ("l3", F.upper("name")))).select("a.*")
    return X.resolve_queries(per.unionByName(named).distinct())


def c6(spark, sf):
    return X.relatives(fx.pixels(spark, sf))


def c7(spark, sf):
    px = fx.pixels(spark, sf).filter(F.col("code") != V.UNCLASSIFIED_CODE)
    other = px.select(((F.col("patch_id") + 1) % 25).alias("patch_id"), "row", "col", F.col("code").alias("predicted"))
    return X.confusion_cost(px.withColumnRenamed("code", "truth").join(other, ["patch_id", "row", "col"]))


def c8(spark, sf):
    px = fx.pixels(spark, sf)
    codes = dims.literal_array(FOREIGN)
    foreign = px.select("patch_id", "row", "col", F.get(codes, (F.col("row") + F.col("code")) % len(FOREIGN)).alias("value"))
    return X.coarse_comparison(px, foreign)


def c9(spark, sf):
    form = F.regexp_extract("input", r"(?i)(?:regions of|patches of|any|areas of|does) ([^?]*?)(?: cover.*| in the.*| occupy.*| and .*)?\?", 1)
    asked = fx.open_annotations(spark, sf).select(form.alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    return X.resolve_forms(asked)


def c10(spark, sf):
    return X.class_inventory(fx.pixels(spark, sf))


def c11(spark, sf):
    px = fx.pixels(spark, sf)
    labels = fx.open_annotations(spark, sf).select(
        "patch_id", F.explode(questions.mentions(F.col("input"))).alias("label"))
    return X.mine_mapping(px, labels)


QUERIES = {
    "C1_nomenclature_audit": c1, "C2_code_index": c2, "C3_to_level": c3, "C4_class_mask": c4, "C5_resolve_query": c5,
    "C6_relatives": c6, "C7_confusion_cost": c7, "C8_foreign_scheme": c8, "C9_synonyms": c9, "C10_class_inventory": c10,
    "C11_mined_mapping": c11,
}

RES = "res AS " + values(X.resolution_rows(), "level, k, target")
FORMS = "forms AS " + values([(f, c, o, a) for f, c, o, a in dims.surface_forms()], "form, canonical, observed, approximate")
WC = "wc AS " + values(list(V.WORLDCOVER_COARSE7.items()), "value, coarse7")
_PAT = dims.mention_pattern()
FORM_MAP = ("MAP([" + ", ".join(q(f) for f, *_ in dims.surface_forms()) + "], [" + ", ".join(q(c) for _, c, *_ in dims.surface_forms()) + "])")


def mentions_sql(col):
    return (f"LIST_TRANSFORM(REGEXP_EXTRACT_ALL(LOWER({col}), {q(_PAT)}), lambda x: {FORM_MAP}[REGEXP_REPLACE(x, '[,\\s]+', ' ', 'g')])")


_C9 = ("REGEXP_EXTRACT(input, '(?i)(?:regions of|patches of|any|areas of|does) ([^?]*?)(?: cover.*| in the.*| occupy.*| and .*)?\\?', 1)")
_COL = {"l1": "l1", "l2": "l2", "l3": "idx", "c19": "c19_id", "coarse7": "coarse7_id"}

ORACLES = {
    "C1_nomenclature_audit": chain(TAX, PIXELS) + "SELECT p.code, p.n_px, COALESCE(t.idx, -2) AS idx, COALESCE(p.code // 10 = t.l2, p.code = 999) AS l3_nested, "
        "COALESCE(t.l2 // 10 = t.l1, p.code = 999) AS l2_nested, TRUE AS parents_known FROM (SELECT code, COUNT(*) AS n_px FROM pixels GROUP BY code) p LEFT JOIN tax t USING (code)",
    "C2_code_index": chain(TAX, PIXELS) + "SELECT COALESCE(t.idx, -2) AS idx, p.code, COUNT(*) AS n_px FROM pixels p LEFT JOIN tax t USING (code) GROUP BY ALL",
    "C3_to_level": chain(TAX, PIXELS) + " UNION ALL ".join(
        f"SELECT p.patch_id, COALESCE(t.{c}, -2) AS cls, COUNT(*) AS n_px, '{lv}' AS level FROM pixels p LEFT JOIN tax t USING (code) GROUP BY ALL" for lv, c in _COL.items()),
    "C4_class_mask": chain(TAX, PIXELS) + " UNION ALL ".join(
        f"SELECT patch_id, {c} AS cls, COUNT(*) AS n_px, CAST(SUM(row * 1000 + col) AS BIGINT) AS where_sum FROM pixels JOIN tax USING (code) WHERE {w} GROUP BY ALL"
        for c, w in (("c19_id", "c19 = 'Arable land'"), ("l2", "l2 = 11"), ("coarse7_id", "coarse7 = 'wetland'"))),
    "C5_resolve_query": chain(TAX, PIXELS, RES, FORMS, ANNOTATIONS,
        "asked AS (SELECT 'l3' AS level, code::VARCHAR AS query FROM pixels UNION SELECT 'l2', (code // 10)::VARCHAR FROM pixels UNION SELECT 'l1', (code // 100)::VARCHAR FROM pixels "
        "UNION SELECT 'l3', (code % 50)::VARCHAR FROM pixels UNION SELECT 'c19', n FROM nm UNION SELECT 'c19', UPPER(n) FROM nm UNION SELECT 'l2', UPPER(n) FROM nm UNION SELECT 'l3', UPPER(n) FROM nm)"
        ).replace("asked AS", f"nm AS (SELECT DISTINCT UNNEST({mentions_sql('input')}) AS n FROM ann), asked AS") +
        "SELECT a.level, a.query, r.target FROM asked a LEFT JOIN res r ON r.level = a.level AND r.k = CASE WHEN a.level IN ('c19', 'coarse7') THEN TRIM(a.query) ELSE LOWER(TRIM(a.query)) END",
    "C6_relatives": chain(TAX, PIXELS) + "SELECT m.code, p.n_px, COALESCE(STRING_AGG(o.code::VARCHAR, ',' ORDER BY o.code) FILTER (o.l2 = m.l2 AND o.code <> m.code), '') AS siblings, "
        "STRING_AGG(o.code::VARCHAR, ',' ORDER BY o.code) AS branch FROM (SELECT code, COUNT(*) AS n_px FROM pixels GROUP BY code) p JOIN tax m USING (code) JOIN tax o ON o.l1 = m.l1 GROUP BY m.code, p.n_px",
    "C7_confusion_cost": chain(TAX, PIXELS) + "SELECT *, penalty * n AS cost FROM (SELECT a.code AS truth, b.code AS predicted, COUNT(*) AS n, CAST(CASE WHEN a.code = b.code THEN 0 "
        "WHEN ANY_VALUE(x.l1) = ANY_VALUE(y.l1) THEN 1 ELSE 1.5 END AS DOUBLE) AS penalty FROM pixels a JOIN pixels b ON a.patch_id = (b.patch_id + 1) % 25 AND a.row = b.row AND a.col = b.col "
        "JOIN tax x ON x.code = a.code JOIN tax y ON y.code = b.code GROUP BY a.code, b.code)",
    "C8_foreign_scheme": chain(TAX, PIXELS, WC) + f"SELECT coarse7, COALESCE(a.n, 0) AS corine_px, COALESCE(b.n, 0) AS foreign_px FROM (SELECT coarse7, COUNT(*) AS n FROM pixels JOIN tax USING (code) GROUP BY 1) a "
        f"FULL JOIN (SELECT coarse7, COUNT(*) AS n FROM (SELECT ({FOREIGN})[(row + code) % {len(FOREIGN)} + 1] AS value FROM pixels) JOIN wc USING (value) GROUP BY 1) b USING (coarse7)",
    "C9_synonyms": chain(FORMS, ANNOTATIONS) + f"SELECT a.form, a.n, f.canonical, f.observed, f.approximate FROM (SELECT {_C9} AS form, COUNT(*) AS n FROM ann GROUP BY 1) a "
        "LEFT JOIN forms f ON f.form = REGEXP_REPLACE(REPLACE(REGEXP_REPLACE(TRIM(LOWER(a.form)), '\\.+$', ''), ',', ''), '\\s+', ' ', 'g')",
    "C10_class_inventory": chain(TAX, PIXELS) + "SELECT code, COUNT(*) AS n_px, COUNT(DISTINCT patch_id) AS n_patches, COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM pixels) AS px_share, "
        "COUNT(DISTINCT patch_id)::DOUBLE / (SELECT COUNT(DISTINCT patch_id) FROM pixels) AS patch_share FROM pixels GROUP BY code",
    "C11_mined_mapping": chain(TAX, PIXELS, FORMS, ANNOTATIONS, f"lb AS (SELECT DISTINCT patch_id, UNNEST({mentions_sql('input')}) AS label FROM ann)",
        "pc AS (SELECT DISTINCT patch_id, code FROM pixels)", "sup AS (SELECT code, COUNT(*) AS support FROM pc WHERE patch_id IN (SELECT patch_id FROM lb) GROUP BY code)") +
        "SELECT code, rank, label, n, support, n::DOUBLE / support AS confidence FROM (SELECT code, label, COUNT(*) AS n, CAST(ROW_NUMBER() OVER (PARTITION BY code ORDER BY COUNT(*) DESC, label) AS INT) AS rank "
        "FROM pc JOIN lb USING (patch_id) GROUP BY code, label) JOIN sup USING (code) WHERE rank <= 3",
}
