"""Queries E1-E19: reading questions, and the text classifiers behind the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundtally.functions import fixed_values as V
from groundtally.functions import questions as Q
from groundtally.operators import classify
from groundtally.plans.questionsql import (DIRECTION, INTENT, RULE, SPEC, TASKSPEC, area_sql, cmp_sql, count_sql, gap_sql, grp, num, ordered, qual_sql,
                                           raw_mentions, rx)
from groundtally.plans.questionsql import SUB
from groundtally.plans.sqlviews import ANNOTATIONS, chain, first_hit, q
from groundtally.session import cut_lineage
from groundtally.sources import fixture as fx

def I() -> Column:  # noqa: E743
    """The question text; a function, so that importing needs no session."""
    return F.col("input")



def ask(spark, sf):
    return fx.open_annotations(spark, sf)


def shown(options):
    return F.array_join(F.transform(options, lambda o: F.concat(o["letter"], F.lit("="), o["text"])), "|")


def e1(spark, sf):
    return ask(spark, sf).select("id", Q.stem(I()).alias("stem"), Q.option_text(I()).alias("segment"))


def e2(spark, sf):
    o = Q.options_of(Q.option_text(I()))
    return ask(spark, sf).select("id", shown(o).alias("options"), (F.size(o) == 4).alias("is_mcq"))


def e3(spark, sf):
    return ask(spark, sf).select("id", F.array_join(Q.mentions(I()), "; ").alias("whole_word"), F.array_join(Q.mentions(I(), "substring"), "; ").alias("substring"))


def e4(spark, sf):
    return ask(spark, sf).select("id", Q.mask_classes(Q.stem(I())).alias("cue"))


def e5(spark, sf):
    return ask(spark, sf).select(
        "id", F.regexp_extract(I(), V.POINT_TAG, 1).try_cast("double").alias("x"), F.regexp_extract(I(), V.POINT_TAG, 2).try_cast("double").alias("y"),
        F.regexp_extract(I(), V.REF_TAG, 1).alias("ref"))


def e6(spark, sf):
    d = ask(spark, sf).withColumns({"cue": Q.mask_classes(Q.stem(I())), "is_mcq": F.size(Q.options_of(Q.option_text(I()))) == 4})
    return d.select("id", Q.intent_rule(F.col("cue"), F.col("is_mcq")).alias("h")).select("id", "h.intent", "h.rule")


def e7(spark, sf):
    return Q.parse(ask(spark, sf)).groupBy("type", "category", "answer_format").agg(F.count("*").alias("n"))


def e8(spark, sf):
    return ask(spark, sf).select("id", Q.stated_area(I()).alias("s")).select("id", "s.raw", "s.unit", "s.value", "s.as_percent")


def e9(spark, sf):
    return ask(spark, sf).select("id", Q.stated_count(I()).alias("s")).select("id", "s.raw", "s.value")


def e10(spark, sf):
    return ask(spark, sf).select("id", Q.comparator(I()).alias("free"), Q.comparator(I(), V.TASK_COMPARATORS).alias("by_task"))


def e11(spark, sf):
    return ask(spark, sf).select("id", Q._number(Q._group(I(), V.BETWEEN_RANGE, 1)).alias("lo"), Q._number(Q._group(I(), V.BETWEEN_RANGE, 2)).alias("hi"))


def e12(spark, sf):
    return ask(spark, sf).select("id", Q.qualifier(I()).alias("qualifier"))


def e13(spark, sf):
    return ask(spark, sf).select("id", I().rlike(V.COMPLEMENT_CUE).alias("complement"), I().rlike(V.NEGATION_CUE).alias("negated"),
                                 I().rlike(V.TASK_ONLY_ONE).alias("only_one"), I().rlike(V.TASK_MULTIPLE).alias("multiple"))


def e14(spark, sf):
    s = Q.parse(ask(spark, sf))
    return s.select("id", "type", "category", "intent", "answer_format", "class_a", "class_b", "qualifier", "comparator",
                    F.col("stated_value.raw").alias("stated_raw"), F.col("stated_value.unit").alias("stated_unit"), F.col("stated_value.value").alias("stated_number"),
                    F.col("stated_value.as_percent").alias("stated_percent"), F.col("stated_upper.value").alias("upper_number"),
                    F.col("stated_upper.as_percent").alias("upper_percent"), "negated", "point_x", "point_y", "matched_rule",
                    shown(F.col("options")).alias("options"), "reason")


TASK_FIELDS = ["reason", "comparator", "range_lo", "range_hi", "threshold_pct", "threshold_n", "complement", "only_one", "multiple", "is_m2_unit"]


def e15(spark, sf):
    return Q.parse_for_task(ask(spark, sf)).select("id", F.array_join("classes", "; ").alias("classes"), *TASK_FIELDS)


def e16(spark, sf):
    o = ask(spark, sf).filter(F.col("category") == "relative pos").select("id", F.explode(Q.options_of(Q.task_segment(I()))).alias("o"))
    from groundtally.functions.geometry import angular_gap
    return o.select("id", "o.letter", Q.option_direction(F.col("o.text")).alias("direction")).withColumn("gap_to_north", angular_gap(F.col("direction"), F.lit("N")))


def e17(spark, sf):
    return ask(spark, sf).select("id", Q.subject_is_second(I()).alias("subject_second"), Q.template_family(I()).alias("family"))


def rule_reading(spark, sf):
    """What the rules make of each question: an intent, or the reason why they decline."""
    return Q.parse(ask(spark, sf)).select("id", "intent", "reason", F.col("reason").isNull().alias("parsed"))


def e18(spark, sf):
    """Fit on every train question with a known task, score the validation questions."""
    from groundtally.operators.quality import task_intents
    d = task_intents(ask(spark, sf)).filter("intent is not null").select("id", "split", "input", "intent")
    model = classify.fit(d.filter(F.col("split") == "train"), "input", "intent")
    return model.predict(d.filter(F.col("split") == "validation"), "input").select("id", "intent", "predicted")


def e18_combined(spark, sf):
    """Rules first, the classifier on what they decline, and both together, over the validation questions."""
    from groundtally.operators.quality import task_intents
    d = task_intents(ask(spark, sf)).filter("intent is not null").select("id", "split", "input", F.col("intent").alias("truth"))
    model = classify.fit(d.filter(F.col("split") == "train"), "input", "truth")
    spec = cut_lineage(rule_reading(spark, sf)).join(d.filter(F.col("split") == "validation"), "id")
    residue = model.predict(spec.filter("not parsed").select("id", "input", "truth"), "input").agg(
        F.count("*").alias("n_residue"), F.count_if(F.col("predicted") == F.col("truth")).alias("residue_right"))
    rules = spec.agg(F.count("*").alias("n"), F.count_if("parsed").alias("n_parsed"), F.count_if(F.col("parsed") & (F.col("intent") == F.col("truth"))).alias("rules_right"))
    both = rules.join(F.broadcast(residue))  # one row each
    return both.withColumn("combined", F.try_divide(F.col("rules_right") + F.col("residue_right"), F.col("n")))


def e18_residue(spark, sf):
    """What the rules decline of the validation questions, and why: the classifier's share of the work."""
    split = ask(spark, sf).filter(F.col("split") == "validation").select("id")
    return rule_reading(spark, sf).join(split, "id").groupBy("reason").agg(F.count("*").alias("n"))


def e19(spark, sf):
    return classify.term_weights(fx.table(spark, sf, "documents"), "doc_id", "text")


QUERIES = {
    "E1_stem_options": e1, "E2_mcq_options": e2, "E3_class_mentions": e3, "E4_masked_cue": e4, "E5_tags": e5, "E6_intent_cascade": e6,
    "E7_answer_format": e7, "E8_stated_area": e8, "E9_stated_count": e9, "E10_comparator": e10, "E11_between": e11, "E12_qualifier": e12,
    "E13_flags": e13, "E14_query_spec": e14, "E15_task_parse": e15, "E16_option_direction": e16, "E17_template_family": e17,
    "E18_intent_classifier": e18, "E18_combined": e18_combined, "E18_rule_residue": e18_residue, "E19_tfidf": e19,
}

S3 = chain(ANNOTATIONS, *SPEC[:4])
_AR, _CT = area_sql("input"), count_sql("input")
_OPTS = "ARRAY_TO_STRING(LIST_TRANSFORM(RANGE(1, LEN(letters) + 1), lambda i: letters[i] || '=' || texts[i]), '|')"
_TOK = "REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{L}\\p{N}_]{2,}')"
A = chain(ANNOTATIONS)

ORACLES = {
    "E1_stem_options": chain(ANNOTATIONS, *SPEC[:2]) + "SELECT id, stem, seg AS segment FROM s1",
    "E2_mcq_options": S3 + f"SELECT id, {_OPTS} AS options, is_mcq FROM s3",
    "E3_class_mentions": A + f"SELECT id, ARRAY_TO_STRING({ordered('a')}, '; ') AS whole_word, ARRAY_TO_STRING({ordered('b')}, '; ') AS substring FROM "
        f"(SELECT id, {raw_mentions('input')} AS a, {raw_mentions('input', SUB)} AS b FROM ann)",
    "E4_masked_cue": S3 + "SELECT id, cue FROM s3",
    "E5_tags": A + f"SELECT id, TRY_CAST({grp('input', V.POINT_TAG, 1)} AS DOUBLE) AS x, TRY_CAST({grp('input', V.POINT_TAG, 2)} AS DOUBLE) AS y, {grp('input', V.REF_TAG, 1)} AS ref FROM ann",
    "E6_intent_cascade": S3 + f"SELECT id, {INTENT} AS intent, {RULE} AS rule FROM s3",
    "E7_answer_format": chain(ANNOTATIONS, *SPEC) + "SELECT type, category, answer_format, COUNT(*) AS n FROM spec GROUP BY ALL",
    "E8_stated_area": A + f"SELECT id, {_AR[0]} AS raw, {_AR[1]} AS unit, {_AR[2]} AS value, {_AR[3]} AS as_percent FROM ann",
    "E9_stated_count": A + f"SELECT id, {_CT[0]} AS raw, {_CT[1]} AS value FROM ann",
    "E10_comparator": A + f"SELECT id, {cmp_sql('input')} AS free, {cmp_sql('input', V.TASK_COMPARATORS)} AS by_task FROM ann",
    "E11_between": A + f"SELECT id, {num('input', V.BETWEEN_RANGE, 1)} AS lo, {num('input', V.BETWEEN_RANGE, 2)} AS hi FROM ann",
    "E12_qualifier": A + f"SELECT id, {qual_sql('input')} AS qualifier FROM ann",
    "E13_flags": A + f"SELECT id, {rx('input', V.COMPLEMENT_CUE)} AS complement, {rx('input', V.NEGATION_CUE)} AS negated, {rx('input', V.TASK_ONLY_ONE)} AS only_one, {rx('input', V.TASK_MULTIPLE)} AS multiple FROM ann",
    "E14_query_spec": chain(ANNOTATIONS, *SPEC) + "SELECT * FROM spec",
    "E15_task_parse": chain(ANNOTATIONS, *TASKSPEC) + f"SELECT id, ARRAY_TO_STRING(classes, '; ') AS classes, {', '.join(TASK_FIELDS)} FROM tspec",
    "E16_option_direction": chain(ANNOTATIONS, *TASKSPEC) + f"SELECT id, letter, direction, {gap_sql('direction', q('N'))} AS gap_to_north FROM (SELECT id, letter, {DIRECTION} AS direction FROM "
        "(SELECT id, UNNEST(letters) AS letter, UNNEST(texts) AS text FROM tspec WHERE category = 'relative pos'))",
    "E17_template_family": A + f"SELECT id, REGEXP_MATCHES(SPLIT_PART(input, '?', 1), {q(V.SUBJECT_SECOND)}) AS subject_second, "
        f"{first_hit('h', V.TEMPLATE_FAMILIES, q(V.DEFAULT_FAMILY))} AS family FROM (SELECT *, SPLIT_PART(input, '?', 1) AS h FROM ann)",
    "E18_rule_residue": chain(ANNOTATIONS, *SPEC) + "SELECT s.reason, COUNT(*) AS n FROM spec s JOIN ann a USING (id) WHERE a.split = 'validation' GROUP BY 1",
    "E19_tfidf": f"WITH d AS (SELECT doc_id, {_TOK} AS t FROM documents), "
        "g AS (SELECT doc_id, UNNEST(t) AS term FROM d UNION ALL SELECT doc_id, UNNEST(LIST_TRANSFORM(RANGE(1, LEN(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM d), "
        "tf AS (SELECT doc_id, term, COUNT(*) AS n FROM g GROUP BY ALL), df AS (SELECT term, COUNT(*) AS df, SUM(n) AS total FROM tf GROUP BY term HAVING COUNT(*) >= 2), "
        "w AS (SELECT doc_id, term, df, (1 + LN(n)) * (LN((1 + (SELECT COUNT(*) FROM d)) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN df USING (term)), "
        "z AS (SELECT *, w / SQRT(SUM(w * w) OVER (PARTITION BY doc_id)) AS x FROM w) "
        "SELECT term, ANY_VALUE(df) AS df, ROUND(SUM(x), 6) AS weight_sum, ROUND(MAX(x), 6) AS weight_max FROM z GROUP BY term",
}
