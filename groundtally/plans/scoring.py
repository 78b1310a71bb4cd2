"""Queries G1-G5 and G12, G15-G24: scores, tests, leakage and text overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundtally.functions import fixed_values as V
from groundtally.functions import questions as Q
from groundtally.operators import position
from groundtally.operators import scoring as S
from groundtally.operators.quality import task_intents
from groundtally.plans import answers as PA
from groundtally.plans import regions as PR
from groundtally.plans.answersql import BASE
from groundtally.plans.questionsql import SPEC
from groundtally.plans.sqlviews import ANNOTATIONS, SCORED, chain, q
from groundtally.sources import fixture as fx


def g1(spark, sf):
    return S.score_tasks(fx.scored(spark, sf))


def g2(spark, sf):
    return S.top_reasons(fx.scored(spark, sf), 4)


def g3(spark, sf):
    return S.bootstrap_ci(fx.scored(spark, sf))


def baselines(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    s = S.score_tasks(fx.scored(spark, sf)).select("task", F.col("strict_accuracy").alias("oracle_strict"), F.col("attempted_accuracy").alias("oracle_attempted"))
    b = li.groupBy(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("task")).agg(
        (F.count_if(F.col("l_discount") < 0.03) / F.count("*")).alias("blind"), (F.count_if(F.col("l_tax") < 0.03) / F.count("*")).alias("majority"))
    return s.join(b, "task")


def g4(spark, sf):
    return S.macro_gap(baselines(spark, sf)).select(*[F.round(c, 9).alias(c) for c in ("oracle_strict", "oracle_attempted", "best_blind", "gap")])


def g5(spark, sf):
    return S.per_group_accuracy(fx.scored(spark, sf).withColumnRenamed("correct", "hit"), "patch_id", "task").withColumn("per_group_acc", F.round("per_group_acc", 9))


def g12(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_discount") < 0.05).alias("x_right"), (F.col("l_tax") < 0.04).alias("y_right"))
    return S.mcnemar(li, "l_suppkey").withColumn("p_value", F.round("p_value", 9)).withColumn("separable", F.col("p_value") < 0.05)


def read(spark, sf):
    """Every question with its true intent and what the rules made of it."""
    d = Q.parse(task_intents(fx.open_annotations(spark, sf)).withColumnRenamed("intent", "truth"))
    return d.withColumns({"parsed": F.col("reason").isNull(), "right": F.coalesce(F.col("intent") == F.col("truth"), F.lit(False))})


def g15(spark, sf):
    return S.coverage_precision(read(spark, sf))


def g16(spark, sf):
    return S.confusion(read(spark, sf).filter("parsed"), "truth", "intent")


def g17(spark, sf):
    f1 = S.label_f1(read(spark, sf), "truth", "intent")
    return f1


def g17_macro(spark, sf):
    return S.label_f1(read(spark, sf), "truth", "intent").agg(F.round(F.avg("f1"), 9).alias("macro_f1"), F.count("*").alias("n_labels"))


def g18(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "text", (F.col("n_chars") % 3 > 0).alias("correct"))
    return S.leakage_split(d.filter(F.col("doc_id") % 5 == 0), d.filter(F.col("doc_id") % 5 != 0))


def g19(spark, sf):
    return S.reason_examples(Q.parse(fx.open_annotations(spark, sf)))


def g20(spark, sf):
    return S.abstention_gap(PA.scored(spark, sf), Q.parse(fx.open_annotations(spark, sf)))


def exchanges(spark, sf):
    """User turns beside the assistant turn that follows."""
    c = fx.table(spark, sf, "conversations")
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    return c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("hyp")).join(a, ["conv_id", "turn"]).withColumn(
        "id", F.col("conv_id") * 100000 + F.col("turn"))


BLEU = ["hyp_len", "ref_len", "p1", "p2", "p3", "p4", "brevity_penalty", "bleu4"]


def g21(spark, sf):
    return S.corpus_bleu(exchanges(spark, sf)).select(*[F.round(c, 9).alias(c) if c not in ("hyp_len", "ref_len") else F.col(c) for c in BLEU])


def g22(spark, sf):
    return S.rouge_l(exchanges(spark, sf), "turn")


def g22_captions(spark, sf):
    made = position.captions(PR.facts(spark, sf), PR.scene_meta(spark, sf))
    return S.score_captions(made, fx.open_annotations(spark, sf)).select(
        "n_captions", *[F.round(c, 9).alias(c) if c not in ("hyp_len", "ref_len") else F.col(c) for c in BLEU], "rouge_l", "verdict")


def g23(spark, sf):
    d = S.coverage_precision(read(spark, sf)).filter("type <> 'MACRO'")
    return d.select("type", "category", S.coverage_verdict(F.col("coverage")).alias("coverage_verdict"), S.bleu_verdict(100 * F.col("precision")).alias("band"))


def g24(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_discount", "l_linenumber", "l_returnflag")
    task = lambda number: F.concat_ws("|", "l_returnflag", number.cast("string")).alias("task")
    # the tasks of the second run are numbered one higher, so each run has one that the other lacks
    before = li.groupBy(task(F.col("l_linenumber"))).agg((F.count_if(F.col("l_discount") < 0.05) / F.count("*")).alias("value"))
    after = li.groupBy(task(F.col("l_linenumber") + 1)).agg(
        (F.count_if(F.col("l_discount") < F.when(F.col("l_returnflag") == "A", 0.07).otherwise(0.05)) / F.count("*")).alias("value"))
    return S.metric_delta(before, after)


QUERIES = {
    "G1_task_score": g1, "G2_top_reasons": g2, "G3_bootstrap_ci": g3, "G4_macro_gap": g4, "G5_per_class_accuracy": g5, "G12_mcnemar": g12,
    "G15_coverage_precision": g15, "G16_confusion": g16, "G17_label_f1": g17, "G17_macro_f1": g17_macro, "G18_leakage_split": g18, "G19_examples": g19,
    "G20_abstention_gap": g20, "G21_corpus_bleu": g21, "G22_rouge_l": g22, "G22_caption_scores": g22_captions, "G23_verdicts": g23, "G24_metric_delta": g24,
}

SCORE = ("COUNT(*) AS n, COUNT(*) FILTER (NOT abstained) AS n_attempted, COUNT(*) FILTER (correct) AS n_correct, COUNT(*) FILTER (abstained) AS n_abstained, "
         "COUNT(*) FILTER (correct)::DOUBLE / COUNT(*) AS strict_accuracy, CASE WHEN COUNT(*) FILTER (NOT abstained) = 0 THEN 0 ELSE COUNT(*) FILTER (correct)::DOUBLE / COUNT(*) FILTER (NOT abstained) END AS attempted_accuracy, "
         "COUNT(*) FILTER (abstained)::DOUBLE / COUNT(*) AS abstain_rate")
_TRUTH = "CASE type || '|' || category " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in V.TASK_INTENTS.items()) + " END"
READ = f"rd AS MATERIALIZED (SELECT id, type, category, {_TRUTH} AS truth, intent, reason IS NULL AS parsed, COALESCE(intent = {_TRUTH}, FALSE) AS \"right\" FROM spec)"
RD = chain(ANNOTATIONS, *SPEC, READ)
COVER = ("cover AS (SELECT COALESCE(type, 'POOLED') AS type, COALESCE(category, 'POOLED') AS category, COUNT(*) AS n, COUNT(*) FILTER (parsed) AS n_parsed, COUNT(*) FILTER (\"right\") AS n_right, "
         "COUNT(*) FILTER (parsed)::DOUBLE / COUNT(*) AS coverage, CASE WHEN COUNT(*) FILTER (parsed) = 0 THEN 0 ELSE COUNT(*) FILTER (\"right\")::DOUBLE / COUNT(*) FILTER (parsed) END AS precision, "
         "COUNT(*) FILTER (\"right\")::DOUBLE / COUNT(*) AS end_to_end FROM rd GROUP BY GROUPING SETS ((type, category), ()))")
F1 = ("f1 AS (SELECT label, tp, p - tp AS fp, t - tp AS fn, CASE WHEN p + t = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (p + t) END AS f1 FROM (SELECT COALESCE(a.label, b.label) AS label, COALESCE(a.tp, 0) AS tp, "
      "COALESCE(a.t, 0) AS t, COALESCE(b.p, 0) AS p FROM (SELECT truth AS label, COUNT(*) AS t, COUNT(*) FILTER (\"right\") AS tp FROM rd GROUP BY truth) a FULL JOIN "
      "(SELECT intent AS label, COUNT(*) AS p FROM rd WHERE intent IS NOT NULL GROUP BY intent) b ON a.label = b.label))")
_NEED = "CASE " + " ".join(f"WHEN REGEXP_MATCHES(reason, {q(p)}) THEN {q(f)}" for p, f in V.ABSTENTION_NEEDS) + " END"
_HAS = ("CASE need WHEN 'class_a' THEN class_a IS NOT NULL WHEN 'class_b' THEN class_b IS NOT NULL WHEN 'stated_value' THEN stated_unit IS NOT NULL "
        "WHEN 'comparator' THEN comparator IS NOT NULL WHEN 'options' THEN COALESCE(options, '') <> '' ELSE FALSE END")
EX = ("ex AS MATERIALIZED (SELECT u.conv_id * 100000 + u.turn AS id, u.turn, REGEXP_EXTRACT_ALL(LOWER(u.text), '[a-z0-9]+') AS h, REGEXP_EXTRACT_ALL(LOWER(a.text), '[a-z0-9]+') AS r "
      "FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')")


def _grams(col, name):
    g = f"ARRAY_TO_STRING({col}[i:i + n - 1], ' ')"
    return (f"{name} AS (SELECT id, n, g, COUNT(*) AS c FROM (SELECT id, n, UNNEST(LIST_TRANSFORM(RANGE(1, LEN({col}) - n + 2), lambda i: {g})) AS g FROM ex, RANGE(1, 5) t(n)) GROUP BY ALL)")


CAPTION_EX = ("ex AS MATERIALIZED (SELECT r.id, 0 AS turn, REGEXP_EXTRACT_ALL(LOWER(c.caption), '[a-z0-9]+') AS h, REGEXP_EXTRACT_ALL(LOWER(r.output), '[a-z0-9]+') AS r "
              "FROM ann r JOIN cap c USING (patch_id) WHERE r.type = 'captioning' AND r.split = 'validation')")
BLEU_PARTS = (
    _grams("h", "gh"), _grams("r", "gr"),
    "m AS (SELECT n, SUM(LEAST(gh.c, COALESCE(gr.c, 0)))::DOUBLE / SUM(gh.c) AS p FROM gh LEFT JOIN gr USING (id, n, g) GROUP BY n)",
    "l AS (SELECT CAST(SUM(LEN(h)) AS BIGINT) AS hyp_len, CAST(SUM(LEN(r)) AS BIGINT) AS ref_len FROM ex)",
    "a AS (SELECT l.*, COALESCE(MAX(p) FILTER (n = 1), 0) AS p1, COALESCE(MAX(p) FILTER (n = 2), 0) AS p2, COALESCE(MAX(p) FILTER (n = 3), 0) AS p3, COALESCE(MAX(p) FILTER (n = 4), 0) AS p4, "
    "CASE WHEN hyp_len > ref_len THEN 1 WHEN hyp_len = 0 THEN 0 ELSE EXP(1 - ref_len::DOUBLE / hyp_len) END AS bp FROM m, l GROUP BY ALL)")
BLEU_ROW = (
    "hyp_len, ref_len, ROUND(p1, 9) AS p1, ROUND(p2, 9) AS p2, ROUND(p3, 9) AS p3, ROUND(p4, 9) AS p4, ROUND(bp, 9) AS brevity_penalty, "
    "ROUND(CASE WHEN LEAST(p1, p2, p3, p4) <= 0 THEN 0 ELSE 100 * bp * EXP((LN(p1) + LN(p2) + LN(p3) + LN(p4)) / 4) END, 9) AS bleu4")
LCS_PARTS = (
    "dp(id, i, line) AS (SELECT id, 0, LIST_TRANSFORM(RANGE(LEN(r)), lambda j: 0) FROM ex UNION ALL SELECT id, i, LIST_TRANSFORM(RANGE(1, LEN(cand) + 1), lambda j: LIST_MAX(cand[1:j])) FROM ("
    "SELECT d.id, d.i + 1 AS i, LIST_TRANSFORM(RANGE(1, LEN(d.line) + 1), lambda j: CASE WHEN e.r[j] = e.h[d.i + 1] THEN COALESCE(d.line[j - 1], 0) + 1 ELSE d.line[j] END) AS cand "
    "FROM dp d JOIN ex e ON e.id = d.id WHERE d.i < LEN(e.h)))",
    "lc AS (SELECT e.id, e.turn, LEN(e.h) AS m, LEN(e.r) AS n, COALESCE(d.line[LEN(e.r)], 0) AS lcs FROM ex e JOIN dp d ON d.id = e.id AND d.i = LEN(e.h))")
ROUGE = "ROUND(100 * AVG(CASE WHEN lcs = 0 THEN 0 ELSE 2 * (lcs::DOUBLE / m) * (lcs::DOUBLE / n) / (lcs::DOUBLE / m + lcs::DOUBLE / n) END), 6)"


ORACLES = {
    "G1_task_score": chain(SCORED) + f"SELECT task, {SCORE} FROM scored GROUP BY task",
    "G2_top_reasons": chain(SCORED) + "SELECT task, reason, n, rank FROM (SELECT task, reason, COUNT(*) AS n, CAST(ROW_NUMBER() OVER (PARTITION BY task ORDER BY COUNT(*) DESC, reason) AS INT) AS rank "
        "FROM scored WHERE abstained GROUP BY task, reason) WHERE rank <= 4",
    "G3_bootstrap_ci": chain(SCORED, "per AS (SELECT task, patch_id, COUNT(*) AS total, COUNT(*) FILTER (correct) AS hits FROM scored GROUP BY ALL)",
        "dg AS MATERIALIZED (SELECT patch_id, blk, MD5('1337:' || blk || ':' || patch_id) AS bits FROM (SELECT DISTINCT patch_id FROM per), RANGE(125) t(blk))",
        f"dr AS (SELECT patch_id, blk * 8 + k AS b, LEN(LIST_FILTER({list(S.POISSON_16)}, lambda t: ('0x' || SUBSTR(bits, 1 + 4 * k, 4))::INT >= t)) AS times FROM dg, RANGE(8) r(k))",
        "acc AS (SELECT task, b, SUM(hits * times)::DOUBLE / SUM(total * times) AS acc FROM dr JOIN per USING (patch_id) GROUP BY task, b HAVING SUM(total * times) > 0)",
        "o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY task ORDER BY acc) - 1 AS k, COUNT(*) OVER (PARTITION BY task) AS m FROM acc)") +
        "SELECT task, MAX(acc) FILTER (k = FLOOR(0.025 * m)) AS ci_low, MAX(acc) FILTER (k = LEAST(FLOOR(0.975 * m), m - 1)) AS ci_high FROM o GROUP BY task",
    "G4_macro_gap": chain(SCORED, f"s AS (SELECT task, {SCORE} FROM scored GROUP BY task)",
        "b AS (SELECT l_returnflag || '|' || l_linestatus AS task, COUNT(*) FILTER (l_discount < 0.03)::DOUBLE / COUNT(*) AS blind, COUNT(*) FILTER (l_tax < 0.03)::DOUBLE / COUNT(*) AS majority FROM lineitem GROUP BY 1)") +
        "SELECT ROUND(AVG(strict_accuracy), 9) AS oracle_strict, ROUND(AVG(attempted_accuracy), 9) AS oracle_attempted, ROUND(AVG(GREATEST(blind, majority)), 9) AS best_blind, "
        "ROUND(AVG(strict_accuracy) - AVG(GREATEST(blind, majority)), 9) AS gap FROM s JOIN b USING (task)",
    "G5_per_class_accuracy": chain(SCORED) + "SELECT task, ROUND(AVG(h::DOUBLE / m), 9) AS per_group_acc, SUM(h)::DOUBLE / SUM(m) AS pooled_acc, CAST(SUM(m) AS BIGINT) AS n, COUNT(*) AS n_groups FROM "
        "(SELECT task, patch_id, COUNT(*) AS m, COUNT(*) FILTER (correct) AS h FROM scored GROUP BY ALL) GROUP BY task",
    "G12_mcnemar": "WITH d AS (SELECT l_suppkey, COUNT(*) FILTER (l_discount < 0.05 AND NOT l_tax < 0.04) AS b, COUNT(*) FILTER (NOT l_discount < 0.05 AND l_tax < 0.04) AS c FROM lineitem GROUP BY l_suppkey), "
        "e AS (SELECT *, ROUND(CASE WHEN b + c = 0 THEN 1 ELSE LEAST(1.0, 2 * LIST_SUM(LIST_TRANSFORM(RANGE(0, LEAST(b, c) + 1), lambda i: EXP(LGAMMA(b + c + 1) - LGAMMA(i + 1) - LGAMMA(b + c - i + 1) - (b + c) * LN(2))))) END, 9) AS p_value FROM d) "
        "SELECT l_suppkey, b, c, p_value, p_value < 0.05 AS separable FROM e",
    "G15_coverage_precision": chain(ANNOTATIONS, *SPEC, READ, COVER) + "SELECT * FROM cover UNION ALL SELECT 'MACRO', 'MACRO', CAST(SUM(n) AS BIGINT), CAST(SUM(n_parsed) AS BIGINT), CAST(SUM(n_right) AS BIGINT), ROUND(AVG(coverage), 9), ROUND(AVG(precision), 9), ROUND(AVG(end_to_end), 9) FROM cover WHERE type <> 'POOLED'",
    "G16_confusion": RD + "SELECT truth, intent, COUNT(*) AS n FROM rd WHERE parsed AND truth <> intent GROUP BY ALL",
    "G17_label_f1": chain(ANNOTATIONS, *SPEC, READ, F1) + "SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, f1 FROM f1",
    "G17_macro_f1": chain(ANNOTATIONS, *SPEC, READ, F1) + "SELECT ROUND(AVG(f1), 9) AS macro_f1, COUNT(*) AS n_labels FROM f1",
    "G18_leakage_split": "SELECT text IN (SELECT text FROM documents WHERE doc_id % 5 <> 0) AS seen_in_train, COUNT(*) AS n, COUNT(*) FILTER (n_chars % 3 > 0) AS n_correct, "
        "COUNT(*) FILTER (n_chars % 3 > 0)::DOUBLE / COUNT(*) AS accuracy FROM documents WHERE doc_id % 5 = 0 GROUP BY 1",
    "G19_examples": chain(ANNOTATIONS, *SPEC) + "SELECT reason, rank, id, example FROM (SELECT s.reason, s.id, LEFT(a.input, 160) AS example, CAST(ROW_NUMBER() OVER (PARTITION BY s.reason ORDER BY s.id) AS INT) AS rank "
        "FROM spec s JOIN ann a USING (id) WHERE s.reason IS NOT NULL) WHERE rank <= 3",
    "G20_abstention_gap": chain(*BASE, *SPEC, f"nd AS (SELECT *, {_NEED} AS need FROM sa WHERE abstained)",
        f"sp AS (SELECT n.task, n.reason AS reason, need IS NOT NULL AS fixable, COALESCE(s.reason IS NULL AND need IS NOT NULL AND {_HAS}, FALSE) AS supplied FROM nd n LEFT JOIN "
        "(SELECT id, class_a, class_b, comparator, stated_unit, options, reason FROM spec) s USING (id))") +
        "SELECT task, reason, COUNT(*) AS abstained, COUNT(*) FILTER (supplied) AS supplied, COUNT(*) FILTER (NOT fixable) AS unfixable, COUNT(*) FILTER (supplied)::DOUBLE / COUNT(*) AS fix_rate FROM sp GROUP BY ALL",
    "G21_corpus_bleu": chain(EX, *BLEU_PARTS) + f"SELECT {BLEU_ROW} FROM a",
    "G22_rouge_l": chain(EX, *LCS_PARTS) + f"SELECT turn, COUNT(*) AS n, CAST(SUM(lcs) AS BIGINT) AS lcs_total, {ROUGE} AS rouge_l FROM lc GROUP BY turn",
    "G22_caption_scores": chain(*PR.REG, PR.fact_cte(), PR.C19, PR.NAMED, ANNOTATIONS, PR.META, f"cap AS ({PR.CAPTION_SQL})", CAPTION_EX, *BLEU_PARTS, *LCS_PARTS) +
        f"SELECT (SELECT COUNT(*) FROM lc) AS n_captions, {BLEU_ROW}, (SELECT {ROUGE} FROM lc) AS rouge_l, "
        "CASE WHEN bleu4 >= 35 THEN 'templates suffice' WHEN bleu4 >= 10 THEN 'rewrite style' ELSE 'drop symbolic captions' END AS verdict FROM a",
    "G23_verdicts": chain(ANNOTATIONS, *SPEC, READ, COVER) + "SELECT type, category, CASE WHEN coverage < 0.5 THEN 'below floor' ELSE 'ok' END AS coverage_verdict, "
        "CASE WHEN 100 * precision >= 35 THEN 'templates suffice' WHEN 100 * precision >= 10 THEN 'rewrite style' ELSE 'drop symbolic captions' END AS band FROM cover",
    "G24_metric_delta": "WITH b AS (SELECT l_returnflag || '|' || l_linenumber AS task, COUNT(*) FILTER (l_discount < 0.05)::DOUBLE / COUNT(*) AS v FROM lineitem GROUP BY 1), "
        "a AS (SELECT l_returnflag || '|' || (l_linenumber + 1) AS task, COUNT(*) FILTER (l_discount < CASE WHEN l_returnflag = 'A' THEN 0.07 ELSE 0.05 END)::DOUBLE / COUNT(*) AS v FROM lineitem GROUP BY 1) "
        "SELECT COALESCE(a.task, b.task) AS task, b.v AS before, a.v AS after, a.v - b.v AS delta, a.v IS DISTINCT FROM b.v AS moved FROM b FULL JOIN a ON a.task = b.task",
}
