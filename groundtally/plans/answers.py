"""Queries F1-F14: answers by task, the dispatcher and the baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundtally.functions import questions
from groundtally.operators import answers as A
from groundtally.operators import classify, regions, scoring
from groundtally.plans.answersql import BASE, compare_sql
from groundtally.plans.sqlviews import ANNOTATIONS, chain
from groundtally.session import cut_lineage
from groundtally.sources import fixture as fx

GEOMETRIC_TASKS = tuple(f"{t}|{c}" for t, cs in (("binary", ("presence", "area", "count", "adjacency")), ("mcq", ("presence", "area", "count", "adjacency", "relative pos"))) for c in cs)
OPS = ("ge", "le", "gt", "lt", "eq")


def parsed(spark, sf):
    return A.parsed_questions(fx.open_annotations(spark, sf))


def measured(spark, sf):
    # Measured once, read by every branch: a few rows per (patch, class) are written and reused.
    return cut_lineage(regions.measure_classes(fx.pixels(spark, sf)))


def facts(spark, sf):
    return A.named_facts(measured(spark, sf))


def pairs(spark, sf):
    return A.named_pairs(regions.adjacency(fx.pixels(spark, sf)))


def f1(spark, sf):
    op = F.explode(F.array(*[F.lit(o) for o in (*OPS, "none")])).alias("op")
    d = fx.table(spark, sf, "lineitem").groupBy("l_quantity", "l_linenumber").agg(F.count("*").alias("n")).select(
        "l_quantity", "l_linenumber", "n", op)
    return d.withColumn("verdict", questions.compare(F.col("l_quantity"), F.col("op"), F.col("l_linenumber") * 7.0))


def binary(spark, sf, category):
    out = A.binary_measures(parsed(spark, sf).filter(F.col("category") == category), facts(spark, sf))
    return out


def f5(spark, sf):
    return A.binary_adjacency(parsed(spark, sf), pairs(spark, sf))


def f9(spark, sf):
    return A.mcq_adjacency(parsed(spark, sf), pairs(spark, sf))


def f10(spark, sf):
    return A.mcq_relative(parsed(spark, sf), facts(spark, sf)).drop("computed")


def answers(spark, sf):
    own = regions.level_runs(fx.pixels(spark, sf))  # the one scan of the pixels: areas and contacts come from its runs
    return A.answer_all(fx.open_annotations(spark, sf), cut_lineage(regions.measure_classes(own)), cut_lineage(regions.adjacency(own)))


def scored(spark, sf):
    return A.scored_answers(answers(spark, sf), fx.open_annotations(spark, sf))


def with_task(spark, sf):
    return fx.open_annotations(spark, sf).withColumn("task", F.concat_ws("|", "type", "category"))


def f12(spark, sf):
    d = with_task(spark, sf)
    best = A.majority_answers(d.filter(F.col("split") == "train"))
    test = d.filter(F.col("split") == "validation").join(best, "task", "left")  # one row per task
    return test.groupBy("task", "majority", "n_top").agg(F.count("*").alias("n"), F.count_if(F.col("output") == F.col("majority")).alias("n_correct"))


def f13(spark, sf):
    d = with_task(spark, sf)
    best = A.majority_answers(d.filter(F.col("split") == "train")).select("task", "majority")
    test = d.filter(F.col("split") == "validation").join(best, "task", "left")
    said = F.when(F.col("type") == "mcq", F.lit("a")).otherwise(F.col("majority"))
    return test.withColumn("said", said).groupBy("task", "said").agg(F.count("*").alias("n"), F.count_if(F.col("output") == F.col("said")).alias("n_correct"))


def f14(spark, sf):
    """Blind classifiers: answers of the geometric tasks from the question text alone, a model for each task, fitted together.

    A task whose training answers are all alike is left to its majority answer.
    """
    d = cut_lineage(with_task(spark, sf).filter(F.col("task").isin(*GEOMETRIC_TASKS)).select("task", "split", "input", "output"))
    train, test = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "validation")
    model = classify.fit(train, "input", "output", "task", max_terms=60_000, sublinear=False, strip_accents=False)
    best = A.majority_answers(train).select("task", "majority")  # one row per task
    said = model.predict(test, "input", "task").join(F.broadcast(best), "task", "left").withColumn("said", F.coalesce("predicted", "majority"))
    return said.groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("output")).alias("n_correct"))


def flagship(spark, sf):
    """Every question answered from measured regions and scored per task."""
    return scoring.score_tasks(scored(spark, sf))


QUERIES = {
    "F1_compare": f1,
    "F2_binary_presence": lambda s, d: binary(s, d, "presence"),
    "F3_binary_count": lambda s, d: binary(s, d, "count"),
    "F4_binary_area": lambda s, d: binary(s, d, "area"),
    "F5_binary_adjacency": f5,
    "F6_mcq_presence": lambda s, d: A.mcq_presence(parsed(s, d), facts(s, d)),
    "F7_mcq_count": lambda s, d: A.mcq_count(parsed(s, d), facts(s, d)),
    "F8_mcq_area": lambda s, d: A.mcq_area(parsed(s, d), facts(s, d)),
    "F9_mcq_adjacency": f9, "F10_mcq_relative": f10, "F11_dispatch": answers, "F12_majority_baseline": f12,
    "F13_prior_baseline": f13, "F14_blind_classifier": f14,
}

_B = chain(*BASE)
_PICK = _B + "SELECT id, patch_id, task, answer, computed, reason FROM ans"
_MAJ = ("maj AS (SELECT task, output AS majority, n AS n_top FROM (SELECT task, output, n, ROW_NUMBER() OVER (PARTITION BY task ORDER BY n DESC, output) AS rn FROM "
        "(SELECT type || '|' || category AS task, output, COUNT(*) AS n FROM ann WHERE split = 'train' GROUP BY ALL)) WHERE rn = 1), "
        "val AS (SELECT a.type, a.output, a.task, m.majority, m.n_top FROM (SELECT *, type || '|' || category AS task FROM ann WHERE split = 'validation') a LEFT JOIN maj m ON m.task = a.task)")


def _task(name):
    return _PICK + f" WHERE task = '{name}' AND (reason IS NULL OR reason NOT LIKE 'expected%')"


ORACLES = {
    "F1_compare": f"SELECT l_quantity, l_linenumber, n, op, CASE op {' '.join(x for x in compare_sql('l_quantity', '(l_linenumber * 7.0::DOUBLE)').split('CASE comparator ')[1:])} AS verdict FROM "
        "(SELECT l_quantity, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL), (VALUES ('ge'), ('le'), ('gt'), ('lt'), ('eq'), ('none')) o(op)",
    "F2_binary_presence": _task("binary|presence"), "F3_binary_count": _task("binary|count"), "F4_binary_area": _task("binary|area"),
    "F5_binary_adjacency": _task("binary|adjacency"), "F6_mcq_presence": _task("mcq|presence"), "F7_mcq_count": _task("mcq|count"),
    "F8_mcq_area": _task("mcq|area"), "F9_mcq_adjacency": _task("mcq|adjacency"),
    "F10_mcq_relative": _B + "SELECT id, patch_id, task, answer, reason, direction, tied FROM rel",
    "F11_dispatch": _PICK,
    "F12_majority_baseline": chain(ANNOTATIONS, _MAJ) + "SELECT task, majority, n_top, COUNT(*) AS n, COUNT(*) FILTER (output = majority) AS n_correct FROM val GROUP BY ALL",
    "F13_prior_baseline": chain(ANNOTATIONS, _MAJ) + "SELECT task, CASE WHEN type = 'mcq' THEN 'a' ELSE majority END AS said, COUNT(*) AS n, "
        "COUNT(*) FILTER (output = CASE WHEN type = 'mcq' THEN 'a' ELSE majority END) AS n_correct FROM val GROUP BY ALL",
}
