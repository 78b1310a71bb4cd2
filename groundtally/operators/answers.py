"""Answers: parsed questions joined with region facts measured once per patch for all classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtally.functions import dims, geometry, questions
from groundtally.functions import fixed_values as V
from groundtally.session import cut_lineage

OUT = ["id", "patch_id", "task", "answer", "computed", "reason"]


def named_facts(facts: DataFrame) -> DataFrame:
    return facts.join(F.broadcast(dims.c19_dim(facts.sparkSession)), "cls")


def named_pairs(pairs: DataFrame) -> DataFrame:
    dim = dims.c19_dim(pairs.sparkSession)
    a = dim.select(F.col("cls").alias("class_a"), F.col("class_name").alias("name_a"))
    b = dim.select(F.col("cls").alias("class_b"), F.col("class_name").alias("name_b"))
    return pairs.join(F.broadcast(a), "class_a").join(F.broadcast(b), "class_b")


def parsed_questions(ann: DataFrame) -> DataFrame:
    return questions.parse_for_task(ann).withColumn("task", F.concat_ws("|", "type", "category"))


def _yes(c):
    return F.when(c, F.lit("yes")).when(~c, F.lit("no"))


def _tasks(parsed: DataFrame, *tasks: str) -> DataFrame:
    return parsed.filter(F.col("reason").isNull() & F.col("task").isin(*tasks)).drop("reason")


def declined(parsed: DataFrame) -> DataFrame:
    """Rows the reading itself refused."""
    return parsed.filter(F.col("reason").isNotNull()).select(
        "id", "patch_id", "task", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("double").alias("computed"), "reason")


def _with_target(parsed: DataFrame, facts: DataFrame) -> DataFrame:
    """Left-joins the facts of the first mentioned class; an absent class measures zero."""
    f = facts.select("patch_id", F.col("class_name").alias("target"), "n_regions", "coverage_pct")
    d = parsed.withColumn("target", F.get("classes", F.lit(0))).join(f, ["patch_id", "target"], "left")
    return d.withColumns({"n_regions": F.coalesce("n_regions", F.lit(0)), "coverage_pct": F.coalesce("coverage_pct", F.lit(0.0))})


def binary_measures(parsed: DataFrame, facts: DataFrame) -> DataFrame:
    """Yes/no presence, count and area questions in one join."""
    d = _with_target(_tasks(parsed, "binary|presence", "binary|count", "binary|area"), facts)
    n, pct, cat, op = F.col("n_regions"), F.col("coverage_pct"), F.col("category"), F.col("comparator")
    lo = F.when(F.col("is_m2_unit"), 100.0 * F.col("range_lo") / V.PATCH_AREA_M2).otherwise(F.col("range_lo"))
    hi = F.when(F.col("is_m2_unit"), 100.0 * F.col("range_hi") / V.PATCH_AREA_M2).otherwise(F.col("range_hi"))
    ranged = F.col("range_lo").isNotNull() & F.col("range_hi").isNotNull()
    verdict = (
        F.when(F.col("target").isNull(), F.lit(None).cast("boolean")).when(cat == "presence", n > 0)
        .when(cat == "count", F.when(F.col("only_one"), n == 1).when(F.col("multiple"), n >= 2)
              .otherwise(questions.compare(n.cast("double"), op, F.col("threshold_n"))))
        .otherwise(F.when(F.col("complement"), pct < 100.0).when(ranged, (pct >= lo) & (pct <= hi))
                   .otherwise(questions.compare(pct, op, F.col("threshold_pct")))))
    threshold = F.when(cat == "count", F.col("threshold_n")).otherwise(F.col("threshold_pct"))
    why = (F.when(F.col("target").isNull(), "no class name resolved")
           .when(verdict.isNull() & threshold.isNull(), F.concat(cat, F.lit(" question with no threshold")))
           .when(verdict.isNull(), F.concat(cat, F.lit(" question with no comparator"))))
    d = d.withColumns({"answer": _yes(verdict), "reason": why})
    return d.withColumn("computed", F.when(F.col("answer").isNotNull(), F.when(cat == "area", pct).otherwise(n.cast("double")))).select(*OUT)


def _pick(options: DataFrame, empty_reason: str) -> DataFrame:
    """Best option per question by ascending `rank` struct; options with a null rank cannot win."""
    keys = ["id", "patch_id", "task"]
    got = options.groupBy(*keys).agg(
        F.min_by(F.when(F.col("rank").isNotNull(), F.struct("letter", "computed")), F.when(F.col("rank").isNotNull(), F.col("rank"))).alias("b"))
    return got.select(*keys, F.col("b.letter").alias("answer"), F.col("b.computed").alias("computed"),
                      F.when(F.col("b").isNull(), empty_reason).alias("reason"))


def _options(d: DataFrame, *keep: str) -> DataFrame:
    return d.select("id", "patch_id", "task", *keep, F.posexplode("options").alias("pos", "o")).select(
        "id", "patch_id", "task", *keep, "pos", "o.letter", "o.text")


def _unnamed(d: DataFrame) -> DataFrame:
    return d.select("id", "patch_id", "task", F.lit(None).cast("string").alias("answer"),
                    F.lit(None).cast("double").alias("computed"), F.lit("no class name resolved").alias("reason"))


def mcq_presence(parsed: DataFrame, facts: DataFrame) -> DataFrame:
    """The option whose class covers most; pixel counts decide, the earliest option on ties."""
    d = _tasks(parsed, "mcq|presence")
    o = _options(d.filter(F.size("classes") > 0)).withColumn("class_name", F.get(questions.contained_classes(F.col("text")), F.lit(0)))
    f = facts.select("patch_id", "class_name", "area_px", "coverage")
    o = o.join(f, ["patch_id", "class_name"], "left").withColumns({
        "computed": F.coalesce("coverage", F.lit(0.0)),
        "rank": F.when(F.col("class_name").isNotNull(), F.struct((-F.coalesce("area_px", F.lit(0))).alias("a"), F.col("pos").alias("p")))})
    return _pick(o, "no MCQ option resolved to a class").unionByName(_unnamed(d.filter(F.size("classes") == 0)))


def mcq_count(parsed: DataFrame, facts: DataFrame) -> DataFrame:
    d = _with_target(_tasks(parsed, "mcq|count"), facts)
    o = _options(d.filter(F.col("target").isNotNull()), "n_regions")
    v = F.when(F.col("text").rlike(V.TASK_INTEGER), F.replace(F.regexp_extract("text", V.TASK_INTEGER, 1), F.lit(","), F.lit("")).try_cast("long"))
    o = o.withColumn("v", v).withColumns({"computed": F.col("n_regions").cast("double"), "rank": F.when(
        F.col("v").isNotNull(), F.struct(F.abs(F.col("n_regions") - F.col("v")).alias("a"), F.col("pos").alias("p")))})
    return _pick(o, "no numeric MCQ option").unionByName(_unnamed(d.filter(F.col("target").isNull())))


def option_range(text):
    """Closed percent range of an option text, converted from square metres where no percent sign occurs."""
    def bound(i):
        v = F.replace(F.regexp_extract(text, V.TASK_RANGE, i), F.lit(","), F.lit("")).try_cast("double")
        return F.when(F.contains(text, F.lit("%")), v).otherwise(100.0 * v / V.PATCH_AREA_M2)
    return F.when(text.rlike(V.TASK_RANGE), F.struct(bound(1).alias("lo"), bound(2).alias("hi")))


def mcq_area(parsed: DataFrame, facts: DataFrame) -> DataFrame:
    """First option range containing the coverage, else the nearest endpoint."""
    d = _with_target(_tasks(parsed, "mcq|area"), facts)
    o = _options(d.filter(F.col("target").isNotNull()), "coverage_pct").withColumn("r", option_range(F.col("text")))
    pct, lo, hi = F.col("coverage_pct"), F.col("r.lo"), F.col("r.hi")
    gap = F.when((lo <= pct) & (pct <= hi), F.lit(0.0)).otherwise(F.least(F.abs(pct - lo), F.abs(pct - hi)))
    o = o.withColumns({"computed": pct, "rank": F.when(lo.isNotNull() & hi.isNotNull(), F.struct(gap.alias("a"), F.col("pos").alias("p")))})
    return _pick(o, "no range MCQ option").unionByName(_unnamed(d.filter(F.col("target").isNull())))


def binary_adjacency(parsed: DataFrame, pairs: DataFrame) -> DataFrame:
    d = _tasks(parsed, "binary|adjacency").withColumns({"name_a": F.get("classes", F.lit(0)), "name_b": F.get("classes", F.lit(1))})
    d = d.join(pairs.select("patch_id", "name_a", "name_b", "overlap_px"), ["patch_id", "name_a", "name_b"], "left")
    two = F.col("name_b").isNotNull()
    return d.select("id", "patch_id", "task", F.when(two, _yes(F.coalesce("overlap_px", F.lit(0)) > 0)).alias("answer"),
                    F.when(two, F.coalesce("overlap_px", F.lit(0)).cast("double")).alias("computed"),
                    F.when(~two, "adjacency needs two classes").alias("reason"))


def mcq_adjacency(parsed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The option pair with the largest overlap; a pair that does not touch cannot win."""
    d = _tasks(parsed, "mcq|adjacency")
    names = questions.contained_classes(F.col("text"))
    o = _options(d.filter(F.size("classes") >= 2)).withColumn("n", names).withColumns(
        {"name_a": F.get("n", F.lit(0)), "name_b": F.get("n", F.lit(1))})
    o = o.join(pairs.select("patch_id", "name_a", "name_b", "overlap_px"), ["patch_id", "name_a", "name_b"], "left").withColumns({
        "computed": F.col("overlap_px").cast("double"),
        "rank": F.when(F.col("overlap_px") > 0, F.struct((-F.col("overlap_px")).alias("a"), F.col("pos").alias("p")))})
    few = d.filter(F.size("classes") < 2).select(
        "id", "patch_id", "task", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("double").alias("computed"),
        F.lit("adjacency needs two classes").alias("reason"))
    best = _pick(o, "no MCQ option yielded two classes").withColumn("computed", F.lit(None).cast("double"))
    return best.unionByName(few)


def mcq_relative(parsed: DataFrame, facts: DataFrame, band: float = V.DIAGONAL_BAND_DEG) -> DataFrame:
    """Exact compass option, else the angularly nearest; tied letters in order, tie count kept."""
    d = _tasks(parsed, "mcq|relative pos")
    first, second = F.get("classes", F.lit(0)), F.get("classes", F.lit(1))
    flip = questions.subject_is_second(F.col("input"))
    d = d.withColumns({"subject": F.when(flip, second).otherwise(first), "other": F.when(flip, first).otherwise(second)})
    pt = facts.select("patch_id", "class_name", "mask_row", "mask_col")
    a = pt.select("patch_id", F.col("class_name").alias("subject"), F.col("mask_row").alias("ar"), F.col("mask_col").alias("ac"))
    b = pt.select("patch_id", F.col("class_name").alias("other"), F.col("mask_row").alias("br"), F.col("mask_col").alias("bc"))
    d = d.join(a, ["patch_id", "subject"], "left").join(b, ["patch_id", "other"], "left").withColumn(
        "direction", geometry.compass(geometry.bearing(F.col("ar") - F.col("br"), F.col("ac") - F.col("bc")), band))
    why = F.when(F.size("classes") < 2, "relative position needs two classes").when(F.col("direction").isNull(), "one class absent; direction undefined")
    d = d.withColumn("reason", why)
    lost = d.filter("reason is not null").select("id", "patch_id", "task", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("double").alias("computed"), "reason",
                                                 F.lit(None).cast("string").alias("direction"), F.lit(None).cast("long").alias("tied"))
    o = _options(d.filter("reason is null"), "direction").withColumn("way", questions.option_direction(F.col("text")))
    o = o.withColumn("gap", geometry.angular_gap(F.col("direction"), F.col("way")))
    best = o.groupBy("id", "patch_id", "task", "direction").agg(
        F.min_by("letter", F.when(F.col("gap") == 0, F.col("pos"))).alias("exact"), F.min("gap").alias("gap"),
        F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("gap", "letter"))).alias("g"))  # four options
    ties = F.array_sort(F.transform(F.filter("g", lambda x: x["gap"] == F.col("gap")), lambda x: x["letter"]))
    picked = F.coalesce("exact", F.get(ties, F.lit(0)))
    got = best.select("id", "patch_id", "task", picked.alias("answer"), F.lit(None).cast("double").alias("computed"),
                      F.when(picked.isNull(), "no option parsed as a direction").alias("reason"), "direction",
                      F.when(F.col("exact").isNull() & F.col("gap").isNotNull(), F.size(ties).cast("long")).alias("tied"))
    return got.unionByName(lost)


def answer_all(ann: DataFrame, facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every question answered or declined with a reason, by task.

    Questions are read once and written; eight branches then filter and join the small specifications.
    """
    fields = ["id", "patch_id", "input", "task", "category", "classes", "reason", "options", "comparator", "range_lo", "range_hi",
              "threshold_pct", "threshold_n", "complement", "only_one", "multiple", "is_m2_unit"]
    p, f, a = cut_lineage(parsed_questions(ann).select(*fields)), named_facts(facts), named_pairs(pairs)
    parts = [declined(p), binary_measures(p, f), binary_adjacency(p, a), mcq_presence(p, f), mcq_count(p, f), mcq_area(p, f),
             mcq_adjacency(p, a), mcq_relative(p, f).select(*OUT)]
    out = parts[0].select(*OUT)
    for part in parts[1:]:
        out = out.unionByName(part.select(*OUT))
    return out


def scored_answers(answers: DataFrame, ann: DataFrame) -> DataFrame:
    """Answers beside the released ones: abstained is a third outcome, wrong under strict scoring."""
    truth = ann.select("id", F.col("output").alias("truth"))
    return answers.join(truth, "id").select(
        "id", "patch_id", "task", F.col("answer").alias("predicted"), "truth",
        F.coalesce(F.col("answer") == F.col("truth"), F.lit(False)).alias("correct"),
        F.col("answer").isNull().alias("abstained"), F.coalesce("reason", F.lit("")).alias("reason"))


def majority_answers(train: DataFrame) -> DataFrame:
    """Most frequent released answer per task; the alphabetically first on ties."""
    counts = train.groupBy("task", "output").agg(F.count("*").alias("n"))
    return counts.groupBy("task").agg(F.max("n").alias("n_top"), F.min_by("output", F.struct((-F.col("n")).alias("n"), F.col("output"))).alias("majority"))
