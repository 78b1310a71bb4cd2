"""Profiling of an annotation corpus: every pass runs over all rows and reduces before it shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtally.functions import dims, questions, text
from groundtally.functions import fixed_values as V
from groundtally.operators import order
from groundtally.session import cut_lineage

def I() -> Column:  # noqa: E743
    """The question text; a function, so that importing needs no session."""
    return F.col("input")


def O() -> Column:  # noqa: E743
    return F.col("output")



def with_task(ann: DataFrame) -> DataFrame:
    return ann.withColumn("task", F.concat_ws("|", "type", "category"))


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def counted(aggs: dict[str, Column], df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Many conditional counts in one aggregate, turned into (name, n) rows afterwards."""
    cols = {f"_{i}": (label, cond) for i, (label, cond) in enumerate(aggs.items())}
    agg = [F.count_if(cond).alias(c) for c, (_, cond) in cols.items()]
    one = df.groupBy(*keys).agg(*agg) if keys else df.agg(*agg)
    rows = F.array(*[F.struct(F.lit(label).alias(name), F.col(c).alias("n")) for c, (label, _) in cols.items()])
    return one.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def top(df: DataFrame, keys: list[str], value: str, keep: int) -> DataFrame:
    """Adds rank (n descending, value) and share of the key's total; keeps the first ``keep``.

    Totals and distinct counts are grouped sums; the rank filter is cut map-side.
    """
    total = df.groupBy(*keys).agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_values"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).join(total, keys).withColumn("share", F.col("n") / F.col("rows"))


def column_profile(df: DataFrame, columns: list[str], examples: int = 3) -> DataFrame:
    """Rows, nulls, cardinality, extremes and the first ``examples`` values of every column, by one grouping of (column, value).

    Doubles are told to six digits, so that their text doesn't depend on who prints it.
    """
    kinds = dict(df.dtypes)
    shown = lambda c: F.col(c).cast("decimal(18,6)") if kinds[c] == "double" else F.col(c)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), shown(c).cast("string").alias("value")) for c in columns])
    per = df.select(F.explode(rows).alias("r")).groupBy("r.column", "r.value").agg(F.count("*").alias("n"))
    out = per.groupBy("column").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
                                    F.count("value").alias("cardinality"), F.min("value").alias("first_value"), F.max("value").alias("last_value"))
    first = per.filter("value is not null").withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("value"))).filter(F.col("k") <= examples)
    shown_first = first.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), " | ").alias("examples"))
    return out.withColumn("null_pct", 100.0 * F.col("nulls") / F.col("n_rows")).join(shown_first, "column", "left")


def length_quantiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact length quantiles from a length histogram."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.length(F.col(c)).alias("len")) for c in columns])
    hist = df.select(F.explode(rows).alias("r")).groupBy("r.column", "r.len").agg(F.count("*").alias("n"))
    p = F.percentile("len", F.array(F.lit(0.5), F.lit(0.95)), F.col("n"))
    return hist.groupBy("column").agg(F.min("len").alias("min"), F.get(p, F.lit(0)).alias("p50"), F.get(p, F.lit(1)).alias("p95"), F.max("len").alias("max"))


def templates(ann: DataFrame, keep: int = 8) -> DataFrame:
    n = with_task(ann).groupBy("task", text.skeleton(I()).alias("skeleton")).agg(F.count("*").alias("n"))
    return top(n, ["task"], "skeleton", keep)


def answer_vocabulary(ann: DataFrame, keep: int = 25) -> DataFrame:
    n = with_task(ann).groupBy("task", text.answer_bucket(O()).alias("answer")).agg(F.count("*").alias("n"))
    return top(n, ["task"], "answer", keep)


def vocabulary(ann: DataFrame) -> DataFrame:
    """(kind, term, n) from class labels, reference tags and presence options."""
    label = F.transform(questions.mentions(I()), F.lower)
    refs = F.transform(F.regexp_extract_all(I(), F.lit(V.REF_TAG), F.lit(1)), lambda r: F.lower(F.trim(r)))
    opts = F.when((F.col("type") == "mcq") & (F.col("category") == "presence"), F.transform(questions.options_of(questions.task_segment(I())), lambda o: F.lower(o["text"])))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("terms")) for k, t in (("label", label), ("ref", refs), ("option", opts))])
    return ann.select(F.explode(kinds).alias("k")).select("k.kind", F.explode("k.terms").alias("term")).groupBy("kind", "term").agg(F.count("*").alias("n"))


def overlap(vocab: DataFrame, left: str, right: str) -> DataFrame:
    """Sizes of the intersection and the one-sided rests of two vocabularies after normalisation."""
    return overlaps(vocab, [(left, right)])


def overlaps(vocab: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """:func:`overlap` of several pairs of vocabularies, from one grouping by term."""
    by_term = vocab.groupBy(text.normal_form(F.col("term")).alias("term")).agg(F.collect_set("kind").alias("kinds"))
    each = [F.struct(F.lit(a).alias("left_kind"), F.lit(b).alias("right_kind"), F.array_contains("kinds", a).alias("l"), F.array_contains("kinds", b).alias("r")) for a, b in pairs]
    l, r = F.col("l"), F.col("r")  # noqa: E741
    return by_term.select(F.inline(F.array(*each))).groupBy("left_kind", "right_kind").agg(F.count_if(l & r).alias("both"), F.count_if(l & ~r).alias("left_only"), F.count_if(~l & r).alias("right_only"))


def term_hits(ann: DataFrame) -> DataFrame:
    """Rows containing each group name (substring) and each class name outside the 19 (whole word)."""
    import re
    low = F.lower(I())
    aggs = {f"l1:{t}": F.contains(low, F.lit(t)) for t in V.GROUP_NAMES_L1}
    aggs |= {f"l2:{t}": F.contains(low, F.lit(t)) for t in V.GROUP_NAMES_L2}
    aggs |= {f"l3:{t}": low.rlike(rf"\b{re.escape(t)}\b") for t in V.NAMES_OUTSIDE_C19}
    return counted(aggs, ann, "term").filter("n > 0")


def unit_hits(ann: DataFrame) -> DataFrame:
    """Unit markers in all questions, in area questions by task, and in caption answers."""
    q = {u: I().rlike(p) for u, p in V.UNIT_MARKERS}
    everywhere = counted(q, ann, "unit").withColumn("scope", F.lit("questions"))
    area = counted(q, with_task(ann).filter(F.col("category") == "area"), "unit", "task").withColumnRenamed("task", "scope").select("unit", "n", "scope")
    caps = counted({u: O().rlike(p) for u, p in V.UNIT_MARKERS}, ann.filter(F.col("type") == "captioning"), "unit").withColumn("scope", F.lit("captions"))
    return everywhere.unionByName(area).unionByName(caps)


def numeric_mentions(ann: DataFrame) -> DataFrame:
    """(task, unit, value, n) of every stated area."""
    m2 = F.transform(F.regexp_extract_all(I(), F.lit(V.PROFILE_SQUARE_METRE), F.lit(1)), _number)
    pct = F.transform(F.regexp_extract_all(I(), F.lit(V.TASK_PERCENT), F.lit(1)), lambda x: x.try_cast("double"))
    rows = F.array(F.struct(F.lit("m2").alias("unit"), m2.alias("v")), F.struct(F.lit("percent").alias("unit"), pct.alias("v")))
    return with_task(ann).filter(F.col("category") == "area").select("task", F.explode(rows).alias("r")).select(
        "task", "r.unit", F.explode("r.v").alias("value")).groupBy("task", "unit", "value").agg(F.count("*").alias("n"))


STEPS = (("m2", 10.0), ("m2", 100.0), ("m2", 1000.0), ("m2", 10000.0), ("percent", 0.1), ("percent", 1.0), ("percent", 5.0), ("percent", 10.0))


def granularity(values: DataFrame) -> DataFrame:
    """(unit, value, n) -> share of mentions divisible by each step."""
    steps = F.array(*[F.struct(F.lit(u).alias("of"), F.lit(s).alias("step")) for u, s in STEPS])
    per = values.groupBy("unit", "value").agg(F.sum("n").alias("n")).select("*", F.explode(steps).alias("s")).filter("s.of = unit")
    ratio = F.col("value") / F.col("s.step")
    even = F.abs(F.rint(ratio) - ratio) < 1e-9
    return per.groupBy("unit", F.col("s.step").alias("step")).agg((F.sum(F.when(even, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.sum("n").alias("n"))


def value_gaps(values: DataFrame) -> DataFrame:
    """Gaps between consecutive distinct values: smallest, median and the smallest of the commonest."""
    gap = order.neighbour_gaps(values, "unit", "value").select("unit", F.round(F.col("value") - F.col("previous"), 4).alias("gap")).filter("gap is not null")
    n = cut_lineage(gap.groupBy("unit", "gap").agg(F.count("*").alias("n")))
    ends = n.groupBy("unit").agg(F.min("gap").alias("min_gap"), F.max_by("gap", F.struct(F.col("n"), -F.col("gap"))).alias("mode_gap"))
    return ends.join(order.exact_quantiles(n, "unit", "gap", "n", {"median_gap": 0.5}), "unit").select("unit", "min_gap", "median_gap", "mode_gap")


def comparator_shares(ann: DataFrame) -> DataFrame:
    """Comparator phrases per task; several may hit one row, none counts as equality."""
    labels = F.array_compact(F.array(*[F.when(I().rlike(p), F.lit(lab)) for lab, p in V.PROFILE_COMPARATORS]))
    hit = F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("none/equality")))
    n = with_task(ann).filter(F.col("category").isin("area", "count")).select("task", F.explode(hit).alias("comparator")).groupBy("task", "comparator").agg(F.count("*").alias("n"))
    total = n.groupBy("task").agg(F.sum("n").alias("hits"))
    return n.join(total, "task").select("task", "comparator", "n", (F.col("n") / F.col("hits")).alias("share"))


def comparator_words(ann: DataFrame) -> DataFrame:
    phrase = F.concat_ws(" ", F.lower(F.regexp_extract(I(), V.COMPARATOR_WORD, 1)), F.lower(F.regexp_extract(I(), V.COMPARATOR_WORD, 2)))
    return ann.filter((F.col("category") == "count") & (F.col("type") == "binary") & I().rlike(V.COMPARATOR_WORD)).groupBy(
        phrase.alias("phrase")).agg(F.count("*").alias("n"))


def _ranges(ann: DataFrame) -> DataFrame:
    """MCQ area and count rows with their option ranges and plain numbers."""
    opts = questions.options_of(questions.task_segment(I()))
    def read(o):
        t = o["text"]
        return F.struct(_number(F.regexp_extract(t, V.OPTION_RANGE_UNIT, 1)).alias("lo"), _number(F.regexp_extract(t, V.OPTION_RANGE_UNIT, 2)).alias("hi"),
                        t.rlike(V.OPTION_RANGE_UNIT).alias("ranged"), F.when(t.rlike(V.TASK_INTEGER), _number(F.regexp_extract(t, V.TASK_INTEGER, 1))).alias("point"))
    return ann.filter((F.col("type") == "mcq") & F.col("category").isin("area", "count")).select("id", "category", F.transform(opts, read).alias("r"))


def option_spacing(ann: DataFrame) -> DataFrame:
    """(category, kind, value, n): gaps between sorted distinct option values, and range widths."""
    d = _ranges(ann)
    vals = F.array_sort(F.array_distinct(F.array_compact(F.transform("r", lambda x: F.when(x["ranged"], x["lo"]).otherwise(x["point"])))))
    d = d.withColumn("v", vals)
    gaps = F.when(F.size("v") >= 2, F.zip_with(F.slice("v", F.lit(2), F.size("v") - 1), F.slice("v", F.lit(1), F.size("v") - 1), lambda b, a: F.round(b - a, 4)))
    widths = F.transform(F.filter("r", lambda x: x["ranged"]), lambda x: F.round(x["hi"] - x["lo"], 4))
    rows = F.array(F.struct(F.lit("gap").alias("kind"), gaps.alias("v")), F.struct(F.lit("width").alias("kind"), widths.alias("v")))
    return d.select("category", F.explode(rows).alias("k")).select("category", "k.kind", F.explode("k.v").alias("value")).groupBy("category", "kind", "value").agg(F.count("*").alias("n"))


def stated_percent() -> Column:
    pct, m2 = F.regexp_extract(I(), V.TASK_PERCENT, 1).try_cast("double"), _number(F.regexp_extract(I(), V.PROFILE_SQUARE_METRE, 1)) / 14400.0
    return F.when(I().rlike(V.TASK_PERCENT), pct).when(I().rlike(V.PROFILE_SQUARE_METRE), m2)


def near_misses(ann: DataFrame) -> DataFrame:
    """|stated - true| of every "no" beside the first "yes" of the same (patch, class, category)."""
    d = ann.filter((F.col("type") == "binary") & F.col("category").isin("area", "count")).select(
        "id", "patch_id", "category", "output", stated_percent().alias("stated"), F.get(questions.mentions(I()), F.lit(0)).alias("class_name")).filter(
        "stated is not null and class_name is not null")
    keys = ["patch_id", "class_name", "category"]
    truth = d.filter("output = 'yes'").groupBy(*keys).agg(F.min_by("stated", "id").alias("truth"))
    delta = cut_lineage(d.filter("output = 'no'").join(truth, keys).groupBy("category", F.round(F.abs(F.col("stated") - F.col("truth")), 9).alias("delta")).agg(F.count("*").alias("n")))
    ends = delta.groupBy("category").agg(F.sum("n").alias("n"), F.min("delta").alias("min"), F.max("delta").alias("max"))
    inner = order.exact_quantiles(delta, "category", "delta", "n", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return ends.join(inner, "category").select("category", "n", "min", "p25", "median", "p75", "max")


def referring_qualifiers(ann: DataFrame) -> DataFrame:
    """Qualifier of every reference tag whose rest is one of the 19 classes."""
    base = [n.lower().replace(",", "") for n in dims.C19_NAMES]
    ref = F.explode(F.transform(F.regexp_extract_all(I(), F.lit(V.REF_TAG), F.lit(1)), lambda r: F.lower(F.trim(r))))
    pat = r"^(.*?)\s+(?:of|in)\s+(.*)$"
    d = ann.select(ref.alias("ref"))
    known = F.replace(F.regexp_extract("ref", pat, 2), F.lit(","), F.lit("")).isin(*base)
    return d.groupBy(F.when(known, F.regexp_extract("ref", pat, 1)).otherwise(F.lit("<none>")).alias("qualifier")).agg(F.count("*").alias("n"))


def category_words(ann: DataFrame, category: str = "adjacency", words=V.ADJACENCY_WORDS) -> DataFrame:
    return counted({w: F.contains(F.lower(I()), F.lit(w)) for w in words}, ann.filter(F.col("category") == category), "word")


def answer_priors(ann: DataFrame, keep: int = 4) -> DataFrame:
    return answer_vocabulary(ann, keep).select("task", "answer", "n", "rows", "rank", "share")


def label_circularity(ann: DataFrame) -> DataFrame:
    """How often a metadata column equals the released option of its own question."""
    d = ann.filter((F.col("type") == "mcq") & F.col("category").isin("country", "season", "climate zone"))
    value = F.when(F.col("category") == "country", F.col("country")).when(F.col("category") == "season", F.col("season")).otherwise(F.col("climate_zone"))
    opts = questions.options_of(questions.task_segment(I()))
    chosen = F.get(F.filter(opts, lambda o: o["letter"] == F.trim(O())), F.lit(0))["text"]
    d = d.select("category", value.alias("value"), chosen.alias("chosen")).filter("chosen is not null")
    return d.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.lower(F.trim("chosen")) == F.lower(F.trim("value"))).alias("agree")).withColumn("rate", F.col("agree") / F.col("n"))


def value_leak(ann: DataFrame) -> DataFrame:
    low = F.lower(I())
    return counted({c: F.contains(low, F.lower(c)) & (F.col("category") != c) for c in ("country", "season")}, ann, "field")


def option_forms(ann: DataFrame) -> DataFrame:
    """Area options as ranges or points, and whether neighbouring ranges share an endpoint."""
    d = _ranges(ann.filter(F.col("category") == "area"))
    forms = F.transform("r", lambda x: F.when(x["ranged"], F.lit("range")).otherwise(F.lit("point")))
    rs = F.array_sort(F.transform(F.filter("r", lambda x: x["ranged"]), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))))
    d = d.withColumns({"forms": forms, "rs": rs})
    touch = F.when(F.size("rs") >= 2, F.zip_with(F.slice("rs", F.lit(1), F.size("rs") - 1), F.slice("rs", F.lit(2), F.size("rs") - 1),
                                               lambda a, b: F.when(F.abs(a["hi"] - b["lo"]) < 1e-9, F.lit("touching")).otherwise(F.lit("gapped"))))
    rows = F.array(F.struct(F.lit("form").alias("kind"), F.col("forms").alias("v")), F.struct(F.lit("endpoints").alias("kind"), touch.alias("v")))
    return d.select(F.explode(rows).alias("k")).select("k.kind", F.explode("k.v").alias("value")).groupBy("kind", "value").agg(F.count("*").alias("n"))


def question_forms(ann: DataFrame) -> DataFrame:
    d = ann.filter(F.col("type") == "binary").filter(F.col("category").isin("area", "count"))
    form = F.when(F.col("category") == "area", questions.first_match(I(), V.AREA_FORMS, F.lit("other"))).otherwise(questions.first_match(I(), V.COUNT_FORMS, F.lit("other")))
    n = d.groupBy("category", form.alias("form")).agg(F.count("*").alias("n"))
    return n.join(n.groupBy("category").agg(F.sum("n").alias("total")), "category").select("category", "form", "n", (F.col("n") / F.col("total")).alias("share"))


def residual_skeletons(ann: DataFrame, keep: int = 25) -> DataFrame:
    """Skeletons of yes/no area and count questions no comparator explains, with the residual rate."""
    d = ann.filter((F.col("type") == "binary") & F.col("category").isin("area", "count")).select("category", I().alias("input"), questions.first_match(I(), V.RESIDUAL_COMPARATORS).alias("c"))
    scanned = d.groupBy("category").agg(F.count("*").alias("scanned"), F.count_if(F.col("c").isNull()).alias("residual"))
    n = d.filter("c is null").groupBy("category", text.skeleton(F.col("input")).alias("skeleton")).agg(F.count("*").alias("n"))
    t = top(n, ["category"], "skeleton", keep).select("category", "skeleton", "n", "rank")
    return t.join(scanned, "category").withColumn("residual_rate", F.col("residual") / F.col("scanned"))


def clean_class() -> Column:
    """The one class name contained in the question after dropping names inside longer hits, else null."""
    names = dims.literal_array(sorted((n.lower() for n in dims.C19_NAMES), key=lambda n: (-len(n), n)))
    hits = F.filter(names, lambda c: F.contains(F.lower(I()), c))
    kept = F.filter(hits, lambda c: ~F.exists(hits, lambda d: (c != d) & F.contains(d, c)))
    return F.when(F.size(kept) == 1, F.get(kept, F.lit(0)))


def attribution(ann: DataFrame) -> DataFrame:
    d = ann.filter((F.col("type") == "binary") & (F.col("category") == "area")).withColumn("class_name", clean_class())
    return d.groupBy(F.coalesce("class_name", F.lit("<discarded>")).alias("class_name")).agg(F.count("*").alias("n"))


def inclusivity(ann: DataFrame) -> DataFrame:
    """Verdicts where an inclusive and a strict form of one threshold were both answered."""
    d = ann.filter((F.col("type") == "binary") & (F.col("category") == "area")).select(
        "id", "patch_id", "output", clean_class().alias("class_name"), questions.first_match(I(), (V.TASK_COMPARATORS[0], V.TASK_COMPARATORS[2], V.TASK_COMPARATORS[1], V.TASK_COMPARATORS[3])).alias("form"),
        F.round(F.when(I().rlike(V.TASK_PERCENT), F.regexp_extract(I(), V.TASK_PERCENT, 1).try_cast("double")).when(
            I().rlike(V.TASK_SQUARE_METRE), _number(F.regexp_extract(I(), V.TASK_SQUARE_METRE, 1)) / 14400.0), 4).alias("threshold")).filter(
        "class_name is not null and form is not null and threshold is not null")
    g = d.groupBy("patch_id", "class_name", "threshold").agg(*[F.max_by(F.when(F.col("form") == f, F.col("output")), F.when(F.col("form") == f, F.col("id"))).alias(f) for f in ("ge", "gt", "le", "lt")])

    def verdict(a, b):
        return (F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(None).cast("string")).when((F.col(a) == "yes") & (F.col(b) == "no"), "decisive")
                .when(F.col(a) == F.col(b), "consistent").otherwise("impossible"))
    rows = F.array(F.struct(F.lit("ge/gt").alias("pair"), verdict("ge", "gt").alias("verdict")), F.struct(F.lit("le/lt").alias("pair"), verdict("le", "lt").alias("verdict")))
    return g.select(F.explode(rows).alias("r")).select("r.*").filter("verdict is not null").groupBy("pair", "verdict").agg(F.count("*").alias("n"))


def surface_forms(ann: DataFrame) -> DataFrame:
    """Forms seen in tags and options, resolved exactly, by singular/plural, then by token Jaccard."""
    strip = V.QUALIFIER_PHRASE.replace(r"(?i)\b", r"(?i)^") + r"\s+(?:of|in)\s+"
    refs = F.transform(F.regexp_extract_all(I(), F.lit(V.REF_TAG), F.lit(1)), lambda r: F.regexp_replace(F.trim(r), strip, ""))
    parts = F.flatten(F.transform(questions.options_of(questions.task_segment(I())), lambda o: F.split(o["text"], r"\band\b")))
    opts = F.when((F.col("type") == "mcq") & F.col("category").isin("presence", "adjacency"), F.filter(F.transform(parts, F.trim), lambda p: p != "")).otherwise(
        F.array().cast("array<string>"))
    seen = ann.select(F.explode(F.concat(refs, opts)).alias("f")).groupBy(text.normal_form(F.col("f")).alias("form")).agg(F.count("*").alias("n"))
    canon = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), F.lit(dims.normal_form(n)).alias("norm")) for i, n in enumerate(dims.C19_NAMES)])
    c = seen.select("form", "n", F.explode(canon).alias("c"))  # 19 rows per distinct form
    f, g = F.col("form"), F.col("c.norm")
    same = (f == g) | (F.concat(f, F.lit("s")) == g) | (f == F.concat(g, F.lit("s")))
    a, b = F.array_distinct(F.split(f, r"\s+")), F.array_distinct(F.split(g, r"\s+"))
    jac = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    best = c.groupBy("form", "n").agg(F.min_by("c.name", F.when(same, F.col("c.pos"))).alias("exact"),
                                      F.max_by("c.name", F.struct(jac.alias("j"), (-F.col("c.pos")).alias("p"))).alias("near"), F.max(jac).alias("score"))
    return best.select("form", "n", F.coalesce("exact", F.when(F.col("score") >= V.JACCARD_FLOOR, F.col("near"))).alias("class_name"),
                       F.when(F.col("exact").isNotNull(), "exact").when(F.col("score") >= V.JACCARD_FLOOR, "jaccard").otherwise("unresolved").alias("how"))
