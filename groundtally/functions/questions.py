"""Questions to typed specifications, entirely as column expressions.

Two readings exist on purpose. The free reading (`parse`) finds the intent itself and matches class
names as whole words; the task-labelled reading (`parse_for_task`) is told the task and matches plain
substrings. Class mentions use one alternation, longest form first; masking blanks every mention of a
class, not only the first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtally.functions import dims
from groundtally.functions import fixed_values as V


def first_match(text: Column, pairs, otherwise: Column | None = None) -> Column:
    """Label of the first (label, pattern) that occurs in the text."""
    out = None
    for label, pattern in pairs:
        hit = text.rlike(pattern)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out if otherwise is None else out.otherwise(otherwise)


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def _group(text: Column, pattern: str, i: int) -> Column:
    """Capture group, null when the pattern does not occur."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i))


def _one_row(df: DataFrame, keep: list[str], fields: dict[str, Column]) -> DataFrame:
    """Emits the fields through a one-row generator.

    A later filter on a field then stays above the generator; pushed into it, the optimizer would
    copy the whole chain of patterns into the predicate. Filters on kept columns still reach the scan.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))))


def _each_once(df: DataFrame, keys: list[str], read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with what ``read`` adds to its ``keys``, read once for all rows that ask the same.

    The distinct questions are dealt to as many tasks as the session works on at once; a question's reading is costly and its text short.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = read(df.select(*keys).distinct().repartition(parts, *keys))
    found = found.select(*[F.col(k).alias(f"_as_{k}") for k in keys], *[c for c in found.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(found[f"_as_{k}"]) for k in keys])
    return df.join(found, same).drop(*[f"_as_{k}" for k in keys])


# ------------------------------------------------------------------------------ stem, options, classes
def stem(question: Column) -> Column:
    return F.when(question.rlike(V.FIRST_OPTION), F.get(F.split(question, V.FIRST_OPTION, 2), F.lit(0))).otherwise(
        F.substring_index(question, "?", 1))


def option_text(question: Column) -> Column:
    """Everything from the first option marker on, else everything after the first question mark."""
    head = stem(question)
    return (F.when(question.rlike(V.FIRST_OPTION), F.substr(question, F.length(head) + 1))
            .when(F.contains(question, F.lit("?")), F.substr(question, F.length(head) + 2)).otherwise(F.lit("")))


def let(value: Column, use) -> Column:
    """Evaluates ``value`` once and hands it to ``use``; nested patterns are not run again per reference."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def options_of(segment: Column) -> Column:
    """Options as array<struct<letter, text>> in order of appearance; a repeated letter keeps its last text."""
    letters = F.regexp_extract_all(segment, F.lit(V.OPTION_LETTER), F.lit(1))
    parts = F.split(segment, V.OPTION_MARK)
    texts = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda t: F.regexp_replace(F.trim(t), r"\.+$", ""))
    zipped = F.filter(F.arrays_zip(letters.alias("letter"), texts.alias("text")), lambda p: p["text"] != "")

    def last_of_each(z):
        return F.transform(F.array_distinct(F.transform(z, lambda p: p["letter"])), lambda x: F.element_at(F.filter(z, lambda p: p["letter"] == x), -1))

    none = F.array().cast("array<struct<letter:string,text:string>>")
    return F.when(F.contains(segment, F.lit(")")), let(zipped, last_of_each)).otherwise(none)


def task_segment(question: Column) -> Column:
    """Task-labelled reading: everything after the first question mark, else the whole question."""
    return F.when(F.contains(question, F.lit("?")), F.substr(question, F.length(F.substring_index(question, "?", 1)) + 2)).otherwise(question)


def mentions(text: Column, mode: str = "whole_word") -> Column:
    """Canonical classes in order of first appearance."""
    found = F.regexp_extract_all(F.lower(text), F.lit(dims.mention_pattern(mode)), F.lit(0))
    table = dims.form_to_class()
    return F.array_distinct(F.transform(found, lambda m: F.element_at(table, F.regexp_replace(m, r"[,\s]+", " "))))


def contained_classes(text: Column) -> Column:
    """Classes of every form contained in the text, longest form first; used for option texts."""
    rows = ", ".join(f"named_struct('form', {dims._sql(f)}, 'name', {dims._sql(c)})" for f, c, *_ in dims.surface_forms())
    return let(F.lower(text), lambda low: F.array_distinct(F.transform(
        F.filter(F.expr(f"array({rows})"), lambda s: F.contains(low, s["form"])), lambda s: s["name"])))


def mask_classes(text: Column) -> Column:
    """Blanks the first free occurrence of every form, longest form first; what a longer form took is free no more.

    Only forms that the text holds are folded over, so a row pays for few patterns.
    """
    rows = ", ".join(f"named_struct('form', {dims._sql(f)}, 'first', {dims._sql('(?is)^(.*?)' + p)})" for f, p in dims.form_patterns())
    held = let(F.regexp_replace(F.lower(text), r"[,\s]+", " "), lambda low: F.filter(F.expr(f"array({rows})"), lambda s: F.contains(low, s["form"])))
    return F.aggregate(held, text, lambda masked, s: F.regexp_replace(masked, s["first"], F.lit("$1 _CLASS_ ")))


# ------------------------------------------------------------------------------ quantities
def stated_area(text: Column) -> Column:
    """struct<raw, unit, value, as_percent>, percent first; null when no area is stated."""
    pct, m2 = _number(_group(text, V.PERCENT_VALUE, 1)), _number(_group(text, V.SQUARE_METRE_VALUE, 1))
    row = F.when(text.rlike(V.PERCENT_VALUE), F.struct(
        F.regexp_extract(text, V.PERCENT_VALUE, 0).alias("raw"), F.lit("percent").alias("unit"), pct.alias("value"), pct.alias("as_percent")))
    return row.when(text.rlike(V.SQUARE_METRE_VALUE), F.struct(
        F.regexp_extract(text, V.SQUARE_METRE_VALUE, 0).alias("raw"), F.lit("m2").alias("unit"), m2.alias("value"),
        (100.0 * m2 / V.PATCH_AREA_M2).alias("as_percent")))


def stated_count(text: Column, words=V.NUMBER_WORDS) -> Column:
    """struct<raw, unit, value, as_percent>; number words in list order, then digits."""
    any_word = r"\b(?:" + "|".join(w for w, _ in words) + r")\b"
    low = F.lower(text)
    word = F.when(low.rlike(any_word), first_match(low, [(w, rf"\b{w}\b") for w, _ in words]))
    raw = F.coalesce(word, _group(text, r"\b(\d+)\b", 1))
    value = F.coalesce(F.element_at(dims.literal_map(dict(words)), raw).cast("double"), raw.try_cast("double"))
    return F.when(raw.isNotNull(), F.struct(raw.alias("raw"), F.lit("count").alias("unit"), value.alias("value"),
                                            F.lit(None).cast("double").alias("as_percent")))


def comparator(text: Column, table=V.COMPARATORS) -> Column:
    return first_match(text, table)


def qualifier(text: Column) -> Column:
    return F.lower(F.coalesce(_group(text, V.QUALIFIER_PHRASE, 1), _group(text, V.QUALIFIER_BARE, 1)))


def intent_rule(cue: Column, is_mcq: Column) -> Column:
    """struct<intent, rule>: the first cue of the cascade that fires, null when none does."""
    def hit(intent, rule):
        return F.struct(F.lit(intent).alias("intent"), F.lit(rule).alias("rule"))
    area = F.regexp_replace(cue, V.LAND_COVER_WORDS, " ")
    return (
        F.when(is_mcq & cue.rlike(V.METADATA_CUE), hit("metadata_mcq", "metadata_cue"))
        .when(cue.rlike(V.RELATIVE_CUE), hit("relative_position", "relative_cue"))
        .when(cue.rlike(V.ADJACENCY_CUE), hit("adjacency", "adjacency_synonym"))
        .when(cue.rlike(V.PERCENT_VALUE) | cue.rlike(V.SQUARE_METRE_VALUE), hit("area", "area_quantity"))
        .when(cue.rlike(V.COUNT_SHAPE), hit("count", "count_shape"))
        .when(cue.rlike(V.COUNT_CUE), hit("count", "count_cue"))
        .when(cue.rlike(V.COMPLEMENT_CUE), hit("area", "complement_form"))
        .when(area.rlike(V.AREA_CUE), hit("area", "area_cue"))
        .when(cue.rlike(V.PRESENCE_CUE), hit("presence", "presence_cue"))
        .when(is_mcq, hit("presence", "mcq_default_presence"))
    )


# ------------------------------------------------------------------------------ free reading
def _steps(df: DataFrame, question: str) -> DataFrame:
    """The intermediate columns every part of the free reading draws on, computed once."""
    c = F.col(question)
    tagged = F.contains(c, F.lit("<"))
    d = df.withColumns({"_stem": stem(c), "_opt": options_of(option_text(c)), "_is_point": tagged & c.rlike(V.POINT_TAG),
                        "_is_ref": tagged & c.rlike(V.REF_TAG)})
    d = d.withColumns({"_px": F.when(F.col("_is_point"), F.regexp_extract(c, V.POINT_TAG, 1).try_cast("double")),
                       "_py": F.when(F.col("_is_point"), F.regexp_extract(c, V.POINT_TAG, 2).try_cast("double")),
                       "_ref": F.when(F.col("_is_ref"), F.regexp_extract(c, V.REF_TAG, 1)).otherwise(F.lit("")),
                       "_mcq": F.size("_opt") == 4, "_cue": mask_classes(F.col("_stem")), "_classes": mentions(F.col("_stem")),
                       "_all": F.when(F.col("_is_point") | F.col("_is_ref"), mentions(c))})
    d = d.withColumn("_inner", F.when(F.col("_is_ref"), mentions(F.col("_ref"))))
    d = d.withColumns({"_hit": intent_rule(F.col("_cue"), F.col("_mcq")),
                       "_caption": F.col("_cue").rlike(V.CAPTION_CUE) & ~F.col("_mcq")})
    two = F.col("_hit.intent").isin("adjacency", "relative_position")
    d = d.withColumn("_need", F.when(two, 2).otherwise(1))
    first = F.get(F.filter(F.transform("_opt", lambda o: mentions(o["text"])), lambda a: F.size(a) >= F.col("_need")), F.lit(0))
    return d.withColumn("_from_options", F.when(F.col("_mcq") & (F.size("_classes") < F.col("_need")), first))


SPEC = ["intent", "answer_format", "class_a", "class_b", "qualifier", "comparator", "stated_value", "stated_upper",
        "negated", "point_x", "point_y", "matched_rule", "options", "reason"]


def parse(df: DataFrame, question: str = "input", level: str = "c19") -> DataFrame:
    """Adds the typed specification, or `reason` when the rules decline; never fails on a row."""
    return _each_once(df, [question], lambda asked: _parse(asked, question))


def _parse(df: DataFrame, question: str) -> DataFrame:
    c = F.col(question)
    d = _steps(df, question)
    intent, rule = F.col("_hit.intent"), F.col("_hit.rule")
    empty, long = c.isNull() | (F.trim(c) == ""), F.length(c) > V.MAX_QUESTION_CHARS
    ref_classes = F.when(F.size("_inner") > 0, F.col("_inner")).otherwise(F.col("_all"))
    kind = (
        F.when(empty, "empty").when(long, "long").when(F.col("_is_point"), "point")
        .when(F.col("_is_ref"), F.when(F.size(ref_classes) > 0, "ref").otherwise("ref_none"))
        .when(F.col("_caption"), "caption").when(F.col("_hit").isNull(), "no_cue").when(intent == "metadata_mcq", "metadata")
        .when(F.col("_from_options").isNotNull(), "option_classes").when(F.size("_classes") == 0, "no_class")
        .when((F.col("_need") == 2) & (F.size("_classes") < 2), "one_class").otherwise("full"))
    d = d.withColumn("_kind", kind)
    k = F.col("_kind")
    d = d.withColumn("_free", (k == "full") & ~F.col("_mcq") & intent.isin("area", "count"))
    free = F.col("_free")
    d = d.withColumns({"_ranged": free & F.col("_cue").rlike(V.BETWEEN_RANGE), "_m2": free & (intent == "area") & F.col("_cue").rlike(V.SQUARE_METRE_VALUE)})
    has_range, m2 = F.col("_ranged"), F.col("_m2")

    def bound(i):
        v = _number(_group(F.col("_cue"), V.BETWEEN_RANGE, i))
        return F.struct(
            F.regexp_extract("_cue", V.BETWEEN_RANGE, 0).alias("raw"),
            F.when(m2, "m2").when(intent == "area", "percent").otherwise("count").alias("unit"), v.alias("value"),
            F.when(m2, 100.0 * v / V.PATCH_AREA_M2).when(intent == "area", v).alias("as_percent"))

    fields = {
        "intent": F.when(k == "point", "referring_point").when(k == "ref", "referring_expr").when(k == "caption", "caption")
        .when(k.isin("metadata", "option_classes", "full"), intent),
        "answer_format": F.when(k.isin("point", "ref"), "bbox").when(k == "caption", "free_text")
        .when(k.isin("metadata", "option_classes", "full"), F.when(F.col("_mcq"), "mcq_letter").otherwise("yes_no")),
        "class_a": F.when(k == "point", F.get("_all", F.lit(0))).when(k == "ref", F.get(ref_classes, F.lit(0)))
        .when(k == "option_classes", F.get("_from_options", F.lit(0))).when(k == "full", F.get("_classes", F.lit(0))),
        "class_b": F.when((k == "option_classes") & (F.col("_need") == 2), F.get("_from_options", F.lit(1)))
        .when(k == "full", F.get("_classes", F.lit(1))),
        "qualifier": F.when(k == "point", qualifier(c)).when(k == "ref", qualifier(F.col("_ref")))
        .when(k.isin("option_classes", "full"), qualifier(F.col("_cue"))),
        "comparator": F.when(has_range, "between").when(free, comparator(F.col("_cue"))),
        "stated_value": F.when(has_range, bound(1)).when(free & (intent == "area"), stated_area(F.col("_cue")))
        .when(free & (intent == "count"), stated_count(F.col("_cue"))),
        "stated_upper": F.when(has_range, bound(2)),
        "negated": F.when(k.isin("point", "ref", "caption", "metadata", "option_classes"), F.lit(False))
        .when(k == "full", F.col("_cue").rlike(V.NEGATION_CUE)),
        "point_x": F.when(k == "point", F.col("_px")), "point_y": F.when(k == "point", F.col("_py")),
        "matched_rule": F.when(k == "point", "point_tag").when(k == "ref", "ref_tag").when(k == "caption", "caption_cue")
        .when(k == "option_classes", F.concat(rule, F.lit("+option_classes"))).when(k.isin("metadata", "full"), rule),
        "options": F.when(k.isin("metadata", "option_classes", "full"), F.col("_opt")),
        "reason": F.when(k == "empty", "empty question").when(k == "long", "question exceeds 4000 chars")
        .when(k == "ref_none", "<ref> tag resolved to no class").when(k == "no_cue", "no intent cue matched")
        .when(k == "no_class", "no class name resolved in the stem")
        .when(k == "one_class", F.concat(intent, F.lit(" needs two classes, found "), F.size("_classes").cast("string"))),
    }
    return _one_row(d, df.columns, fields)


# ------------------------------------------------------------------------------ task-labelled reading
def parse_for_task(df: DataFrame, question: str = "input") -> DataFrame:
    """Fields of a question whose task (type, category) is known, or `reason`."""
    return _each_once(df, [question, "type", "category"], lambda asked: _parse_for_task(asked, question))


def _parse_for_task(df: DataFrame, question: str) -> DataFrame:
    c, kind, cat = F.col(question), F.col("type"), F.col("category")
    opts = options_of(task_segment(c))
    pct, m2 = _group(c, V.TASK_PERCENT, 1).try_cast("double"), 100.0 * _number(_group(c, V.TASK_SQUARE_METRE, 1)) / V.PATCH_AREA_M2
    d = df.withColumns({"classes": mentions(c, "substring"), "_o": opts})
    reason = (
        F.when(cat.isin("country", "season", "climate zone"), "metadata task: not geometry-derived")
        .when((kind == "mcq") & (F.size("_o") != 4), F.concat(F.lit("expected 4 options, parsed "), F.size("_o").cast("string")))
        .when(~kind.isin("mcq", "binary"), F.concat(F.lit("unsupported task kind: "), kind)))
    d = d.withColumn("_why", reason)
    binary, mcq = F.col("_why").isNull() & (kind == "binary"), F.col("_why").isNull() & (kind == "mcq")
    return _one_row(d, df.columns, {
        "classes": F.col("classes"), "reason": F.col("_why"), "options": F.when(mcq, F.col("_o")),
        "comparator": F.when(binary, comparator(c, V.TASK_COMPARATORS)),
        "range_lo": F.when(binary, _number(_group(c, V.TASK_BETWEEN, 1))), "range_hi": F.when(binary, _number(_group(c, V.TASK_BETWEEN, 2))),
        "threshold_pct": F.when(binary, F.when(c.rlike(V.TASK_PERCENT), pct).otherwise(m2)),
        "threshold_n": F.when(binary, stated_count(c, V.TASK_NUMBER_WORDS)["value"]),
        "complement": F.when(binary, c.rlike(V.TASK_COMPLEMENT)), "only_one": F.when(binary, c.rlike(V.TASK_ONLY_ONE)),
        "multiple": F.when(binary, c.rlike(V.TASK_MULTIPLE)), "is_m2_unit": F.when(binary, c.rlike(V.TASK_SQUARE_METRE)),
    })


def option_direction(text: Column) -> Column:
    """Compass of an option text, compound phrases first."""
    low = F.lower(text)
    out = None
    for phrase, label in V.DIRECTION_PHRASES:
        hit = F.contains(low, F.lit(phrase))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def subject_is_second(question: Column) -> Column:
    return F.substring_index(question, "?", 1).rlike(V.SUBJECT_SECOND)


def template_family(question: Column) -> Column:
    return first_match(F.substring_index(question, "?", 1), V.TEMPLATE_FAMILIES, F.lit(V.DEFAULT_FAMILY))


def compare(value: Column, op: Column, threshold: Column) -> Column:
    """Null when there is no comparator."""
    tests = {"ge": value >= threshold, "le": value <= threshold, "gt": value > threshold, "lt": value < threshold, "eq": value == threshold}
    return reduce(lambda acc, kv: acc.when(op == kv[0], kv[1]), list(tests.items())[1:], F.when(op == "ge", tests["ge"]))
