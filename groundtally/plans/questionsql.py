"""DuckDB text of the two question readings."""

from __future__ import annotations

from groundtally.functions import dims
from groundtally.functions import fixed_values as V
from groundtally.plans.sqlviews import first_hit, q

PAT, SUB = dims.mention_pattern(), dims.mention_pattern("substring")
FORM_MAP = ("MAP([" + ", ".join(q(f) for f, *_ in dims.surface_forms()) + "], ["
            + ", ".join(q(c) for _, c, *_ in dims.surface_forms()) + "])")
FORM_LIST = "[" + ", ".join("{'f': " + q(f) + ", 'c': " + q(c) + "}" for f, c, *_ in dims.surface_forms()) + "]"


def rx(col, pattern):
    return f"REGEXP_MATCHES({col}, {q(pattern)})"


def grp(col, pattern, i):
    return f"REGEXP_EXTRACT({col}, {q(pattern)}, {i})"


def num(col, pattern, i):
    return f"TRY_CAST(REPLACE({grp(col, pattern, i)}, ',', '') AS DOUBLE)"


def raw_mentions(col, pattern=PAT):
    return f"LIST_TRANSFORM(REGEXP_EXTRACT_ALL(LOWER({col}), {q(pattern)}), lambda x: {FORM_MAP}[REGEXP_REPLACE(x, '[,\\s]+', ' ', 'g')])"


_FIRSTS = "[" + ", ".join("{'f': " + q(f) + ", 'p': " + q("(?i)" + p) + "}" for f, p in dims.form_patterns()) + "]"


def masked(col):
    """Every form that the text holds in turn, longest first: its first occurrence is blanked."""
    held = f"LIST_FILTER({_FIRSTS}, lambda s: CONTAINS(REGEXP_REPLACE(LOWER({col}), '[,\\s]+', ' ', 'g'), s.f))"
    return f"LIST_REDUCE(LIST_PREPEND({col}, LIST_TRANSFORM({held}, lambda s: s.p)), lambda acc, p: REGEXP_REPLACE(acc, p, ' _CLASS_ '))"


def ordered(col):
    return f"LIST_FILTER({col}, lambda x, i: LIST_POSITION({col}, x) = i)"


def contained(col):
    return f"LIST_TRANSFORM(LIST_FILTER({FORM_LIST}, lambda s: CONTAINS(LOWER({col}), s.f)), lambda s: s.c)"


def split_options(col):
    return (f"REGEXP_EXTRACT_ALL({col}, {q(V.OPTION_LETTER)}, 1) AS letters, "
            f"LIST_TRANSFORM(REGEXP_SPLIT_TO_ARRAY({col}, {q(V.OPTION_MARK)})[2:], lambda t: REGEXP_REPLACE(TRIM(t), '\\.+$', '')) AS texts")


STEM = f"CASE WHEN {rx('input', V.FIRST_OPTION)} THEN REGEXP_SPLIT_TO_ARRAY(input, {q(V.FIRST_OPTION)})[1] ELSE SPLIT_PART(input, '?', 1) END"
SEG = (f"CASE WHEN {rx('input', V.FIRST_OPTION)} THEN SUBSTR(input, LENGTH(stem) + 1) WHEN CONTAINS(input, '?') THEN SUBSTR(input, LENGTH(stem) + 2) ELSE '' END")

_CASCADE = (
    ("is_mcq AND " + rx("cue", V.METADATA_CUE), "metadata_mcq", "metadata_cue"), (rx("cue", V.RELATIVE_CUE), "relative_position", "relative_cue"),
    (rx("cue", V.ADJACENCY_CUE), "adjacency", "adjacency_synonym"),
    (rx("cue", V.PERCENT_VALUE) + " OR " + rx("cue", V.SQUARE_METRE_VALUE), "area", "area_quantity"),
    (rx("cue", V.COUNT_SHAPE), "count", "count_shape"), (rx("cue", V.COUNT_CUE), "count", "count_cue"),
    (rx("cue", V.COMPLEMENT_CUE), "area", "complement_form"),
    (f"REGEXP_MATCHES(REGEXP_REPLACE(cue, {q(V.LAND_COVER_WORDS)}, ' ', 'g'), {q(V.AREA_CUE)})", "area", "area_cue"),
    (rx("cue", V.PRESENCE_CUE), "presence", "presence_cue"), ("is_mcq", "presence", "mcq_default_presence"))
INTENT = "CASE " + " ".join(f"WHEN {c} THEN {q(i)}" for c, i, _ in _CASCADE) + " END"
RULE = "CASE " + " ".join(f"WHEN {c} THEN {q(r)}" for c, _, r in _CASCADE) + " END"


def area_sql(col):
    """(raw, unit, value, as_percent) expressions of a stated area."""
    p, m = rx(col, V.PERCENT_VALUE), rx(col, V.SQUARE_METRE_VALUE)
    pv, mv = f"TRY_CAST({grp(col, V.PERCENT_VALUE, 1)} AS DOUBLE)", num(col, V.SQUARE_METRE_VALUE, 1)
    return (f"CASE WHEN {p} THEN {grp(col, V.PERCENT_VALUE, 0)} WHEN {m} THEN {grp(col, V.SQUARE_METRE_VALUE, 0)} END",
            f"CASE WHEN {p} THEN 'percent' WHEN {m} THEN 'm2' END", f"CASE WHEN {p} THEN {pv} WHEN {m} THEN {mv} END",
            f"CASE WHEN {p} THEN {pv} WHEN {m} THEN 100.0::DOUBLE * {mv} / 1440000 END")


def count_sql(col, words=V.NUMBER_WORDS):
    raw = ("CASE " + " ".join(f"WHEN REGEXP_MATCHES(LOWER({col}), '\\b{w}\\b') THEN {q(w)}" for w, _ in words)
           + f" WHEN REGEXP_MATCHES({col}, '\\b(\\d+)\\b') THEN REGEXP_EXTRACT({col}, '\\b(\\d+)\\b', 1) END")
    value = ("CASE " + " ".join(f"WHEN REGEXP_MATCHES(LOWER({col}), '\\b{w}\\b') THEN {n}::DOUBLE" for w, n in words)
             + f" WHEN REGEXP_MATCHES({col}, '\\b(\\d+)\\b') THEN TRY_CAST(REGEXP_EXTRACT({col}, '\\b(\\d+)\\b', 1) AS DOUBLE) END")
    return raw, value


def qual_sql(col):
    return (f"LOWER(CASE WHEN {rx(col, V.QUALIFIER_PHRASE)} THEN {grp(col, V.QUALIFIER_PHRASE, 1)} "
            f"WHEN {rx(col, V.QUALIFIER_BARE)} THEN {grp(col, V.QUALIFIER_BARE, 1)} END)")


def cmp_sql(col, table=V.COMPARATORS):
    return first_hit(col, table)


_A = area_sql("cue")
_C = count_sql("cue")
_B = V.BETWEEN_RANGE
_KEEP = "k IN ('metadata', 'option_classes', 'full')"


def _bound(i):
    v = num("cue", _B, i)
    return f"CASE WHEN m2r THEN 100.0::DOUBLE * {v} / 1440000 WHEN intent = 'area' THEN {v} END"


SPEC = [
    f"s0 AS (SELECT *, {STEM} AS stem FROM ann)",
    f"s1 AS (SELECT *, {SEG} AS seg FROM s0)",
    f"s2 AS (SELECT *, {split_options('seg')}, {raw_mentions('stem')} AS m_stem, {raw_mentions('input')} AS m_all, "
    f"{raw_mentions(grp('input', V.REF_TAG, 1))} AS m_ref, {grp('input', V.REF_TAG, 1)} AS ref, "
    f"{masked('stem')} AS cue FROM s1)",
    f"s3 AS (SELECT *, LEN(letters) = 4 AS is_mcq, {ordered('m_stem')} AS classes, {ordered('m_all')} AS all_classes, {ordered('m_ref')} AS ref_classes FROM s2)",
    f"s4 AS (SELECT *, {INTENT} AS h_intent, {RULE} AS h_rule, CASE WHEN LEN(ref_classes) > 0 THEN ref_classes ELSE all_classes END AS ref_pick FROM s3)",
    "s5 AS (SELECT *, CASE WHEN h_intent IN ('adjacency', 'relative_position') THEN 2 ELSE 1 END AS need FROM s4)",
    f"s6 AS (SELECT *, CASE WHEN is_mcq AND LEN(classes) < need THEN LIST_FILTER(LIST_TRANSFORM(texts, lambda t: {raw_mentions('t')}), lambda a: LEN(LIST_DISTINCT(a)) >= need)[1] END AS fo FROM s5)",
    f"s7 AS (SELECT *, CASE WHEN input IS NULL OR TRIM(input) = '' THEN 'empty' WHEN LENGTH(input) > 4000 THEN 'long' WHEN {rx('input', V.POINT_TAG)} THEN 'point' "
    f"WHEN {rx('input', V.REF_TAG)} THEN CASE WHEN LEN(ref_pick) > 0 THEN 'ref' ELSE 'ref_none' END WHEN NOT is_mcq AND {rx('cue', V.CAPTION_CUE)} THEN 'caption' "
    "WHEN h_intent IS NULL THEN 'no_cue' WHEN h_intent = 'metadata_mcq' THEN 'metadata' WHEN fo IS NOT NULL THEN 'option_classes' WHEN LEN(classes) = 0 THEN 'no_class' "
    "WHEN need = 2 AND LEN(classes) < 2 THEN 'one_class' ELSE 'full' END AS k FROM s6)",
    f"s8 AS (SELECT *, CASE WHEN k = 'point' THEN 'referring_point' WHEN k = 'ref' THEN 'referring_expr' WHEN k = 'caption' THEN 'caption' WHEN {_KEEP} THEN h_intent END AS intent, "
    f"k = 'full' AND NOT is_mcq AND h_intent IN ('area', 'count') AND {rx('cue', _B)} AS ranged, h_intent = 'area' AND {rx('cue', V.SQUARE_METRE_VALUE)} AS m2r, "
    "k = 'full' AND NOT is_mcq AS free FROM s7)",
    "spec AS MATERIALIZED (SELECT id, type, category, intent, CASE WHEN k IN ('point', 'ref') THEN 'bbox' WHEN k = 'caption' THEN 'free_text' "
    f"WHEN {_KEEP} THEN CASE WHEN is_mcq THEN 'mcq_letter' ELSE 'yes_no' END END AS answer_format, "
    "CASE k WHEN 'point' THEN all_classes[1] WHEN 'ref' THEN ref_pick[1] WHEN 'option_classes' THEN fo[1] WHEN 'full' THEN classes[1] END AS class_a, "
    "CASE WHEN k = 'option_classes' AND need = 2 THEN LIST_FILTER(fo, lambda y: y <> fo[1])[1] WHEN k = 'full' THEN classes[2] END AS class_b, "
    f"CASE WHEN k = 'point' THEN {qual_sql('input')} WHEN k = 'ref' THEN {qual_sql('ref')} WHEN k IN ('option_classes', 'full') THEN {qual_sql('cue')} END AS qualifier, "
    f"CASE WHEN ranged THEN 'between' WHEN free AND intent IN ('area', 'count') THEN {cmp_sql('cue')} END AS comparator, "
    f"CASE WHEN ranged THEN {grp('cue', _B, 0)} WHEN free AND intent = 'area' THEN {_A[0]} WHEN free AND intent = 'count' THEN {_C[0]} END AS stated_raw, "
    f"CASE WHEN ranged THEN CASE WHEN m2r THEN 'm2' WHEN intent = 'area' THEN 'percent' ELSE 'count' END WHEN free AND intent = 'area' THEN {_A[1]} "
    f"WHEN free AND intent = 'count' AND ({_C[0]}) IS NOT NULL THEN 'count' END AS stated_unit, "
    f"CASE WHEN ranged THEN {num('cue', _B, 1)} WHEN free AND intent = 'area' THEN {_A[2]} WHEN free AND intent = 'count' THEN {_C[1]} END AS stated_number, "
    f"CASE WHEN ranged THEN {_bound(1)} WHEN free AND intent = 'area' THEN {_A[3]} END AS stated_percent, "
    f"CASE WHEN ranged THEN {num('cue', _B, 2)} END AS upper_number, CASE WHEN ranged THEN {_bound(2)} END AS upper_percent, "
    f"CASE WHEN k IN ('point', 'ref', 'caption', 'metadata', 'option_classes') THEN FALSE WHEN k = 'full' THEN {rx('cue', V.NEGATION_CUE)} END AS negated, "
    f"CASE WHEN k = 'point' THEN TRY_CAST({grp('input', V.POINT_TAG, 1)} AS DOUBLE) END AS point_x, CASE WHEN k = 'point' THEN TRY_CAST({grp('input', V.POINT_TAG, 2)} AS DOUBLE) END AS point_y, "
    "CASE k WHEN 'point' THEN 'point_tag' WHEN 'ref' THEN 'ref_tag' WHEN 'caption' THEN 'caption_cue' WHEN 'option_classes' THEN h_rule || '+option_classes' "
    "WHEN 'metadata' THEN h_rule WHEN 'full' THEN h_rule END AS matched_rule, "
    f"CASE WHEN {_KEEP} THEN ARRAY_TO_STRING(LIST_TRANSFORM(RANGE(1, LEN(letters) + 1), lambda i: letters[i] || '=' || texts[i]), '|') END AS options, "
    "CASE k WHEN 'empty' THEN 'empty question' WHEN 'long' THEN 'question exceeds 4000 chars' WHEN 'ref_none' THEN '<ref> tag resolved to no class' WHEN 'no_cue' THEN 'no intent cue matched' "
    "WHEN 'no_class' THEN 'no class name resolved in the stem' WHEN 'one_class' THEN h_intent || ' needs two classes, found ' || LEN(classes) END AS reason FROM s8)",
]

_TC = count_sql("input", V.TASK_NUMBER_WORDS)
TASKSPEC = [
    f"t0 AS (SELECT *, type || '|' || category AS task, CASE WHEN CONTAINS(input, '?') THEN SUBSTR(input, LENGTH(SPLIT_PART(input, '?', 1)) + 2) ELSE input END AS seg, {raw_mentions('input', SUB)} AS m FROM ann)",
    f"t1 AS (SELECT *, {split_options('seg')}, {ordered('m')} AS classes FROM t0)",
    "t2 AS (SELECT *, CASE WHEN category IN ('country', 'season', 'climate zone') THEN 'metadata task: not geometry-derived' WHEN type = 'mcq' AND LEN(letters) <> 4 "
    "THEN 'expected 4 options, parsed ' || LEN(letters) WHEN type NOT IN ('mcq', 'binary') THEN 'unsupported task kind: ' || type END AS reason FROM t1)",
    "t3 AS (SELECT *, reason IS NULL AND type = 'binary' AS bin, reason IS NULL AND type = 'mcq' AS mcq FROM t2)",
    f"tspec AS MATERIALIZED (SELECT id, patch_id, input, output, split, type, category, task, classes, letters, texts, reason, mcq, CASE WHEN bin THEN {cmp_sql('input', V.TASK_COMPARATORS)} END AS comparator, "
    f"CASE WHEN bin THEN {num('input', V.TASK_BETWEEN, 1)} END AS range_lo, CASE WHEN bin THEN {num('input', V.TASK_BETWEEN, 2)} END AS range_hi, "
    f"CASE WHEN bin THEN CASE WHEN {rx('input', V.TASK_PERCENT)} THEN TRY_CAST({grp('input', V.TASK_PERCENT, 1)} AS DOUBLE) ELSE 100.0::DOUBLE * {num('input', V.TASK_SQUARE_METRE, 1)} / 1440000 END END AS threshold_pct, "
    f"CASE WHEN bin THEN {_TC[1]} END AS threshold_n, CASE WHEN bin THEN {rx('input', V.TASK_COMPLEMENT)} END AS complement, CASE WHEN bin THEN {rx('input', V.TASK_ONLY_ONE)} END AS only_one, "
    f"CASE WHEN bin THEN {rx('input', V.TASK_MULTIPLE)} END AS multiple, CASE WHEN bin THEN {rx('input', V.TASK_SQUARE_METRE)} END AS is_m2_unit FROM t3)",
]
DIRECTION = "CASE " + " ".join(f"WHEN CONTAINS(LOWER(text), {q(p)}) THEN {q(d)}" for p, d in V.DIRECTION_PHRASES) + " END"
DEGREES = "MAP {" + ", ".join(f"{q(k)}: {v}" for k, v in V.COMPASS_DEGREES.items()) + "}"


def gap_sql(a, b):
    d = f"ABS({DEGREES}[{a}] - {DEGREES}[{b}])"
    return f"LEAST({d}, 360 - {d})"
