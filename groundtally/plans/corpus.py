"""Queries I1-I26: profiling of the annotation corpus."""

from __future__ import annotations

import re

from groundtally.functions import dims
from groundtally.functions import fixed_values as V
from groundtally.operators import profile as P
from groundtally.plans.questionsql import grp, num, ordered, raw_mentions, rx, split_options
from groundtally.plans.sqlviews import ANNOTATIONS, chain, first_hit, q
from groundtally.sources import fixture as fx

COLUMNS = ["id", "s1_name", "patch_id", "input", "output", "type", "category", "split", "latitude", "longitude", "country", "season", "climate_zone"]


def on(fn, *args):
    return lambda spark, sf: fn(fx.open_annotations(spark, sf), *args)


def i6(spark, sf):
    v = P.vocabulary(fx.open_annotations(spark, sf))
    return P.overlaps(v, [("label", "ref"), ("label", "option"), ("ref", "option")])


QUERIES = {
    "I1_column_profile": on(P.column_profile, COLUMNS), "I2_length_quantiles": on(P.length_quantiles, ["input", "output"]),
    "I3_templates": on(P.templates), "I4_answer_vocabulary": on(P.answer_vocabulary), "I5_vocabulary": on(P.vocabulary), "I6_vocabulary_overlap": i6,
    "I7_term_hits": on(P.term_hits), "I8_unit_hits": on(P.unit_hits), "I9_numeric_mentions": on(P.numeric_mentions),
    "I10_granularity": lambda s, d: P.granularity(P.numeric_mentions(fx.open_annotations(s, d))),
    "I11_value_gaps": lambda s, d: P.value_gaps(P.numeric_mentions(fx.open_annotations(s, d))),
    "I12_comparator_shares": on(P.comparator_shares), "I13_comparator_words": on(P.comparator_words), "I14_option_spacing": on(P.option_spacing),
    "I15_near_misses": on(P.near_misses), "I16_referring_qualifiers": on(P.referring_qualifiers), "I17_category_words": on(P.category_words),
    "I18_answer_priors": on(P.answer_priors), "I19_label_circularity": on(P.label_circularity), "I20_value_leak": on(P.value_leak),
    "I21_option_forms": on(P.option_forms), "I22_question_forms": on(P.question_forms), "I23_residual_skeletons": on(P.residual_skeletons),
    "I24_inclusivity": on(P.inclusivity), "I25_clean_attribution": on(P.attribution), "I26_surface_forms": on(P.surface_forms),
}

def _shown(column):
    return f"CAST({column} AS DECIMAL(18, 6))::VARCHAR" if column in ("latitude", "longitude") else f"{column}::VARCHAR"


A = chain(ANNOTATIONS)
_SKEL = "REGEXP_REPLACE(input, '\\d[\\d,\\.]*', '<N>', 'g')"
_SEG = "CASE WHEN CONTAINS(input, '?') THEN SUBSTR(input, LENGTH(SPLIT_PART(input, '?', 1)) + 2) ELSE input END"
_OPT = f"op AS MATERIALIZED (SELECT *, {split_options('seg')} FROM (SELECT *, {_SEG} AS seg FROM ann))"
_NORM = "REGEXP_REPLACE(REPLACE(REGEXP_REPLACE(TRIM(LOWER({0})), '\\.+$', ''), ',', ''), '\\s+', ' ', 'g')"


def _top(inner, value, keep, cols):
    return (f"SELECT {cols} FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY task ORDER BY n DESC, {value}) AS INT) AS rank, CAST(SUM(n) OVER (PARTITION BY task) AS BIGINT) AS rows, "
            f"COUNT(*) OVER (PARTITION BY task) AS distinct_values, n::DOUBLE / SUM(n) OVER (PARTITION BY task) AS share FROM ({inner})) WHERE rank <= {keep}")


_ANS = "SELECT type || '|' || category AS task, CASE WHEN LENGTH(output) < 40 THEN output ELSE '<LONG>' END AS answer, COUNT(*) AS n FROM ann GROUP BY ALL"
VOCAB = (f"vo AS MATERIALIZED (SELECT kind, term, COUNT(*) AS n FROM (SELECT 'label' AS kind, LOWER(UNNEST({ordered('m')})) AS term FROM (SELECT {raw_mentions('input')} AS m FROM ann) UNION ALL "
         f"SELECT 'ref', LOWER(TRIM(UNNEST(REGEXP_EXTRACT_ALL(input, {q(V.REF_TAG)}, 1)))) FROM ann UNION ALL SELECT 'option', LOWER(UNNEST(texts)) FROM op WHERE type = 'mcq' AND category = 'presence') GROUP BY ALL)")
_NUMS = (f"nu AS MATERIALIZED (SELECT task, unit, value, COUNT(*) AS n FROM (SELECT type || '|' || category AS task, 'm2' AS unit, TRY_CAST(REPLACE(UNNEST(REGEXP_EXTRACT_ALL(input, {q(V.PROFILE_SQUARE_METRE)}, 1)), ',', '') AS DOUBLE) AS value FROM ann WHERE category = 'area' "
         f"UNION ALL SELECT type || '|' || category, 'percent', TRY_CAST(UNNEST(REGEXP_EXTRACT_ALL(input, {q(V.TASK_PERCENT)}, 1)) AS DOUBLE) FROM ann WHERE category = 'area') GROUP BY ALL)")
_BIN = "bi AS (SELECT * FROM ann WHERE type = 'binary' AND category IN ('area', 'count'))"
_RNG = (f"rg AS MATERIALIZED (SELECT id, category, {rx('t', V.OPTION_RANGE_UNIT)} AS ranged, {num('t', V.OPTION_RANGE_UNIT, 1)} AS lo, {num('t', V.OPTION_RANGE_UNIT, 2)} AS hi, {num('t', V.TASK_INTEGER, 1)} AS pt "
        "FROM (SELECT id, category, UNNEST(texts) AS t FROM op WHERE type = 'mcq' AND category IN ('area', 'count')))")
_STATED = f"CASE WHEN {rx('input', V.TASK_PERCENT)} THEN TRY_CAST({grp('input', V.TASK_PERCENT, 1)} AS DOUBLE) WHEN {rx('input', V.PROFILE_SQUARE_METRE)} THEN {num('input', V.PROFILE_SQUARE_METRE, 1)} / 14400.0::DOUBLE END"
_THR = f"ROUND(CASE WHEN {rx('input', V.TASK_PERCENT)} THEN TRY_CAST({grp('input', V.TASK_PERCENT, 1)} AS DOUBLE) WHEN {rx('input', V.TASK_SQUARE_METRE)} THEN {num('input', V.TASK_SQUARE_METRE, 1)} / 14400.0::DOUBLE END, 4)"
_HITS = "LIST_FILTER([" + ", ".join(q(n.lower()) for n in dims.C19_NAMES) + "], lambda c: CONTAINS(LOWER(input), c))"
_CLEAN = f"cl AS MATERIALIZED (SELECT *, CASE WHEN LEN(k) = 1 THEN k[1] END AS class_name FROM (SELECT *, LIST_FILTER(h, lambda c: LEN(LIST_FILTER(h, lambda d: d <> c AND CONTAINS(d, c))) = 0) AS k FROM (SELECT *, {_HITS} AS h FROM ann WHERE type = 'binary' AND category = 'area')))"
_TC = V.TASK_COMPARATORS
_TERMS = ([(f"l1:{t}", f"CONTAINS(LOWER(input), {q(t)})") for t in V.GROUP_NAMES_L1] + [(f"l2:{t}", f"CONTAINS(LOWER(input), {q(t)})") for t in V.GROUP_NAMES_L2]
          + [(f"l3:{t}", f"REGEXP_MATCHES(LOWER(input), {q(chr(92) + 'b' + re.escape(t) + chr(92) + 'b')})") for t in V.NAMES_OUTSIDE_C19])
_STRIP = V.QUALIFIER_PHRASE.replace(r"(?i)\b", r"(?i)^") + r"\s+(?:of|in)\s+"
_CANON = ", ".join(f"({i}, {q(n)}, {q(dims.normal_form(n))})" for i, n in enumerate(dims.C19_NAMES))


def _union(rows):
    return " UNION ALL ".join(rows)


ORACLES = {
    "I1_column_profile": A + _union(
        f"SELECT '{c}' AS \"column\", COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {_shown(c)}) AS cardinality, MIN({_shown(c)}) AS first_value, MAX({_shown(c)}) AS last_value, "
        f"100.0::DOUBLE * (COUNT(*) - COUNT({c})) / COUNT(*) AS null_pct, (SELECT STRING_AGG(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT {_shown(c)} AS v FROM ann WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS examples FROM ann" for c in COLUMNS),
    "I2_length_quantiles": A + _union(f"SELECT '{c}' AS \"column\", MIN(LENGTH({c})) AS min, QUANTILE_CONT(LENGTH({c}), 0.5) AS p50, QUANTILE_CONT(LENGTH({c}), 0.95) AS p95, MAX(LENGTH({c})) AS max FROM ann" for c in ("input", "output")),
    "I3_templates": A + _top(f"SELECT type || '|' || category AS task, {_SKEL} AS skeleton, COUNT(*) AS n FROM ann GROUP BY ALL", "skeleton", 8, "*"),
    "I4_answer_vocabulary": A + _top(_ANS, "answer", 25, "*"),
    "I5_vocabulary": chain(ANNOTATIONS, _OPT, VOCAB) + "SELECT * FROM vo",
    "I6_vocabulary_overlap": chain(ANNOTATIONS, _OPT, VOCAB, f"nm AS (SELECT DISTINCT kind, {_NORM.format('term')} AS term FROM vo)") + _union(
        f"SELECT '{a}' AS left_kind, '{b}' AS right_kind, (SELECT COUNT(*) FROM (SELECT term FROM nm WHERE kind = '{a}' INTERSECT SELECT term FROM nm WHERE kind = '{b}')) AS \"both\", "
        f"(SELECT COUNT(*) FROM (SELECT term FROM nm WHERE kind = '{a}' EXCEPT SELECT term FROM nm WHERE kind = '{b}')) AS left_only, "
        f"(SELECT COUNT(*) FROM (SELECT term FROM nm WHERE kind = '{b}' EXCEPT SELECT term FROM nm WHERE kind = '{a}')) AS right_only" for a, b in (("label", "ref"), ("label", "option"), ("ref", "option"))),
    "I7_term_hits": A + "SELECT * FROM (" + _union(f"SELECT {q(t)} AS term, COUNT(*) FILTER ({c}) AS n FROM ann" for t, c in _TERMS) + ") WHERE n > 0",
    "I8_unit_hits": A + _union(
        f"SELECT '{u}' AS unit, COUNT(*) FILTER ({rx('input', p)}) AS n, 'questions' AS scope FROM ann UNION ALL SELECT '{u}', COUNT(*) FILTER ({rx('input', p)}), type || '|' || category FROM ann WHERE category = 'area' GROUP BY 3 "
        f"UNION ALL SELECT '{u}', COUNT(*) FILTER ({rx('output', p)}), 'captions' FROM ann WHERE type = 'captioning'" for u, p in V.UNIT_MARKERS),
    "I9_numeric_mentions": chain(ANNOTATIONS, _NUMS) + "SELECT * FROM nu",
    "I10_granularity": chain(ANNOTATIONS, _NUMS) + f"SELECT nu.unit, step, SUM(CASE WHEN ABS(ROUND_EVEN(value / step, 0) - value / step) < 1e-9 THEN n ELSE 0 END)::DOUBLE / SUM(n) AS share, CAST(SUM(n) AS BIGINT) AS n "
        f"FROM nu JOIN (VALUES {', '.join(f'({q(u)}, {s}::DOUBLE)' for u, s in P.STEPS)}) s(unit, step) ON s.unit = nu.unit GROUP BY ALL",
    "I11_value_gaps": chain(ANNOTATIONS, _NUMS, "gp AS (SELECT unit, ROUND(value - LAG(value) OVER (PARTITION BY unit ORDER BY value), 4) AS gap FROM (SELECT DISTINCT unit, value FROM nu))",
        "gn AS (SELECT unit, gap, COUNT(*) AS n FROM gp WHERE gap IS NOT NULL GROUP BY ALL)") +
        "SELECT g.unit, MIN(gap) AS min_gap, QUANTILE_CONT(gap, 0.5) AS median_gap, (SELECT gap FROM gn WHERE gn.unit = g.unit ORDER BY n DESC, gap LIMIT 1) AS mode_gap FROM gp g WHERE gap IS NOT NULL GROUP BY g.unit",
    "I12_comparator_shares": chain(ANNOTATIONS, "hc AS (" + _union(
        f"SELECT type || '|' || category AS task, '{c}' AS comparator FROM ann WHERE category IN ('area', 'count') AND {rx('input', p)}" for c, p in V.PROFILE_COMPARATORS) +
        " UNION ALL SELECT type || '|' || category, 'none/equality' FROM ann WHERE category IN ('area', 'count') AND NOT (" + " OR ".join(rx("input", p) for _, p in V.PROFILE_COMPARATORS) + "))") +
        "SELECT task, comparator, COUNT(*) AS n, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY task) AS share FROM hc GROUP BY task, comparator",
    "I13_comparator_words": A + f"SELECT LOWER({grp('input', V.COMPARATOR_WORD, 1)}) || ' ' || LOWER({grp('input', V.COMPARATOR_WORD, 2)}) AS phrase, COUNT(*) AS n FROM ann WHERE type = 'binary' AND category = 'count' AND {rx('input', V.COMPARATOR_WORD)} GROUP BY 1",
    "I14_option_spacing": chain(ANNOTATIONS, _OPT, _RNG, "vv AS (SELECT DISTINCT id, category, CASE WHEN ranged THEN lo ELSE pt END AS v FROM rg)",
        "gg AS (SELECT category, ROUND(v - LAG(v) OVER (PARTITION BY id ORDER BY v), 4) AS value FROM vv WHERE v IS NOT NULL)") +
        "SELECT category, 'gap' AS kind, value, COUNT(*) AS n FROM gg WHERE value IS NOT NULL GROUP BY ALL UNION ALL SELECT category, 'width', ROUND(hi - lo, 4), COUNT(*) FROM rg WHERE ranged GROUP BY ALL",
    "I15_near_misses": chain(ANNOTATIONS, _BIN, f"st AS (SELECT id, patch_id, category, output, {_STATED} AS stated, {raw_mentions('input')}[1] AS class_name FROM bi)",
        "tr AS (SELECT patch_id, class_name, category, ARG_MIN(stated, id) AS truth FROM st WHERE output = 'yes' AND stated IS NOT NULL AND class_name IS NOT NULL GROUP BY ALL)",
        "dl AS (SELECT category, ROUND(ABS(stated - truth), 9) AS d FROM st JOIN tr USING (patch_id, class_name, category) WHERE output = 'no' AND stated IS NOT NULL)") +
        "SELECT category, COUNT(*) AS n, MIN(d) AS min, QUANTILE_CONT(d, 0.25) AS p25, QUANTILE_CONT(d, 0.5) AS median, QUANTILE_CONT(d, 0.75) AS p75, MAX(d) AS max FROM dl GROUP BY category",
    "I16_referring_qualifiers": A + "SELECT CASE WHEN REPLACE(REGEXP_EXTRACT(ref, '^(.*?)\\s+(?:of|in)\\s+(.*)$', 2), ',', '') IN (" + ", ".join(q(n.lower().replace(",", "")) for n in dims.C19_NAMES) +
        f") THEN REGEXP_EXTRACT(ref, '^(.*?)\\s+(?:of|in)\\s+(.*)$', 1) ELSE '<none>' END AS qualifier, COUNT(*) AS n FROM (SELECT LOWER(TRIM(UNNEST(REGEXP_EXTRACT_ALL(input, {q(V.REF_TAG)}, 1)))) AS ref FROM ann) GROUP BY 1",
    "I17_category_words": A + _union(f"SELECT {q(w)} AS word, COUNT(*) FILTER (CONTAINS(LOWER(input), {q(w)})) AS n FROM ann WHERE category = 'adjacency'" for w in V.ADJACENCY_WORDS),
    "I18_answer_priors": A + _top(_ANS, "answer", 4, "task, answer, n, rows, rank, share"),
    "I19_label_circularity": chain(ANNOTATIONS, _OPT) + "SELECT category, COUNT(*) AS n, COUNT(*) FILTER (LOWER(TRIM(c)) = LOWER(TRIM(v))) AS agree, COUNT(*) FILTER (LOWER(TRIM(c)) = LOWER(TRIM(v)))::DOUBLE / COUNT(*) AS rate FROM "
        "(SELECT category, texts[LIST_POSITION(letters, TRIM(output))] AS c, CASE category WHEN 'country' THEN country WHEN 'season' THEN season ELSE climate_zone END AS v FROM op WHERE type = 'mcq' AND category IN ('country', 'season', 'climate zone')) WHERE c IS NOT NULL GROUP BY category",
    "I20_value_leak": A + _union(f"SELECT '{c}' AS field, COUNT(*) FILTER (CONTAINS(LOWER(input), LOWER({c})) AND category <> '{c}') AS n FROM ann" for c in ("country", "season")),
    "I21_option_forms": chain(ANNOTATIONS, _OPT, _RNG) + "SELECT 'form' AS kind, CASE WHEN ranged THEN 'range' ELSE 'point' END AS value, COUNT(*) AS n FROM rg WHERE category = 'area' GROUP BY ALL UNION ALL "
        "SELECT 'endpoints', CASE WHEN ABS(hi - nx) < 1e-9 THEN 'touching' ELSE 'gapped' END, COUNT(*) FROM (SELECT hi, LEAD(lo) OVER (PARTITION BY id ORDER BY lo, hi) AS nx FROM rg WHERE category = 'area' AND ranged) WHERE nx IS NOT NULL GROUP BY ALL",
    "I22_question_forms": chain(ANNOTATIONS, _BIN) + f"SELECT category, form, COUNT(*) AS n, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY category) AS share FROM (SELECT category, CASE WHEN category = 'area' THEN {first_hit('input', V.AREA_FORMS, q('other'))} "
        f"ELSE {first_hit('input', V.COUNT_FORMS, q('other'))} END AS form FROM bi) GROUP BY category, form",
    "I23_residual_skeletons": chain(ANNOTATIONS, _BIN, f"rc AS (SELECT category, {_SKEL} AS skeleton, {first_hit('input', V.RESIDUAL_COMPARATORS)} AS c FROM bi)",
        "rn AS (SELECT category, skeleton, COUNT(*) AS n, CAST(ROW_NUMBER() OVER (PARTITION BY category ORDER BY COUNT(*) DESC, skeleton) AS INT) AS rank FROM rc WHERE c IS NULL GROUP BY category, skeleton)",
        "sc AS (SELECT category, COUNT(*) AS scanned, COUNT(*) FILTER (c IS NULL) AS residual FROM rc GROUP BY category)") +
        "SELECT category, skeleton, n, rank, scanned, residual, residual::DOUBLE / scanned AS residual_rate FROM rn JOIN sc USING (category) WHERE rank <= 25",
    "I24_inclusivity": chain(ANNOTATIONS, _CLEAN, f"fo AS (SELECT id, patch_id, output, class_name, {first_hit('input', (_TC[0], _TC[2], _TC[1], _TC[3]))} AS form, {_THR} AS th FROM cl)",
        "pv AS (SELECT " + ", ".join(f"ARG_MAX(output, id) FILTER (form = '{f}') AS {f}" for f in ("ge", "gt", "le", "lt")) + " FROM fo WHERE class_name IS NOT NULL AND form IS NOT NULL AND th IS NOT NULL GROUP BY patch_id, class_name, th)") +
        _union(f"SELECT '{a}/{b}' AS pair, CASE WHEN {a} = 'yes' AND {b} = 'no' THEN 'decisive' WHEN {a} = {b} THEN 'consistent' ELSE 'impossible' END AS verdict, COUNT(*) AS n FROM pv WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL" for a, b in (("ge", "gt"), ("le", "lt"))),
    "I25_clean_attribution": chain(ANNOTATIONS, _CLEAN) + "SELECT COALESCE(class_name, '<discarded>') AS class_name, COUNT(*) AS n FROM cl GROUP BY 1",
    "I26_surface_forms": chain(ANNOTATIONS, _OPT, f"sf AS (SELECT {_NORM.format('f')} AS form, COUNT(*) AS n FROM (SELECT REGEXP_REPLACE(TRIM(UNNEST(REGEXP_EXTRACT_ALL(input, {q(V.REF_TAG)}, 1))), {q(_STRIP)}, '') AS f FROM ann UNION ALL "
        "SELECT TRIM(UNNEST(REGEXP_SPLIT_TO_ARRAY(t, '\\band\\b'))) FROM (SELECT UNNEST(texts) AS t FROM op WHERE type = 'mcq' AND category IN ('presence', 'adjacency'))) WHERE f <> '' GROUP BY 1)",
        f"cn AS (SELECT * FROM (VALUES {_CANON}) v(pos, name, norm))",
        "pr AS (SELECT form, n, name, pos, form = norm OR form || 's' = norm OR form = norm || 's' AS same, LEN(LIST_INTERSECT(STRING_SPLIT(form, ' '), STRING_SPLIT(norm, ' ')))::DOUBLE / LEN(LIST_DISTINCT(LIST_CONCAT(STRING_SPLIT(form, ' '), STRING_SPLIT(norm, ' ')))) AS j FROM sf, cn)",
        "bs AS (SELECT form, n, ARG_MIN(name, pos) FILTER (same) AS exact, FIRST(name ORDER BY j DESC, pos) AS near, MAX(j) AS j FROM pr GROUP BY form, n)") +
        "SELECT form, n, COALESCE(exact, CASE WHEN j >= 0.55 THEN near END) AS class_name, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN j >= 0.55 THEN 'jaccard' ELSE 'unresolved' END AS how FROM bs",
}
