"""DuckDB text of the answering rules over `tspec`, `fact` and `adj`."""

from __future__ import annotations

from groundtally.plans.questionsql import DIRECTION, TASKSPEC, contained, gap_sql
from groundtally.functions import fixed_values as V
from groundtally.plans.questionsql import grp, num, rx
from groundtally.plans.regionsql import adjacency_cte, bearing_sql, compass_sql, fact_cte, region_ctes
from groundtally.plans.sqlviews import ANNOTATIONS, C19, q

_CMP = ("CASE comparator WHEN 'ge' THEN {v} >= {t} WHEN 'le' THEN {v} <= {t} WHEN 'gt' THEN {v} > {t} WHEN 'lt' THEN {v} < {t} WHEN 'eq' THEN {v} = {t} END")


def compare_sql(v, t):
    return _CMP.format(v=v, t=t)


_YES = "CASE WHEN v THEN 'yes' WHEN NOT v THEN 'no' END"
_SCALE = "CASE WHEN is_m2_unit THEN 100.0::DOUBLE * {0} / 1440000 ELSE {0} END"
_NULLS = "NULL::VARCHAR AS answer, NULL::DOUBLE AS computed"

ANSWERS = [
    "nf AS MATERIALIZED (SELECT f.*, c.class_name FROM fact f JOIN c19 c USING (cls))",
    "np AS MATERIALIZED (SELECT a.patch_id, x.class_name AS name_a, y.class_name AS name_b, a.overlap_px FROM adj a JOIN c19 x ON x.cls = a.class_a JOIN c19 y ON y.cls = a.class_b)",
    "tgt AS MATERIALIZED (SELECT t.*, t.classes[1] AS target, COALESCE(f.n_regions, 0) AS n_regions, COALESCE(f.coverage_pct, 0)::DOUBLE AS coverage_pct FROM tspec t "
    "LEFT JOIN nf f ON f.patch_id = t.patch_id AND f.class_name = t.classes[1])",
    f"bm AS (SELECT *, CASE WHEN target IS NULL THEN NULL WHEN category = 'presence' THEN n_regions > 0 WHEN category = 'count' THEN CASE WHEN only_one THEN n_regions = 1 "
    f"WHEN multiple THEN n_regions >= 2 ELSE {compare_sql('n_regions', 'threshold_n')} END ELSE CASE WHEN complement THEN coverage_pct < 100 "
    f"WHEN range_lo IS NOT NULL AND range_hi IS NOT NULL THEN coverage_pct >= {_SCALE.format('range_lo')} AND coverage_pct <= {_SCALE.format('range_hi')} "
    f"ELSE {compare_sql('coverage_pct', 'threshold_pct')} END END AS v FROM tgt WHERE reason IS NULL AND type = 'binary' AND category IN ('presence', 'count', 'area'))",
    "opt AS MATERIALIZED (SELECT id, patch_id, task, category, input, n_regions, coverage_pct, target, classes, UNNEST(letters) AS letter, UNNEST(texts) AS text, UNNEST(RANGE(LEN(letters))) AS pos FROM tgt WHERE mcq)",
    f"optc AS MATERIALIZED (SELECT *, {contained('text')} AS names FROM opt WHERE category IN ('presence', 'adjacency'))",
    "mp AS (SELECT o.id, o.letter, o.pos, COALESCE(f.area_px, 0) AS px, COALESCE(f.coverage, 0)::DOUBLE AS computed FROM optc o LEFT JOIN nf f ON f.patch_id = o.patch_id AND f.class_name = o.names[1] "
    "WHERE category = 'presence' AND LEN(classes) > 0 AND LEN(names) > 0)",
    f"mc AS (SELECT id, letter, pos, n_regions, ABS(n_regions - {num('text', V.TASK_INTEGER, 1)}) AS gap FROM opt WHERE category = 'count' AND target IS NOT NULL AND {rx('text', V.TASK_INTEGER)})",
    f"ma0 AS (SELECT *, CASE WHEN CONTAINS(text, '%') THEN {num('text', V.TASK_RANGE, 1)} ELSE 100.0::DOUBLE * {num('text', V.TASK_RANGE, 1)} / 1440000 END AS lo, "
    f"CASE WHEN CONTAINS(text, '%') THEN {num('text', V.TASK_RANGE, 2)} ELSE 100.0::DOUBLE * {num('text', V.TASK_RANGE, 2)} / 1440000 END AS hi FROM opt "
    f"WHERE category = 'area' AND target IS NOT NULL AND {rx('text', V.TASK_RANGE)})",
    "ma AS (SELECT id, letter, pos, coverage_pct, CASE WHEN coverage_pct BETWEEN lo AND hi THEN 0 ELSE LEAST(ABS(coverage_pct - lo), ABS(coverage_pct - hi)) END AS gap FROM ma0)",
    "mj AS (SELECT o.id, o.letter, o.pos, p.overlap_px FROM optc o JOIN np p ON p.patch_id = o.patch_id AND p.name_a = o.names[1] "
    "AND p.name_b = LIST_FILTER(o.names, lambda y: y <> o.names[1])[1] WHERE category = 'adjacency' AND LEN(classes) >= 2 AND p.overlap_px > 0)",
    f"rp0 AS (SELECT t.id, t.patch_id, t.task, t.classes, CASE WHEN REGEXP_MATCHES(SPLIT_PART(input, '?', 1), {q(V.SUBJECT_SECOND)}) THEN t.classes[2] ELSE t.classes[1] END AS subject, "
    f"CASE WHEN REGEXP_MATCHES(SPLIT_PART(input, '?', 1), {q(V.SUBJECT_SECOND)}) THEN t.classes[1] ELSE t.classes[2] END AS other FROM tspec t WHERE mcq AND category = 'relative pos')",
    f"rp AS MATERIALIZED (SELECT id, patch_id, task, classes, CASE WHEN NOT (dr = 0 AND dc = 0) THEN {compass_sql('ang', '16.0::DOUBLE')} END AS direction FROM (SELECT *, {bearing_sql('dr', 'dc')} AS ang FROM ("
    "SELECT r.*, a.mask_row - b.mask_row AS dr, a.mask_col - b.mask_col AS dc FROM rp0 r LEFT JOIN nf a ON a.patch_id = r.patch_id AND a.class_name = r.subject "
    "LEFT JOIN nf b ON b.patch_id = r.patch_id AND b.class_name = r.other)))",
    f"rg AS (SELECT id, letter, pos, {gap_sql('direction', 'way')} AS gap FROM (SELECT r.id, r.direction, o.letter, o.pos, {DIRECTION.replace('text', 'o.text')} AS way FROM rp r JOIN opt o USING (id) WHERE r.direction IS NOT NULL))",
    "rgm AS (SELECT id, MIN(gap) AS gap, ARG_MIN(letter, pos) FILTER (gap = 0) AS exact FROM rg GROUP BY id)",
    "rgt AS (SELECT g.id, MIN(g.letter) AS letter, COUNT(*) AS tied FROM rg g JOIN rgm m ON m.id = g.id AND m.gap = g.gap GROUP BY g.id)",
    "rel AS MATERIALIZED (SELECT r.id, r.patch_id, r.task, COALESCE(m.exact, t.letter) AS answer, CASE WHEN LEN(classes) < 2 THEN 'relative position needs two classes' "
    "WHEN direction IS NULL THEN 'one class absent; direction undefined' WHEN m.gap IS NULL THEN 'no option parsed as a direction' END AS reason, "
    "CASE WHEN LEN(classes) >= 2 THEN direction END AS direction, CASE WHEN m.exact IS NULL THEN t.tied END AS tied FROM rp r LEFT JOIN rgm m USING (id) LEFT JOIN rgt t USING (id))",
    "ans AS MATERIALIZED ("
    f"SELECT id, patch_id, task, {_NULLS}, reason FROM tspec WHERE reason IS NOT NULL UNION ALL "
    f"SELECT id, patch_id, task, {_YES}, CASE WHEN v IS NOT NULL THEN CASE WHEN category = 'area' THEN coverage_pct ELSE n_regions END END, CASE WHEN target IS NULL THEN 'no class name resolved' "
    "WHEN v IS NULL AND (CASE WHEN category = 'count' THEN threshold_n ELSE threshold_pct END) IS NULL THEN category || ' question with no threshold' WHEN v IS NULL THEN category || ' question with no comparator' END FROM bm UNION ALL "
    "SELECT t.id, t.patch_id, t.task, CASE WHEN LEN(classes) >= 2 THEN CASE WHEN COALESCE(p.overlap_px, 0) > 0 THEN 'yes' ELSE 'no' END END, CASE WHEN LEN(classes) >= 2 THEN COALESCE(p.overlap_px, 0)::DOUBLE END, "
    "CASE WHEN LEN(classes) < 2 THEN 'adjacency needs two classes' END FROM tspec t LEFT JOIN np p ON p.patch_id = t.patch_id AND p.name_a = t.classes[1] AND p.name_b = t.classes[2] "
    "WHERE t.reason IS NULL AND t.task = 'binary|adjacency' UNION ALL "
    "SELECT t.id, t.patch_id, t.task, b.l, b.c, CASE WHEN target IS NULL THEN 'no class name resolved' WHEN b.l IS NULL THEN 'no MCQ option resolved to a class' END FROM tgt t LEFT JOIN "
    "(SELECT id, ARG_MIN(letter, -px * 10 + pos) AS l, ARG_MIN(computed, -px * 10 + pos) AS c FROM mp GROUP BY id) b USING (id) WHERE mcq AND category = 'presence' UNION ALL "
    "SELECT t.id, t.patch_id, t.task, b.l, CASE WHEN b.l IS NOT NULL THEN t.n_regions::DOUBLE END, CASE WHEN target IS NULL THEN 'no class name resolved' WHEN b.l IS NULL THEN 'no numeric MCQ option' END FROM tgt t LEFT JOIN "
    "(SELECT id, ARG_MIN(letter, gap * 10 + pos) AS l FROM mc GROUP BY id) b USING (id) WHERE mcq AND category = 'count' UNION ALL "
    "SELECT t.id, t.patch_id, t.task, b.letter, CASE WHEN b.letter IS NOT NULL THEN t.coverage_pct END, CASE WHEN target IS NULL THEN 'no class name resolved' WHEN b.letter IS NULL THEN 'no range MCQ option' END FROM tgt t LEFT JOIN "
    "(SELECT id, letter FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY gap, pos) AS rn FROM ma) WHERE rn = 1) b USING (id) WHERE mcq AND category = 'area' UNION ALL "
    "SELECT t.id, t.patch_id, t.task, b.l, NULL, CASE WHEN LEN(classes) < 2 THEN 'adjacency needs two classes' WHEN b.l IS NULL THEN 'no MCQ option yielded two classes' END FROM tspec t LEFT JOIN "
    "(SELECT id, ARG_MIN(letter, -overlap_px * 10 + pos) AS l FROM mj GROUP BY id) b USING (id) WHERE mcq AND category = 'adjacency' UNION ALL "
    "SELECT id, patch_id, task, answer, NULL, reason FROM rel)",
    "sa AS MATERIALIZED (SELECT a.id, a.patch_id, a.task, a.answer AS predicted, n.output AS truth, COALESCE(a.answer = n.output, FALSE) AS correct, a.answer IS NULL AS abstained, "
    "COALESCE(a.reason, '') AS reason, n.split FROM ans a JOIN ann n USING (id))",
]
BASE = [*region_ctes(), fact_cte(), adjacency_cte(), C19, ANNOTATIONS, *TASKSPEC, *ANSWERS]
