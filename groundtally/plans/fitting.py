"""Queries G6-G11, G13, G14: exhaustive sweeps of the measurement conventions."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundtally.functions import fixed_values as V
from groundtally.operators import fitting as T
from groundtally.plans.answers import facts
from groundtally.plans.answersql import ANSWERS
from groundtally.plans.questionsql import DIRECTION, TASKSPEC, gap_sql, num, rx
from groundtally.plans.regionsql import bearing_sql, compass_sql, fact_cte, offsets, region_ctes
from groundtally.plans.sqlviews import ANNOTATIONS, C19, chain, first_hit, q
from groundtally.session import cut_lineage
from groundtally.sources import fixture as fx

GRID_BANDS = sorted(set(range(0, 95, 5)) | set(range(0, 46)))
MATCH_BANDS = range(0, 46, 2)


def train(spark, sf):
    return fx.open_annotations(spark, sf).filter(F.col("split") == "train")


def rounded(df):
    return df.withColumn("per_group_acc", F.round("per_group_acc", 9))


def g6(spark, sf):
    return rounded(T.sweep_count(T.count_items(train(spark, sf)), fx.pixels(spark, sf)))


def g7(spark, sf):
    return rounded(T.sweep_interval_rule(T.area_items(train(spark, sf)), facts(spark, sf)))


def g8(spark, sf):
    return rounded(T.sweep_dilation(train(spark, sf), fx.pixels(spark, sf)))


def items(spark, sf):
    return cut_lineage(T.direction_items(train(spark, sf), facts(spark, sf)))


def g9(spark, sf):
    return T.orientation_fit(items(spark, sf))


def g10(spark, sf):
    return T.direction_grid(items(spark, sf), GRID_BANDS)


def g11(spark, sf):
    return T.diagonal_match(items(spark, sf), MATCH_BANDS)


def g13(spark, sf):
    return T.rule_decidability(items(spark, sf))


def g14(spark, sf):
    return T.residual_errors(items(spark, sf), "family")


def g14_folds(spark, sf):
    return T.residual_errors(items(spark, sf), "fold")


QUERIES = {
    "G6_connectivity_mmu_sweep": g6, "G7_interval_rule_sweep": g7, "G8_dilation_sweep": g8, "G9_orientation_fit": g9, "G10_direction_grid": g10,
    "G11_diagonal_match": g11, "G13_rule_decidability": g13, "G14_residual_by_family": g14, "G14_residual_by_fold": g14_folds,
}

_TRAIN = ANNOTATIONS.replace("WHERE split <> 'bench'", "WHERE split = 'train'")
_CHOSEN = "ch AS (SELECT id, patch_id, task, classes[1] AS class_name, texts[LIST_POSITION(letters, output)] AS text FROM tspec WHERE mcq AND LEN(classes) > 0 AND LIST_CONTAINS(letters, output))"
_ACC = "ROUND(AVG(h::DOUBLE / m), 9) AS per_group_acc, SUM(h)::DOUBLE / SUM(m) AS pooled_acc, CAST(SUM(m) AS BIGINT) AS n, COUNT(*) AS n_groups"
_PT = {"mask_centroid": ("mask_row", "mask_col"), "largest_component": ("big_row", "big_col"), "bbox_centre": ("box_row", "box_col")}
ITEMS = [
    f"o0 AS (SELECT id, letter, {DIRECTION} AS way FROM (SELECT id, UNNEST(letters) AS letter, UNNEST(texts) AS text FROM tspec WHERE mcq AND category = 'relative pos' AND LEN(classes) >= 2))",
    "o1 AS MATERIALIZED (SELECT * FROM o0 WHERE way IS NOT NULL)",
    f"i0 AS (SELECT t.id, t.patch_id, t.patch_id % 5 AS fold, t.classes, t.output AS truth, o.way AS truth_way, REGEXP_MATCHES(SPLIT_PART(input, '?', 1), {q(V.SUBJECT_SECOND)}) AS flip, "
    f"{first_hit('h', V.TEMPLATE_FAMILIES, q(V.DEFAULT_FAMILY))} AS family FROM (SELECT *, SPLIT_PART(input, '?', 1) AS h FROM tspec WHERE mcq AND category = 'relative pos' AND LEN(classes) >= 2) t JOIN o1 o ON o.id = t.id AND o.letter = t.output)",
    "i1 AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT i.*, classes[1] || '|' || classes[2] AS pair, '{rule}' AS rule, a.{r} - b.{r} AS dr, a.{c} - b.{c} AS dc FROM i0 i JOIN nf a ON a.patch_id = i.patch_id AND a.class_name = classes[1] "
        f"JOIN nf b ON b.patch_id = i.patch_id AND b.class_name = classes[2]" for rule, (r, c) in _PT.items()) + ")",
]
_BASE = [*region_ctes(), fact_cte(), C19, _TRAIN, *TASKSPEC, ANSWERS[0], *ITEMS]


def _pred(name, src, flip, band):
    """CTE adding dir, letter, exact to `src` rows (which carry a unique key `u`)."""
    s = f"(CASE WHEN {flip} THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)"
    return (f"{name} AS MATERIALIZED (WITH d AS (SELECT *, CASE WHEN NOT (dr = 0 AND dc = 0) THEN {compass_sql('ang', band)} END AS dir FROM (SELECT *, {bearing_sql(f'({s} * dr)', f'({s} * dc)')} AS ang FROM {src})), "
            f"g AS (SELECT d.u, o.letter, {gap_sql('d.dir', 'o.way')} AS gap FROM d JOIN o1 o ON o.id = d.id WHERE d.dir IS NOT NULL), "
            "b AS (SELECT u, ARG_MIN(letter, gap * 1000 + ASCII(letter)) AS letter, MIN(gap) = 0 AS exact FROM g GROUP BY u) "
            "SELECT d.*, b.letter, COALESCE(b.exact, FALSE) AS exact FROM d LEFT JOIN b USING (u))")


_U = "iu AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER () AS u FROM i1)"
_UC = "im AS (SELECT * FROM iu WHERE rule = 'mask_centroid')"
_GB = "gb AS MATERIALIZED (SELECT i.*, band, ROW_NUMBER() OVER () AS u FROM i1 i, (SELECT UNNEST([" + ", ".join(f"{b}.0::DOUBLE" for b in GRID_BANDS) + "]) AS band))"
_MB = "mb AS (SELECT i.*, band, ROW_NUMBER() OVER () AS u FROM i1 i, (SELECT UNNEST([" + ", ".join(f"{b}.0::DOUBLE" for b in MATCH_BANDS) + "]) AS band) WHERE rule = 'mask_centroid')"
_RES = ("SELECT {g}, n, errors_before, errors, 1 - errors::DOUBLE / n AS accuracy, CASE WHEN SUM(errors) OVER () = 0 THEN 0 ELSE errors::DOUBLE / SUM(errors) OVER () END AS share_of_errors, "
        "(errors_before - errors)::DOUBLE / n AS delta FROM (SELECT a.{g}, COUNT(*) AS n, COUNT(*) FILTER (b.letter IS DISTINCT FROM b.truth) AS errors_before, COUNT(*) FILTER (a.letter IS DISTINCT FROM a.truth) AS errors "
        "FROM pa a JOIN pb b USING (u) GROUP BY a.{g})")
_RESC = chain(*_BASE, _U, _UC, _pred("pb", "im", "FALSE", "45.0::DOUBLE"), _pred("pa", "im", "flip", "16.0::DOUBLE"))
_RADIUS = "UNION ALL ".join(f"SELECT *, {k} AS k FROM {offsets(k)} " for k in T.RADII)

ORACLES = {
    "G6_connectivity_mmu_sweep": chain(*region_ctes(4, prefix="a"), *region_ctes(8, prefix="b", base=False), C19, _TRAIN, *TASKSPEC, _CHOSEN,
        f"it AS (SELECT id, patch_id, class_name, {num('text', V.TASK_INTEGER, 1)} AS truth FROM ch WHERE task = 'mcq|count' AND {rx('text', V.TASK_INTEGER)})",
        "ar AS (SELECT 4 AS connectivity, patch_id, cls, area_px FROM areg UNION ALL SELECT 8, patch_id, cls, area_px FROM breg)",
        f"gr AS (SELECT * FROM (VALUES (4), (8)) c(connectivity), (VALUES {', '.join(f'({m})' for m in T.MMU_GRID)}) m(mmu))",
        "ct AS (SELECT g.connectivity, mmu, patch_id, class_name, COUNT(*) AS found FROM ar JOIN gr g ON g.connectivity = ar.connectivity AND area_px >= mmu JOIN c19 USING (cls) GROUP BY ALL)",
        "ht AS (SELECT connectivity, mmu, class_name, COUNT(*) AS m, COUNT(*) FILTER (COALESCE(found, 0) = truth) AS h FROM it CROSS JOIN gr LEFT JOIN ct USING (connectivity, mmu, patch_id, class_name) GROUP BY ALL)",
        f"cell AS (SELECT connectivity, mmu, {_ACC} FROM ht GROUP BY ALL)") +
        "SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY per_group_acc DESC, mmu, connectivity) AS INT) AS rank FROM cell",
    "G7_interval_rule_sweep": chain(*_BASE[:-len(ITEMS)], _CHOSEN,
        f"it0 AS (SELECT *, CASE WHEN CONTAINS(text, '%') THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS s FROM ch WHERE task = 'mcq|area' AND {rx('text', V.TASK_RANGE)})",
        f"it AS (SELECT i.*, CASE WHEN s = 1 THEN {num('text', V.TASK_RANGE, 1)} ELSE 100.0::DOUBLE * {num('text', V.TASK_RANGE, 1)} / 1440000 END AS lo, CASE WHEN s = 1 THEN {num('text', V.TASK_RANGE, 2)} "
        f"ELSE 100.0::DOUBLE * {num('text', V.TASK_RANGE, 2)} / 1440000 END AS hi, COALESCE(f.coverage_pct, 0) AS v FROM it0 i LEFT JOIN nf f USING (patch_id, class_name))",
        "ht AS (SELECT rule, class_name, COUNT(*) AS m, COUNT(*) FILTER (hit) AS h FROM (SELECT class_name, 'inclusive_lower_exclusive_upper' AS rule, (v >= lo AND v < hi) OR (hi >= 100 AND v >= lo) AS hit FROM it "
        "UNION ALL SELECT class_name, 'inclusive_both', v BETWEEN lo AND hi FROM it UNION ALL SELECT class_name, 'exclusive_lower_inclusive_upper', (v > lo AND v <= hi) OR (lo <= 0 AND v = 0) FROM it) GROUP BY ALL)") +
        f"SELECT rule, {_ACC} FROM ht GROUP BY rule",
    "G8_dilation_sweep": chain(*region_ctes()[:4], C19, _TRAIN, *TASKSPEC,
        f"tc AS MATERIALIZED (SELECT DISTINCT a.patch_id, o.k, x.class_name AS name_a, y.class_name AS name_b FROM pix19 a JOIN ({_RADIUS}) o ON TRUE JOIN pix19 b ON b.patch_id = a.patch_id AND b.row = a.row + o.dy AND b.col = a.col + o.dx "
        "JOIN c19 x ON x.cls = a.cls JOIN c19 y ON y.cls = b.cls WHERE a.cls <> b.cls)",
        f"ht AS (SELECT v.k, t.classes[1] || '|' || t.classes[2] AS pair, COUNT(*) AS m, COUNT(*) FILTER ((c.k IS NOT NULL) = (t.output = 'yes')) AS h FROM tspec t JOIN (VALUES {', '.join(f'({k})' for k in T.RADII)}) v(k) ON TRUE "
        "LEFT JOIN tc c ON c.patch_id = t.patch_id AND c.k = v.k AND c.name_a = t.classes[1] AND c.name_b = t.classes[2] WHERE t.reason IS NULL AND task = 'binary|adjacency' AND LEN(classes) = 2 GROUP BY ALL)") +
        f"SELECT k, {_ACC} FROM ht GROUP BY k",
    "G9_orientation_fit": chain(*_BASE, _U, _UC, _pred("pw", "im", "FALSE", "45.0::DOUBLE"), _pred("pf", "im", "TRUE", "45.0::DOUBLE"),
        "pp AS (SELECT w.family, w.pair, COUNT(*) AS m, COUNT(*) FILTER (w.letter = w.truth) AS w, COUNT(*) FILTER (f.letter = f.truth) AS f, COUNT(*) FILTER (w.flip) AS s FROM pw w JOIN pf f USING (u) GROUP BY ALL)",
        "ff AS (SELECT family, CAST(SUM(m) AS BIGINT) AS n, ROUND(AVG(w::DOUBLE / m), 9) AS as_written, ROUND(AVG(f::DOUBLE / m), 9) AS flipped, CAST(SUM(s) AS BIGINT) AS s FROM pp GROUP BY family)") +
        "SELECT family, n, as_written, flipped, flipped > as_written AS flip, CASE WHEN flipped > as_written THEN s ELSE n - s END AS agree FROM ff",
    "G10_direction_grid": chain(*_BASE, _GB, _pred("pg", "gb", "flip", "band"),
        "pp AS (SELECT rule, band, pair, COUNT(*) AS m, COUNT(*) FILTER (letter = truth) AS h, COUNT(*) FILTER (exact) AS e FROM pg GROUP BY ALL)",
        "gg AS (SELECT rule, band, ROUND(AVG(h::DOUBLE / m), 9) AS per_pair_acc, SUM(h)::DOUBLE / SUM(m) AS pooled_acc, SUM(e)::DOUBLE / SUM(m) AS exact_rate, CAST(SUM(m) AS BIGINT) AS n FROM pp GROUP BY ALL)") +
        "SELECT *, per_pair_acc = MAX(per_pair_acc) OVER (PARTITION BY rule) AS peak, per_pair_acc >= MAX(per_pair_acc) OVER (PARTITION BY rule) - 0.005::DOUBLE AS plateau FROM gg",
    "G11_diagonal_match": chain(*_BASE, _MB, _pred("pm", "mb", "flip", "band"),
        "gg AS (SELECT band, COUNT(*) FILTER (dir IN ('NE', 'SE', 'SW', 'NW'))::DOUBLE / COUNT(*) AS predicted_rate, COUNT(*) FILTER (truth_way IN ('NE', 'SE', 'SW', 'NW'))::DOUBLE / COUNT(*) AS observed_rate FROM pm GROUP BY band)") +
        "SELECT *, ABS(predicted_rate - observed_rate) AS error, CAST(ROW_NUMBER() OVER (ORDER BY ABS(predicted_rate - observed_rate), band) AS INT) AS rank FROM gg",
    "G13_rule_decidability": chain(*_BASE, _U, _pred("pd", "iu", "flip", "16.0::DOUBLE")) +
        "SELECT a.rule AS rule_a, b.rule AS rule_b, COUNT(*) AS n, COUNT(*) FILTER (ROUND(a.dr, 6) <> ROUND(b.dr, 6) OR ROUND(a.dc, 6) <> ROUND(b.dc, 6)) AS point_differs, "
        "COUNT(*) FILTER (a.letter IS DISTINCT FROM b.letter) AS answer_differs FROM pd a JOIN pd b ON a.id = b.id AND a.rule < b.rule GROUP BY ALL",
    "G14_residual_by_family": _RESC + _RES.format(g="family"),
    "G14_residual_by_fold": _RESC + _RES.format(g="fold"),
}
