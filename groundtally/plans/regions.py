"""Queries D1-D19: regions, measurements, adjacency, position and captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundtally.functions import dims, geometry
from groundtally.functions import fixed_values as V
from groundtally.operators import position, regions, taxonomy
from groundtally.plans.regionsql import (adjacency_cte, bearing_sql, compass_sql, fact_cte, islands, labelling, links,
                                         offsets, region_ctes)
from groundtally.plans.sqlviews import ANNOTATIONS, C19, PIX19, PIXELS, SHAPES, TAX, chain
from groundtally.session import cut_lineage
from groundtally.sources import fixture as fx

MMU = 3


def mask19(spark, sf):
    return taxonomy.classified(fx.pixels(spark, sf), "c19")


def facts(spark, sf, params=None):
    return regions.measure_classes(fx.pixels(spark, sf), "c19", params)


def d1(spark, sf):
    opened = regions.open_runs(regions.class_runs(mask19(spark, sf)), 1)
    n = F.col("c1") - F.col("c0") + 1
    return opened.groupBy("patch_id", "cls").agg(F.sum(n).alias("n_px"), F.sum(F.col("row") * n).alias("sum_row"),
                                                 F.sum(((F.col("c0") + F.col("c1")) * n / 2).cast("long")).alias("sum_col"))


def d2(spark, sf):
    filled = regions.fill_holes(regions.class_runs(mask19(spark, sf)))
    return filled.select("patch_id", "cls", "row", "c0", "c1")


def _component_counts(own, connectivity):
    lab = regions.components(own.runs, connectivity, max_side=own.side)
    return lab.select("patch_id", "cls", "label", F.lit(connectivity).alias("connectivity"), "row", "c0", "c1")


def d3(spark, sf):
    own = regions.level_runs(fx.pixels(spark, sf))
    both = _component_counts(own, 4).unionByName(_component_counts(own, 8))
    return both.groupBy("connectivity", "patch_id", "cls", "label").agg(
        F.sum(F.col("c1") - F.col("c0") + 1).alias("area_px"), F.count("*").alias("n_runs"))


def d4(spark, sf):
    reg = regions.region_properties(regions.label_regions(fx.pixels(spark, sf)))
    kept, dropped = regions.mmu_filter(reg, MMU)
    n = kept.groupBy("patch_id", "cls").agg(F.count("*").alias("kept"), F.sum("area_px").alias("kept_px"))
    return dropped.join(n, ["patch_id", "cls"], "left").select(
        "patch_id", "cls", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("kept_px", F.lit(0)).alias("kept_px"), "dropped_below_mmu")


REGION_COLS = ["patch_id", "cls", "label", "area_px", "r0", "c0", "r1", "c1", "centroid_row", "centroid_col", "bbox_fill"]


def d5(spark, sf):
    own = regions.level_runs(fx.pixels(spark, sf))
    return regions.region_properties(regions.components(own.runs, 4, max_side=own.side)).select(*REGION_COLS)


def d6(spark, sf):
    params = regions.MeasureParams(connectivity=8, mmu_px=2, opening_px=1)
    return regions.extract_regions(fx.pixels(spark, sf), "c19", params).select(*REGION_COLS)


def _asked(spark, sf):
    """Every (patch, class) combination that the open annotations could ask about."""
    ids = F.array(*[F.lit(i) for i in range(len(dims.C19_NAMES))])
    return fx.open_annotations(spark, sf).select("patch_id").distinct().select("patch_id", F.explode(ids).alias("cls"))


def d7(spark, sf):
    f = facts(spark, sf).select("patch_id", "cls", "n_regions")
    return _asked(spark, sf).join(f, ["patch_id", "cls"], "left").select(
        "patch_id", "cls", (F.coalesce("n_regions", F.lit(0)) > 0).alias("present"),
        F.coalesce("n_regions", F.lit(0)).alias("n_regions"))


def d8(spark, sf):
    return facts(spark, sf).select("patch_id", "cls", "n_regions")


def d9(spark, sf):
    return facts(spark, sf).select("patch_id", "cls", "area_px", "area_m2", "coverage", "coverage_pct")


def d10(spark, sf):
    return regions.adjacency(fx.pixels(spark, sf)).withColumn("adjacent", F.col("overlap_px") > 0)


def d11(spark, sf):
    return position.reference_points(facts(spark, sf))


BANDS = (0, 16, 45, 90)


def d12(spark, sf):
    band = F.explode(F.array(*[F.lit(float(b)) for b in BANDS])).alias("band")
    li = fx.table(spark, sf, "lineitem").select((F.col("l_quantity") * 7.5 % 360).alias("angle"), band)
    return li.groupBy("angle", "band").agg(F.count("*").alias("n")).withColumn(
        "direction", geometry.compass(F.col("angle"), F.col("band")))


def d13(spark, sf):
    return position.relative_positions(facts(spark, sf)).withColumn("angle", F.round("angle", 6))


def d14(spark, sf):
    own = regions.level_runs(fx.pixels(spark, sf))
    return position.referring_boxes(regions.extract_regions(own), own.shapes)


def d15(spark, sf):
    px = fx.pixels(spark, sf)
    xy = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).cast("int").alias("patch_id"),
        (F.col("o_orderkey") % 41 / 40).alias("x"), (F.col("o_custkey") % 43 / 40).alias("y"))
    own = regions.level_runs(px)
    lab = cut_lineage(regions.label_regions(own))  # read twice below
    return position.referring_points(xy, px, own.shapes, lab, regions.region_properties(lab))


def d16(spark, sf):
    return facts(spark, sf).select("patch_id", "cls", geometry.tier(F.col("coverage")).alias("tier"))


def d17(spark, sf):
    f = facts(spark, sf).select("patch_id", "cls", "coverage_pct")
    lo = (geometry.decile(F.col("coverage_pct")) * 10).cast("double")
    out = f.withColumn("decile", geometry.decile(F.col("coverage_pct"))).withColumn("lo", lo).withColumn("hi", lo + 10)
    for rule in V.INTERVAL_RULES:
        out = out.withColumn(rule, geometry.in_interval(rule, F.col("coverage_pct"), F.col("lo"), F.col("hi")))
    return out


def d18(spark, sf):
    """Class sets per patch, per tile (five patches each here) and per fold."""
    px, p = fx.pixels(spark, sf), F.col("patch_id")
    levels = {"patch": p, "tile": F.floor(p / 5).cast("int"), "fold": p % 5}
    out = [position.class_sets(px, key).withColumn("level", F.lit(level)) for level, key in levels.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def scene_meta(spark, sf):
    return fx.open_annotations(spark, sf).groupBy("patch_id").agg(
        F.min_by(F.struct("season", "country", "climate_zone"), "id").alias("m")).select("patch_id", "m.*")


def d19(spark, sf):
    return position.captions(facts(spark, sf), scene_meta(spark, sf))


QUERIES = {
    "D1_opening": d1, "D2_fill_holes": d2, "D3_components": d3, "D4_mmu_filter": d4, "D5_region_properties": d5,
    "D6_extract_regions": d6, "D7_presence": d7, "D8_count": d8, "D9_area": d9, "D10_adjacency": d10,
    "D11_reference_points": d11, "D12_compass": d12, "D13_relative_position": d13, "D14_referring_box": d14,
    "D15_referring_point": d15, "D16_tier": d16, "D17_interval_rules": d17, "D18_class_sets": d18, "D19_caption": d19,
}

REG = region_ctes()
BASE = [TAX, PIXELS, SHAPES, PIX19]
PROPS = ("patch_id, cls, label, area_px, r0, c0, r1, c1, sum_row::DOUBLE / area_px AS centroid_row, "
         "sum_col2::DOUBLE / (2 * area_px) AS centroid_col, area_px::DOUBLE / ((r1 - r0) * (c1 - c0)) AS bbox_fill")


def _d3_sql():
    parts = [islands("run", "pix19")]
    sel = []
    for k in (4, 8):
        parts += [links(f"e{k}", "run", int(k == 8)), labelling(f"cc{k}", "run", f"e{k}")]
        sel.append(f"SELECT {k} AS connectivity, patch_id, cls, lab % 1000000000000000 AS label, c1 - c0 + 1 AS n FROM run JOIN cc{k} USING (id)")
    return chain(*BASE, *parts) + (
        "SELECT connectivity, patch_id, cls, label, CAST(SUM(n) AS BIGINT) AS area_px, COUNT(*) AS n_runs FROM ("
        + " UNION ALL ".join(sel) + ") GROUP BY ALL")


def _candidates(order):
    return (f"SELECT patch_id, cls, COUNT(*) OVER (PARTITION BY patch_id, cls) AS n_candidates, label, area_px, "
            f"c0::DOUBLE / w AS x0, r0::DOUBLE / h AS y0, c1::DOUBLE / w AS x1, r1::DOUBLE / h AS y1, "
            f"ROW_NUMBER() OVER (PARTITION BY patch_id, cls ORDER BY {order}, label) AS rn FROM reg JOIN shapes USING (patch_id) "
            f"WHERE area_px::DOUBLE / (h * w) BETWEEN 0.01 AND 0.5 AND area_px::DOUBLE / ((r1 - r0) * (c1 - c0)) >= 0.4")


_DEC = "CAST(LEAST(FLOOR(coverage_pct / 10), 10) AS INT)"
META = ("meta AS (SELECT patch_id, ARG_MIN(season, id) AS season, ARG_MIN(country, id) AS country, "
        "ARG_MIN(climate_zone, id) AS climate_zone FROM ann GROUP BY patch_id)")
_PH = ("LOWER(class_name) || ' covering ' || CAST(CAST(ROUND_EVEN(coverage * 100.0::DOUBLE, 0) AS INT) AS VARCHAR) || '% of the image in ' || "
       "n_regions || CASE WHEN n_regions = 1 THEN ' region' ELSE ' regions' END")


def _said(cond, n, expr):
    return (f"(SELECT STRING_AGG(x, ', ' ORDER BY k) FROM (SELECT {expr} AS x, ROW_NUMBER() OVER (ORDER BY coverage DESC, class_name DESC) AS k "
            f"FROM named n WHERE n.patch_id = m.patch_id AND {cond}) WHERE k <= {n})")


CAPTION_SQL = (
    "SELECT m.patch_id, CASE WHEN t.n IS NULL THEN 'The image contains no identifiable land cover.' ELSE "
    "'This satellite image, captured during the ' || LOWER(season) || ' in ' || country || ' within the \"' || LOWER(climate_zone) || "
    "'\" climate zone, shows' || COALESCE(' mainly ' || " + _said("coverage > 0.25", 3, _PH) + " || '.', '') || "
    "COALESCE(' It also contains ' || " + _said("coverage BETWEEN 0.05 AND 0.25", 3, _PH) + " || '.', '') || "
    "COALESCE(' Smaller and more marginal areas of ' || " + _said("coverage < 0.05", 4, "LOWER(class_name)")
    + " || ' are also scattered across the scene.', '') || ' In total ' || t.n || "
    "' distinct land cover classes are visible in the image, forming ' || t.s || ' separate contiguous regions.' END AS caption "
    "FROM meta m LEFT JOIN (SELECT patch_id, COUNT(*) AS n, CAST(SUM(n_regions) AS BIGINT) AS s FROM fact GROUP BY patch_id) t USING (patch_id)")
NAMED = "named AS MATERIALIZED (SELECT * FROM fact JOIN c19 USING (cls))"

ORACLES = {
    "D1_opening": chain(*region_ctes(opening=1, fill=False)) +
        "SELECT patch_id, cls, COUNT(*) AS n_px, CAST(SUM(row) AS BIGINT) AS sum_row, CAST(SUM(col) AS BIGINT) AS sum_col FROM opn GROUP BY patch_id, cls",
    "D2_fill_holes": chain(*REG) + "SELECT patch_id, cls, row, c0, c1 FROM run",
    "D3_components": _d3_sql(),
    "D4_mmu_filter": chain(*REG) +
        f"SELECT patch_id, cls, COUNT(*) FILTER (area_px >= {MMU}) AS kept, CAST(COALESCE(SUM(area_px) FILTER (area_px >= {MMU}), 0) AS BIGINT) AS kept_px, "
        f"COUNT(*) FILTER (area_px < {MMU}) AS dropped_below_mmu FROM reg GROUP BY patch_id, cls",
    "D5_region_properties": chain(*region_ctes(fill=False)) + f"SELECT {PROPS} FROM reg",
    "D6_extract_regions": chain(*region_ctes(connectivity=8, opening=1)) + f"SELECT {PROPS} FROM reg WHERE area_px >= 2",
    "D7_presence": chain(*REG, fact_cte(), C19, ANNOTATIONS) +
        "SELECT a.patch_id, c.cls, COALESCE(f.n_regions, 0) > 0 AS present, COALESCE(f.n_regions, 0) AS n_regions FROM (SELECT DISTINCT patch_id FROM ann) a "
        "CROSS JOIN c19 c LEFT JOIN fact f ON f.patch_id = a.patch_id AND f.cls = c.cls",
    "D8_count": chain(*REG, fact_cte()) + "SELECT patch_id, cls, n_regions FROM fact",
    "D9_area": chain(*REG, fact_cte()) + "SELECT patch_id, cls, area_px, area_m2, coverage, coverage_pct FROM fact",
    "D10_adjacency": chain(*BASE, adjacency_cte()) + "SELECT *, overlap_px > 0 AS adjacent FROM adj",
    "D11_reference_points": chain(*REG, fact_cte()) + " UNION ALL ".join(
        f"SELECT patch_id, cls, '{rule}' AS rule, {r} AS p_row, {c} AS p_col FROM fact" for rule, (r, c) in position.POINT_COLUMNS.items()),
    "D12_compass":
        f"SELECT angle, band, COUNT(*) AS n, {compass_sql('angle', 'band')} AS direction FROM (SELECT l_quantity * 7.5::DOUBLE % 360 AS angle, "
        f"b AS band FROM lineitem, (VALUES {', '.join(f'({b}.0::DOUBLE)' for b in BANDS)}) v(b)) GROUP BY angle, band",
    "D13_relative_position": chain(*REG, fact_cte()) +
        f"SELECT patch_id, class_a, class_b, dr AS delta_row, dc AS delta_col, CASE WHEN ok THEN ROUND(angle, 6) END AS angle, "
        f"CASE WHEN ok THEN {compass_sql('angle', '16.0::DOUBLE')} END AS direction, ok AS valid FROM (SELECT *, {bearing_sql('dr', 'dc')} AS angle, "
        f"NOT (dr = 0 AND dc = 0) AS ok FROM (SELECT a.patch_id, a.cls AS class_a, b.cls AS class_b, a.mask_row - b.mask_row AS dr, "
        f"a.mask_col - b.mask_col AS dc FROM fact a JOIN fact b ON a.patch_id = b.patch_id AND a.cls <> b.cls))",
    "D14_referring_box": chain(*REG) +
        "SELECT * EXCLUDE (rn), 'largest' AS qualifier FROM (" + _candidates("area_px DESC") + ") WHERE rn = 1 UNION ALL BY NAME "
        "SELECT * EXCLUDE (rn), 'smallest' AS qualifier FROM (" + _candidates("area_px") + ") WHERE rn = 1",
    "D15_referring_point": chain(*REG) +
        "SELECT id, patch_id, CASE WHEN NOT (row >= 0 AND row < h AND col >= 0 AND col < w) THEN 'point outside the image' "
        "WHEN code = 999 THEN 'point falls on an unclassified pixel' WHEN cls < 0 THEN 'class ' || code || ' has no 19-class equivalent' "
        "WHEN area_px IS NULL THEN 'point is not inside any surviving component' ELSE '' END AS reason, cls, label, area_px, "
        "c0::DOUBLE / w AS x0, r0::DOUBLE / h AS y0, c1::DOUBLE / w AS x1, r1::DOUBLE / h AS y1 FROM ("
        "SELECT q.*, t.c19_id AS cls, l.label, g.area_px, g.r0, g.c0, g.r1, g.c1 FROM (SELECT o.*, p.code FROM ("
        "SELECT o_orderkey AS id, CAST(o_custkey % 25 AS INT) AS patch_id, h, w, "
        "CAST(ROUND_EVEN((o_orderkey % 41) / 40.0::DOUBLE * (w - 1), 0) AS INT) AS col, CAST(ROUND_EVEN((o_custkey % 43) / 40.0::DOUBLE * (h - 1), 0) AS INT) AS row "
        "FROM orders JOIN shapes s ON s.patch_id = o_custkey % 25) o LEFT JOIN pixels p ON p.patch_id = o.patch_id AND p.row = o.row AND p.col = o.col) q "
        "LEFT JOIN tax t ON t.code = q.code LEFT JOIN lrun l ON l.patch_id = q.patch_id AND l.cls = t.c19_id AND l.row = q.row AND q.col BETWEEN l.c0 AND l.c1 "
        "LEFT JOIN reg g ON g.patch_id = l.patch_id AND g.cls = l.cls AND g.label = l.label)",
    "D16_tier": chain(*REG, fact_cte()) +
        "SELECT patch_id, cls, CASE WHEN coverage > 0.25 THEN 'primary' WHEN coverage >= 0.05 THEN 'secondary' ELSE 'marginal' END AS tier FROM fact",
    "D17_interval_rules": chain(*REG, fact_cte()) +
        "SELECT *, (coverage_pct >= lo AND coverage_pct < hi) OR (hi >= 100 AND coverage_pct >= lo) AS inclusive_lower_exclusive_upper, "
        "coverage_pct >= lo AND coverage_pct <= hi AS inclusive_both, (coverage_pct > lo AND coverage_pct <= hi) OR (lo <= 0 AND coverage_pct = 0) "
        f"AS exclusive_lower_inclusive_upper FROM (SELECT patch_id, cls, coverage_pct, {_DEC} AS decile, {_DEC} * 10.0::DOUBLE AS lo, {_DEC} * 10.0::DOUBLE + 10 AS hi FROM fact)",
    "D18_class_sets": chain(TAX, PIXELS) +
        " UNION ALL ".join(f"SELECT {key} AS grp, COUNT(DISTINCT code) AS n_codes, STRING_AGG(DISTINCT code::VARCHAR, ',' ORDER BY code::VARCHAR) AS codes, '{level}' AS level FROM pixels GROUP BY 1"
                          for level, key in (("patch", "patch_id"), ("tile", "CAST(patch_id // 5 AS INT)"), ("fold", "patch_id % 5"))),
    "D19_caption": chain(*REG, fact_cte(), C19, NAMED, ANNOTATIONS, META) + CAPTION_SQL,
}
