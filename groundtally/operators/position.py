"""Relative position, referring boxes and points, tiers, class sets and captions from region facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtally.functions import dims, geometry
from groundtally.functions import fixed_values as V
from groundtally.operators import taxonomy
from groundtally.operators.regions import MeasureParams

POINT_COLUMNS = {
    "mask_centroid": ("mask_row", "mask_col"),
    "largest_component": ("big_row", "big_col"),
    "bbox_centre": ("box_row", "box_col"),
}


def reference_points(facts: DataFrame) -> DataFrame:
    """One row per (patch, class, rule) with the point that stands for the class."""
    rows = [F.struct(F.lit(rule).alias("rule"), F.col(r).alias("p_row"), F.col(c).alias("p_col"))
            for rule, (r, c) in POINT_COLUMNS.items()]
    return facts.select("patch_id", "cls", F.explode(F.array(*rows)).alias("p")).select("patch_id", "cls", "p.*")


def relative_positions(facts: DataFrame, params: MeasureParams | None = None) -> DataFrame:
    """Direction of every class A from every class B of the same patch (at most 19 x 18 pairs)."""
    p = (params or MeasureParams()).require("diagonal_band_deg", "reference_rule")
    r, c = POINT_COLUMNS[p.reference_rule]
    a = facts.select("patch_id", F.col("cls").alias("class_a"), F.col(r).alias("a_row"), F.col(c).alias("a_col"))
    b = facts.select("patch_id", F.col("cls").alias("class_b"), F.col(r).alias("b_row"), F.col(c).alias("b_col"))
    d_row, d_col = F.col("a_row") - F.col("b_row"), F.col("a_col") - F.col("b_col")
    out = a.join(b, "patch_id").filter("class_a <> class_b").withColumn("angle", geometry.bearing(d_row, d_col))
    return out.select("patch_id", "class_a", "class_b", d_row.alias("delta_row"), d_col.alias("delta_col"), "angle",
                      geometry.compass(F.col("angle"), p.diagonal_band_deg).alias("direction"),
                      F.col("angle").isNotNull().alias("valid"))


def referring_boxes(regions: DataFrame, shapes: DataFrame) -> DataFrame:
    """Per (patch, class, qualifier) the chosen instance after the area and box-fill filters."""
    cand = regions.join(shapes, "patch_id").filter(
        F.col("area_px") / (F.col("h") * F.col("w")) >= V.REFER_AREA_MIN).filter(
        F.col("area_px") / (F.col("h") * F.col("w")) <= V.REFER_AREA_MAX).filter(F.col("bbox_fill") >= V.REFER_FILL_MIN)
    box = F.struct("label", "area_px", (F.col("c0") / F.col("w")).alias("x0"), (F.col("r0") / F.col("h")).alias("y0"),
                   (F.col("c1") / F.col("w")).alias("x1"), (F.col("r1") / F.col("h")).alias("y1"))
    best = cand.groupBy("patch_id", "cls").agg(
        F.count("*").alias("n_candidates"),
        F.max_by(box, F.struct(F.col("area_px"), -F.col("label"))).alias("largest"),
        F.min_by(box, F.struct(F.col("area_px"), F.col("label"))).alias("smallest"))
    rows = F.array(F.struct(F.lit("largest").alias("qualifier"), F.col("largest").alias("b")),
                   F.struct(F.lit("smallest").alias("qualifier"), F.col("smallest").alias("b")))
    return best.select("patch_id", "cls", "n_candidates", F.explode(rows).alias("q")).select(
        "patch_id", "cls", "n_candidates", "q.qualifier", "q.b.*")


def referring_points(asked: DataFrame, px: DataFrame, shapes: DataFrame, labelled: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, patch_id, x, y) -> the region under the point at c19, or the reason there is none."""
    at = asked.join(shapes, "patch_id").select(
        "id", "patch_id", "x", "y", "h", "w",
        F.rint(F.col("x") * (F.col("w") - 1)).cast("int").alias("col"),
        F.rint(F.col("y") * (F.col("h") - 1)).cast("int").alias("row"))
    code = at.join(px, ["patch_id", "row", "col"], "left")
    cls = taxonomy._with_class(code).withColumn("cls", F.col("c19_id"))
    hit = labelled.select("patch_id", "cls", "row", F.col("c0").alias("_a"), F.col("c1").alias("_b"), "label")
    found = (
        cls.join(hit, ["patch_id", "cls", "row"], "left")
        .groupBy("id", "patch_id", "row", "col", "code", "cls", "h", "w")
        .agg(F.max(F.when((F.col("_a") <= F.col("col")) & (F.col("col") <= F.col("_b")), F.col("label"))).alias("label"))
    )
    box = regions.select("patch_id", "cls", "label", "area_px", "r0", "c0", "r1", "c1")
    outside = ~((F.col("row") >= 0) & (F.col("row") < F.col("h")) & (F.col("col") >= 0) & (F.col("col") < F.col("w")))
    return found.join(box, ["patch_id", "cls", "label"], "left").select(
        "id", "patch_id",
        F.when(outside, F.lit("point outside the image"))
        .when(F.col("code") == V.UNCLASSIFIED_CODE, F.lit("point falls on an unclassified pixel"))
        .when(F.col("cls") < 0, F.concat(F.lit("class "), F.col("code").cast("string"), F.lit(" has no 19-class equivalent")))
        .when(F.col("area_px").isNull(), F.lit("point is not inside any surviving component")).otherwise(F.lit("")).alias("reason"),
        "cls", "label", "area_px", (F.col("c0") / F.col("w")).alias("x0"), (F.col("r0") / F.col("h")).alias("y0"),
        (F.col("c1") / F.col("w")).alias("x1"), (F.col("r1") / F.col("h")).alias("y1"))


def class_sets(px: DataFrame, group: Column) -> DataFrame:
    """Distinct codes per group, exhaustively; at most 45 codes per group."""
    return px.select(group.alias("grp"), "code").distinct().groupBy("grp").agg(
        F.count("*").alias("n_codes"),
        F.array_join(F.transform(F.array_sort(F.collect_list("code")), lambda c: c.cast("string")), ",").alias("codes"))


def captions(facts: DataFrame, meta: DataFrame) -> DataFrame:
    """Templated description from tiers, counts and scene metadata (patch_id, season, country, climate_zone)."""
    named = facts.join(F.broadcast(dims.c19_dim(facts.sparkSession)), "cls")
    listed = named.groupBy("patch_id").agg(
        F.sort_array(F.collect_list(F.struct("coverage", "class_name", "n_regions")), asc=False).alias("s"),
        F.count("*").alias("n_classes"), F.sum("n_regions").alias("n_all"))

    def phrase(x):
        return F.concat(F.lower(x["class_name"]), F.lit(" covering "),
                        F.bround(x["coverage"] * 100.0).cast("int").cast("string"), F.lit("% of the image in "),
                        x["n_regions"].cast("string"), F.when(x["n_regions"] == 1, F.lit(" region")).otherwise(F.lit(" regions")))

    prim = F.filter("s", lambda x: x["coverage"] > V.TIER_PRIMARY)
    sec = F.filter("s", lambda x: (x["coverage"] >= V.TIER_SECONDARY) & (x["coverage"] <= V.TIER_PRIMARY))
    marg = F.filter("s", lambda x: x["coverage"] < V.TIER_SECONDARY)

    def said(items, n):
        return F.array_join(F.transform(F.slice(items, 1, n), phrase), ", ")

    lead = F.concat(F.lit("This satellite image, captured during the "), F.lower("season"), F.lit(" in "), F.col("country"),
                    F.lit(' within the "'), F.lower("climate_zone"), F.lit('" climate zone, shows'))
    text = F.concat(
        lead,
        F.when(F.size(prim) > 0, F.concat(F.lit(" mainly "), said(prim, 3), F.lit("."))).otherwise(F.lit("")),
        F.when(F.size(sec) > 0, F.concat(F.lit(" It also contains "), said(sec, 3), F.lit("."))).otherwise(F.lit("")),
        F.when(F.size(marg) > 0, F.concat(
            F.lit(" Smaller and more marginal areas of "),
            F.array_join(F.transform(F.slice(marg, 1, 4), lambda x: F.lower(x["class_name"])), ", "),
            F.lit(" are also scattered across the scene."))).otherwise(F.lit("")),
        F.lit(" In total "), F.col("n_classes").cast("string"), F.lit(" distinct land cover classes are visible in the image, forming "),
        F.col("n_all").cast("string"), F.lit(" separate contiguous regions."))
    none = F.lit("The image contains no identifiable land cover.")
    return meta.join(listed, "patch_id", "left").select(
        "patch_id", F.when(F.col("n_classes").isNull(), none).otherwise(text).alias("caption"))
