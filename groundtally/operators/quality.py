"""Data-quality rules over patch ids, tasks and raster catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtally.functions import dims
from groundtally.functions import fixed_values as V


def parse_patch_ids(df: DataFrame, strict: bool = False) -> DataFrame:
    """Adds tile, row, col from the tail of the id; null where it does not match, an error if strict."""
    part = [F.regexp_extract("patch_id", V.PATCH_ID_TAIL, i) for i in (1, 2, 3)]
    ok = part[0] != ""
    refuse = F.raise_error(F.concat(F.lit("patch id without a position: "), F.col("patch_id"))).cast("string")
    tile = F.when(ok, part[0]).otherwise(refuse) if strict else F.when(ok, part[0])
    return df.withColumn("tile", tile).withColumn("row", F.when(ok, part[1].try_cast("int"))).withColumn(
        "col", F.when(ok, part[2].try_cast("int")))


def attach_coordinates(ids: DataFrame, annotations: DataFrame) -> DataFrame:
    """Coordinate of the smallest annotation id per patch, kept null for patches never annotated."""
    first = annotations.groupBy("patch_id").agg(F.min_by(F.struct("latitude", "longitude"), "id").alias("p"))
    return ids.join(first, "patch_id", "left").select(*ids.columns, F.col("p.latitude").alias("lat"), F.col("p.longitude").alias("lon"))


def task_intents(df: DataFrame) -> DataFrame:
    """Adds task and its intent from the closed task list; intent is null for an unknown pair."""
    task = F.concat_ws("|", "type", "category")
    return df.withColumn("task", task).withColumn("intent", F.element_at(dims.literal_map(V.TASK_INTENTS), task))


def catalogue_checks(scenes: DataFrame, expect: tuple[int, int] | None = None) -> DataFrame:
    """First failing rule per scene (crs, rectilinear, gsd_x, gsd_y, band_count, height, width)."""
    n = F.col("band_count")
    modality = F.when(n == 2, "SAR").when(n.isin(10, 12, 13), "OPTICAL")
    check = (
        F.when(F.col("crs").isNull(), "crs_present").when(~F.col("rectilinear"), "geotransform_present")
        .when((F.abs("gsd_x") <= 0) | (F.abs("gsd_y") <= 0), "gsd_positive").when(modality.isNull(), "modality_inference"))
    if expect:
        check = check.when((F.col("height") != expect[0]) | (F.col("width") != expect[1]), "expected_shape")
    return scenes.withColumn("modality", modality).withColumn("check", check.otherwise("ok"))


def pair_checks(scenes: DataFrame) -> DataFrame:
    """Per request (1-2 scenes): input count, then shape, CRS and transform drift between the two.

    (request, scene, height, width, crs, transform array). A request holds at most a few scenes; the
    pair is taken by smallest and largest scene id, so no request is ever collected.
    """
    s = F.struct("scene", "height", "width", "crs", "transform")
    g = scenes.groupBy("request").agg(F.count("*").alias("n_inputs"), F.min_by(s, "scene").alias("a"), F.max_by(s, "scene").alias("b"))
    drift = F.array_max(F.zip_with("a.transform", "b.transform", lambda x, y: F.abs(x - y)))
    check = (
        F.when(~F.col("n_inputs").between(1, 2), "input_count")
        .when(F.col("n_inputs") == 1, "ok")
        .when((F.col("a.height") != F.col("b.height")) | (F.col("a.width") != F.col("b.width")), "pair_shape")
        .when(~F.col("a.crs").eqNullSafe(F.col("b.crs")), "pair_crs")
        .when(drift > V.CO_REGISTRATION_TOL, "pair_co_registration").otherwise("ok"))
    return g.select("request", "n_inputs", check.alias("check"))


def nodata_flags(values: DataFrame) -> DataFrame:
    """(scene, value, nodata): all-nodata (flagged, never rejected) and NaN-nodata per scene."""
    return values.groupBy("scene").agg(
        F.bool_and(F.col("value").eqNullSafe(F.col("nodata"))).alias("all_nodata"),
        F.bool_or(F.isnan("nodata")).alias("nan_nodata"), F.count("*").alias("n_values"))
