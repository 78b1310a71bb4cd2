"""Queries J1-J9: sensor bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundtally.functions import dims
from groundtally.functions import fixed_values as V
from groundtally.operators import bands as B
from groundtally.operators.regions import raster_shapes
from groundtally.plans.sqlviews import PIXELS, SHAPES, TAX, chain, q, values
from groundtally.sources import fixture as fx

SEVEN = ("VV", "VH", "B03", "B04", "B08", "B11", "B02")  # line numbers 1-7 as channels


def line_bands(spark, sf):
    """Scene = supplier, pixel = order, band = line number; SAR takes the tax as power, optical the price."""
    li = fx.table(spark, sf, "lineitem")
    band = F.get(dims.literal_array(SEVEN), F.col("l_linenumber") - 1)
    return li.select(F.col("l_suppkey").alias("scene"), band.alias("band"), F.col("l_orderkey").alias("row"), F.lit(0).alias("col"),
                     F.when(F.col("l_linenumber") <= 2, F.col("l_tax")).otherwise(F.col("l_extendedprice")).alias("value"),
                     "l_returnflag", "l_quantity", "l_partkey")


def j1(spark, sf):
    return B.db_conversion(line_bands(spark, sf).filter(F.col("band").isin(*V.S1_BANDS)), "band").withColumn("mean_db", F.round("mean_db", 6))


def low_band(spark, sf):
    """A 20 m band: mean class code of 2x2 pixels."""
    px = fx.pixels(spark, sf)
    return px.groupBy(F.col("patch_id").alias("scene"), F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(
        F.avg("code").alias("value")).withColumn("band", F.lit("B05")).select("scene", "band", "row", "col", "value")


def sizes(spark, sf):
    s = raster_shapes(fx.pixels(spark, sf)).withColumnRenamed("patch_id", "scene")
    src = s.select("scene", F.ceil(F.col("h") / 2).cast("int").alias("h"), F.ceil(F.col("w") / 2).cast("int").alias("w"))
    return src, s.select("scene", F.col("h").alias("out_h"), F.col("w").alias("out_w"))


def j2(spark, sf):
    return B.resample(low_band(spark, sf), *sizes(spark, sf)).withColumn("value", F.round("value", 6))


def stats(spark, sf):
    return B.norm_stats(line_bands(spark, sf).filter(F.col("l_returnflag") != "R"))


def j3(spark, sf):
    d = line_bands(spark, sf)
    d = d.withColumn("value", F.when(F.col("band").isin(*V.S1_BANDS), B.linear_to_db(F.col("value"))).otherwise(F.col("value")))
    z = B.zscore(d, stats(spark, sf))
    return z.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean_z"), F.round(F.min("z"), 6).alias("min_z"), F.round(F.max("z"), 6).alias("max_z"))


def j5(spark, sf):
    p = B.band_presence(line_bands(spark, sf), ("B04",))
    return p.select("scene", F.array_join(F.transform("presence", lambda x: x.cast("int").cast("string")), "").alias("presence"), F.array_join("not_measured", ",").alias("not_measured"))


def j6(spark, sf):
    return B.spectral_indices(line_bands(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"), F.count("reason").alias("refused"), F.round(F.sum("value"), 6).alias("total"))


def j7(spark, sf):
    s = B.stack_channels(pixel_bands(spark, sf))
    return s.select("scene", "row", "col", F.array_join(F.transform("channels", lambda x: x.cast("int").cast("string")), ",").alias("channels"))


def pixel_bands(spark, sf):
    """Three bands that cover every scene's grid."""
    px = fx.pixels(spark, sf)
    fine = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), v.cast("double").alias("value")) for b, v in (("B02", F.col("code")), ("B08", F.col("row")), ("VV", F.col("col")))])).alias("b")
    return px.select(F.col("patch_id").alias("scene"), "row", "col", fine).select("scene", "b.band", "row", "col", "b.value")


def j8(spark, sf):
    bands = pixel_bands(spark, sf).unionByName(low_band(spark, sf))
    tensor, presence = B.preprocess(bands, *sizes(spark, sf), ("B08",))
    t = tensor.groupBy("scene").agg(F.count("*").alias("n_px"), *[F.round(F.sum(F.get("channels", F.lit(i))), 4).alias(f"sum_{b}") for i, b in enumerate(B.CHANNELS) if b in ("VV", "B02", "B05", "B08")])
    return t.join(presence.select("scene", F.array_join(F.transform("presence", lambda x: x.cast("int").cast("string")), "").alias("presence"), F.array_join("not_measured", ",").alias("not_measured")), "scene")


def j9(spark, sf):
    n = line_bands(spark, sf).groupBy("band").agg(F.count("*").alias("n"))
    return B.band_dim(spark).join(n, "band", "left").select("band", "channel", "native_m", "sensor", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {
    "J1_linear_to_db": j1, "J2_resample": j2, "J3_zscore": j3, "J4_norm_stats": stats, "J5_band_presence": j5, "J6_spectral_index": j6,
    "J7_stack_channels": j7, "J8_preprocess": j8, "J9_band_lookup": j9,
}

LB = (f"lb AS MATERIALIZED (SELECT l_suppkey AS scene, ([{', '.join(q(b) for b in SEVEN)}])[l_linenumber] AS band, l_orderkey AS row, 0 AS col, CASE WHEN l_linenumber <= 2 THEN l_tax ELSE l_extendedprice END AS value, "
      "l_returnflag, l_quantity, l_partkey FROM lineitem)")
DIM = "bd AS " + values([(b, i, 20 if b in V.S2_NATIVE_20M else 10, "SAR" if b in V.S1_BANDS else "OPTICAL") for i, b in enumerate(B.CHANNELS)], "band, channel, native_m, sensor")
_DB = "10.0::DOUBLE * LOG10(CASE WHEN {v} <= 0 THEN 1e-5::DOUBLE ELSE {v} END)"
_V = f"CASE WHEN band IN ('VV', 'VH') THEN {_DB.format(v='value')} ELSE value END"
STATS = (f"st AS MATERIALIZED (SELECT b.band, b.channel, COALESCE(n, 0) AS n, ROUND(m, 6) AS mean, ROUND(SQRT(GREATEST(ss / n - m * m, 0)), 6) AS std, n IS NULL AS missing FROM bd b LEFT JOIN "
         f"(SELECT band, COUNT(*) AS n, SUM(v) / COUNT(*) AS m, SUM(v * v) AS ss FROM (SELECT band, {_V} AS v FROM lb WHERE l_returnflag <> 'R') GROUP BY band) s USING (band))")
LOW = "low AS MATERIALIZED (SELECT patch_id AS scene, row // 2 AS row, col // 2 AS col, AVG(code) AS value FROM pixels GROUP BY ALL)"
RES = ("res AS MATERIALIZED (SELECT scene, row, col, (a.value * (1 - dx) + b.value * dx) * (1 - dy) + (c.value * (1 - dx) + d.value * dx) * dy AS value FROM ("
       "SELECT scene, row, col, y - FLOOR(y) AS dy, x - FLOOR(x) AS dx, CAST(FLOOR(y) AS INT) AS y0, CAST(FLOOR(x) AS INT) AS x0, CAST(LEAST(FLOOR(y) + 1, sh - 1) AS INT) AS y1, CAST(LEAST(FLOOR(x) + 1, sw - 1) AS INT) AS x1 FROM ("
       "SELECT p.patch_id AS scene, p.row, p.col, CEIL(s.h / 2) AS sh, CEIL(s.w / 2) AS sw, LEAST(GREATEST((p.row + 0.5::DOUBLE) * CEIL(s.h / 2) / s.h - 0.5::DOUBLE, 0), CEIL(s.h / 2) - 1) AS y, "
       "LEAST(GREATEST((p.col + 0.5::DOUBLE) * CEIL(s.w / 2) / s.w - 0.5::DOUBLE, 0), CEIL(s.w / 2) - 1) AS x FROM pixels p JOIN shapes s USING (patch_id))) t "
       "JOIN low a USING (scene) JOIN low b USING (scene) JOIN low c USING (scene) JOIN low d USING (scene) WHERE a.row = y0 AND a.col = x0 AND b.row = y0 AND b.col = x1 AND c.row = y1 AND c.col = x0 AND d.row = y1 AND d.col = x1)").replace(
       "SELECT scene, row, col, (a.value", "SELECT t.scene, t.row, t.col, (a.value").replace(
       "JOIN low a USING (scene) JOIN low b USING (scene) JOIN low c USING (scene) JOIN low d USING (scene) WHERE a.row = y0 AND a.col = x0 AND b.row = y0 AND b.col = x1 AND c.row = y1 AND c.col = x0 AND d.row = y1 AND d.col = x1",
       "JOIN low a ON a.scene = t.scene AND a.row = y0 AND a.col = x0 JOIN low b ON b.scene = t.scene AND b.row = y0 AND b.col = x1 JOIN low c ON c.scene = t.scene AND c.row = y1 AND c.col = x0 JOIN low d ON d.scene = t.scene AND d.row = y1 AND d.col = x1")


def _presence(src, dropped, key="scene"):
    bit = " || ".join(f"CASE WHEN '{b}' <> '{dropped}' AND BOOL_OR(band = '{b}') THEN '1' ELSE '0' END" for b in V.S2_BANDS)
    names = ", ".join(f"CASE WHEN '{b}' = '{dropped}' OR NOT BOOL_OR(band = '{b}') THEN '{b}' END" for b in V.S2_BANDS)
    return f"SELECT {key}, {bit} AS presence, ARRAY_TO_STRING(LIST_FILTER([{names}], lambda x: x IS NOT NULL), ',') AS not_measured FROM {src} GROUP BY {key}"


def _index(kind):
    a, b = V.SPECTRAL_INDICES[kind]
    return (f"SELECT COUNT(*) AS n, COUNT(*) FILTER (a IS NULL OR b IS NULL) AS refused, ROUND(SUM(CASE WHEN a + b = 0 THEN 0 ELSE (a - b) / (a + b) END), 6) AS total, '{kind}' AS kind FROM "
            f"(SELECT scene, row, MAX(value) FILTER (band = '{a}') AS a, MAX(value) FILTER (band = '{b}') AS b FROM lb WHERE band IN ('{a}', '{b}') GROUP BY ALL)")


_STACK = " || ',' || ".join({"B02": "code", "B08": "row", "VV": "col"}.get(b, "0") + "::VARCHAR" for b in B.CHANNELS)
ORACLES = {
    "J1_linear_to_db": chain(LB) + f"SELECT band, COUNT(*) AS n, COUNT(*) FILTER (value <= 0) AS floored, ROUND(AVG({_DB.format(v='value')}), 6) AS mean_db FROM lb WHERE band IN ('VV', 'VH') GROUP BY band",
    "J2_resample": chain(TAX, PIXELS, SHAPES, LOW, RES) + "SELECT scene, 'B05' AS band, row, col, ROUND(value, 6) AS value FROM res",
    "J3_zscore": chain(LB, DIM, STATS) + f"SELECT band, COUNT(*) AS n, ROUND(AVG(z), 6) AS mean_z, ROUND(MIN(z), 6) AS min_z, ROUND(MAX(z), 6) AS max_z FROM (SELECT band, ({_V} - mean) / std AS z FROM lb JOIN st USING (band) WHERE NOT missing) GROUP BY band",
    "J4_norm_stats": chain(LB, DIM, STATS) + "SELECT * FROM st",
    "J5_band_presence": chain(LB) + _presence("lb", "B04"),
    "J6_spectral_index": chain(LB) + " UNION ALL ".join(_index(k) for k in V.SPECTRAL_INDICES),
    "J7_stack_channels": chain(TAX, PIXELS) + f"SELECT patch_id AS scene, row, col, {_STACK} AS channels FROM pixels",
    "J8_preprocess": chain(TAX, PIXELS, SHAPES, LOW, RES) +
        "SELECT p.patch_id AS scene, COUNT(*) AS n_px, ROUND(SUM(p.col)::DOUBLE, 4) AS \"sum_VV\", ROUND(SUM(p.code)::DOUBLE, 4) AS \"sum_B02\", ROUND(SUM(r.value), 4) AS \"sum_B05\", 0.0::DOUBLE AS \"sum_B08\", "
        "'1001000000' AS presence, 'B03,B04,B06,B07,B08,B8A,B11,B12' AS not_measured FROM pixels p JOIN res r ON r.scene = p.patch_id AND r.row = p.row AND r.col = p.col GROUP BY p.patch_id",
    "J9_band_lookup": chain(LB, DIM) + "SELECT band, channel, native_m, sensor, COUNT(lb.scene) AS n FROM (SELECT * FROM bd UNION ALL VALUES ('B01', NULL, 60, 'OPTICAL'), ('B09', NULL, 60, 'OPTICAL'), ('B10', NULL, 60, 'OPTICAL')) LEFT JOIN lb USING (band) GROUP BY ALL",
}
