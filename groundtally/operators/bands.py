"""Sensor preprocessing over the long band table (scene, band, row, col, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtally.functions import dims
from groundtally.functions import fixed_values as V

CHANNELS = V.S1_BANDS + V.S2_BANDS


def band_dim(spark: SparkSession) -> DataFrame:
    """Channel index and native resolution of every known band; discarded 60 m bands have no index."""
    rows = [(b, i, 20 if b in V.S2_NATIVE_20M else 10, "SAR" if b in V.S1_BANDS else "OPTICAL") for i, b in enumerate(CHANNELS)]
    rows += [(b, None, 60, "OPTICAL") for b in V.S2_DISCARDED_60M]
    return dims.literal_table(spark, rows, "band string, channel int, native_m int, sensor string")


def linear_to_db(power: Column) -> Column:
    """10*log10 with non-positive power floored; non-finite input is refused, not repaired."""
    bad = F.isnan(power) | power.isin(float("inf"), float("-inf"))
    refuse = F.raise_error(F.lit("power is not finite")).cast("double")
    return F.when(bad, refuse).otherwise(10.0 * F.log10(F.when(power <= 0, F.lit(V.DB_FLOOR_POWER)).otherwise(power)))


def db_conversion(df: DataFrame, *keys: str) -> DataFrame:
    """Per key: values converted, values floored, mean dB."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("value") <= 0).alias("floored"), F.avg(linear_to_db(F.col("value"))).alias("mean_db"))


def resample(bands: DataFrame, src: DataFrame, target: DataFrame) -> DataFrame:
    """Bilinear resampling on pixel centres with clipped edges.

    ``src`` and ``target`` give (scene, h, w) and (scene, out_h, out_w). Each source pixel is dealt to
    the four cells between pixels that it is a corner of, and a cell with its corners makes the target
    pixels whose centres lie in it: work grows with the pixels, and no grid is crossed with another.
    Places are whole numbers of 64 bits. A cell that lacks a corner makes none.
    """
    corners = F.inline(F.array(*[F.struct((F.col("row") - r).alias("y0"), (F.col("col") - c).alias("x0"), F.lit(1 << (2 * r + c)).alias("at")) for r in (0, 1) for c in (0, 1)]))
    dealt = bands.select("scene", "band", "row", "col", "value").select("scene", "band", "value", corners).filter("y0 >= 0 AND x0 >= 0")
    cells = dealt.groupBy("scene", "band", "y0", "x0").agg(
        F.bit_or("at").alias("met"), *[F.max(F.when(F.col("at") == 1 << k, F.col("value"))).alias(f"v{k}") for k in range(4)])
    size = src.select("scene", *[F.col(c).cast("long").alias(c) for c in ("h", "w")]).join(
        target.select("scene", *[F.col(c).cast("long").alias(c) for c in ("out_h", "out_w")]), "scene")
    cells = cells.join(size, "scene").filter("y0 < h AND x0 < w")
    last_y, last_x = F.col("y0") == F.col("h") - 1, F.col("x0") == F.col("w") - 1  # corners past the edge are clipped to it
    needed = F.when(last_y, 3).otherwise(15).bitwiseAND(F.when(last_x, 5).otherwise(15))
    v1 = F.when(last_x, F.col("v0")).otherwise(F.col("v1"))
    v2 = F.when(last_y, F.col("v0")).otherwise(F.col("v2"))
    v3 = F.when(last_y, v1).when(last_x, F.col("v2")).otherwise(F.col("v3"))

    def bounds(i, n, out, last):
        """First and last target t whose centre ((2t + 1) n - out) / 2 out, clipped to the grid, lies in cell i."""
        i, n, out = F.col(i).cast("long"), F.col(n), F.col(out)
        lo, after = (F.floor(((2 * i + k) * out + n - 1) / (2 * n)) for k in (1, 3))
        return F.when(i == 0, F.lit(0)).otherwise(lo).cast("int"), F.when(last, out - 1).otherwise(after - 1).cast("int")

    (t0, t1), (s0, s1) = bounds("y0", "h", "out_h", last_y), bounds("x0", "w", "out_w", last_x)
    grid = cells.filter(F.col("met").bitwiseAND(needed) == needed).select(
        "scene", "band", "y0", "x0", "h", "w", "out_h", "out_w", "v0", v1.alias("v1"), v2.alias("v2"), v3.alias("v3"), t0.alias("t0"), t1.alias("t1"), s0.alias("s0"), s1.alias("s1"))
    grid = grid.filter("t1 >= t0 AND s1 >= s0").withColumn("row", F.explode_outer(F.sequence("t0", "t1"))).withColumn("col", F.explode_outer(F.sequence("s0", "s1")))

    def part(t, i, n, out):
        """How far the centre lies from the cell's first corner towards its last."""
        i, t, n, out = F.col(i).cast("long"), F.col(t).cast("long"), F.col(n), F.col(out)
        return F.when(i == n - 1, F.lit(0.0)).otherwise(F.greatest((2 * t + 1) * n - (2 * i + 1) * out, F.lit(0)) / (2 * out))

    grid = grid.withColumns({"dy": part("row", "y0", "h", "out_h"), "dx": part("col", "x0", "w", "out_w")})
    top, bottom = (F.col(a) * (1 - F.col("dx")) + F.col(b) * F.col("dx") for a, b in (("v0", "v1"), ("v2", "v3")))
    return grid.select("scene", "band", "row", "col", (top * (1 - F.col("dy")) + bottom * F.col("dy")).alias("value"))


def norm_stats(bands: DataFrame) -> DataFrame:
    """Mean and population deviation per frozen channel, SAR in dB, from n, sum and sum of squares.

    Give it training rows only. A channel never seen has n = 0 and is flagged missing.
    """
    v = F.when(F.col("band").isin(*V.S1_BANDS), linear_to_db(F.col("value"))).otherwise(F.col("value"))
    ok = bands.filter(~F.isnan("value") & ~F.col("value").isin(float("inf"), float("-inf"))).withColumn("v", v)
    s = ok.groupBy("band").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    mean = F.col("s") / F.col("n")
    dim = band_dim(bands.sparkSession).filter("channel is not null").select("band", "channel")
    return dim.join(s, "band", "left").select(
        "band", "channel", F.coalesce("n", F.lit(0)).alias("n"), F.round(mean, 6).alias("mean"),
        F.round(F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))), 6).alias("std"), F.col("n").isNull().alias("missing"))


def zscore(bands: DataFrame, stats: DataFrame) -> DataFrame:
    """Standardises with frozen statistics (at most 12 rows); a deviation that is not positive is refused."""
    refuse = F.raise_error(F.concat(F.lit("std must be positive: "), F.col("band"))).cast("double")
    z = (F.col("value") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")).otherwise(refuse)
    return bands.join(F.broadcast(stats.filter(~F.col("missing")).select("band", "mean", "std")), "band").withColumn("z", z)


def band_presence(bands: DataFrame, dropped: tuple[str, ...] = ()) -> DataFrame:
    """Per scene the 0/1 vector over the ten optical bands and the bands not measured."""
    unknown = set(dropped) - set(V.S2_BANDS)
    if unknown:
        raise ValueError(f"unknown optical bands {sorted(unknown)}")
    known = F.col("band").isin(*CHANNELS, *V.S2_DISCARDED_60M)
    ok = F.assert_true(known, F.concat(F.lit("unknown band "), F.col("band")))
    checked = bands.filter(F.coalesce(ok.cast("boolean"), F.lit(True)))
    seen = checked.groupBy("scene").agg(F.collect_set("band").alias("seen"))  # 15 names at most
    usable = F.array_except("seen", F.array(*[F.lit(b) for b in dropped]).cast("array<string>"))
    order = F.array(*[F.lit(b) for b in V.S2_BANDS])
    vector = F.transform(order, lambda b: F.when(F.array_contains(usable, b), F.lit(1.0)).otherwise(F.lit(0.0)))
    return seen.select("scene", vector.alias("presence"), F.filter(order, lambda b: ~F.array_contains(usable, b)).alias("not_measured"))


def spectral_indices(bands: DataFrame, kinds: Sequence[str] = tuple(V.SPECTRAL_INDICES)) -> DataFrame:
    """(kind, scene, row, col, value, reason) of every kind from one pivot; a pixel with neither band of a kind has no row."""
    for kind in kinds:
        if kind.lower() not in V.SPECTRAL_INDICES:
            raise ValueError(f"unknown spectral index {kind}")
    needed = sorted({b for k in kinds for b in V.SPECTRAL_INDICES[k.lower()]})
    wide = bands.filter(F.col("band").isin(*needed)).groupBy("scene", "row", "col").agg(
        *[F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"v_{b}") for b in needed], F.collect_set("band").alias("met"))
    each = [F.struct(F.lit(k).alias("kind"), *[F.col(f"v_{b}").alias(n) for n, b in zip("ab", V.SPECTRAL_INDICES[k.lower()])],
                     F.arrays_overlap("met", F.array(*[F.lit(b) for b in V.SPECTRAL_INDICES[k.lower()]])).alias("met")) for k in kinds]
    p = wide.select("scene", "row", "col", F.inline(F.array(*each))).filter("met")
    return p.select("kind", "scene", "row", "col", F.when(F.col("a") + F.col("b") == 0, F.lit(0.0)).otherwise((F.col("a") - F.col("b")) / (F.col("a") + F.col("b"))).alias("value"),
                    F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit("index_bands")).alias("reason"))


def spectral_index(bands: DataFrame, kind: str) -> DataFrame:
    """(scene, row, col, value, reason): normalised difference, zero denominator gives zero."""
    return spectral_indices(bands, (kind,)).drop("kind")


def checked_grids(bands: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Bands, all of whose scenes are sound: each band that a scene has covers the scene's whole grid, once. One fault refuses the table.

    ``target`` gives (scene, out_h, out_w); without it the largest extent of the scene's bands is its grid.
    """
    per = bands.groupBy("scene", "band").agg(F.count("*").alias("n"), (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    if target is None:
        sizes = per.groupBy("scene").agg(F.max("h").alias("out_h"), F.max("w").alias("out_w"))
    else:
        sizes = target.select("scene", "out_h", "out_w")
    bad = (F.col("h") != F.col("out_h")) | (F.col("w") != F.col("out_w")) | (F.col("n") != F.col("out_h").cast("long") * F.col("out_w"))
    told = F.concat(F.lit("band "), F.col("band"), F.lit(" does not cover the grid of scene "), F.col("scene").cast("string"))
    fault = per.join(sizes, "scene").agg(F.max(F.when(bad, told)).alias("fault"))  # one row: pixels aren't dealt by scene for it
    joined = bands.join(F.broadcast(fault))
    return joined.filter(F.when(F.col("fault").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("fault")).cast("boolean"))).drop("fault")


def stack_channels(bands: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Twelve values per pixel in the frozen order; a band that a scene lacks is zero-filled, one of another shape refused."""
    return _stacked(checked_grids(bands, target))


def _stacked(bands: DataFrame) -> DataFrame:
    cols = [F.coalesce(F.max(F.when(F.col("band") == b, F.col("value"))), F.lit(0.0)).alias(b) for b in CHANNELS]
    return bands.groupBy("scene", "row", "col").agg(*cols).select("scene", "row", "col", F.array(*CHANNELS).alias("channels"))


def preprocess(bands: DataFrame, src20: DataFrame, target: DataFrame, dropped: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Tensor and presence from one declaration of what was measured, so they cannot disagree."""
    usable = bands.filter(~F.col("band").isin(*dropped)) if dropped else bands
    low = F.col("band").isin(*V.S2_NATIVE_20M)
    coarse = checked_grids(usable.filter(low), src20.select("scene", F.col("h").alias("out_h"), F.col("w").alias("out_w")))  # before they are resampled, which is done once
    full = checked_grids(usable.filter(~low), target).unionByName(resample(coarse, src20, target).select(*bands.columns))
    return _stacked(full), band_presence(bands, dropped)
