"""Direction, interval and distance column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundtally.functions import dims
from groundtally.functions import fixed_values as V


def bearing(d_row: Column, d_col: Column) -> Column:
    """Degrees clockwise from north; rows grow southwards. Null where the points coincide."""
    raw = F.degrees(F.atan2(d_col, -d_row))
    wrapped = raw - 360.0 * F.floor(raw / 360.0)
    return F.when(~((d_row == 0) & (d_col == 0)), wrapped)


def compass(angle: Column, band: Column | float) -> Column:
    """Eight-way label with diagonal sectors of total width ``band``, closed at both ends."""
    band = band if isinstance(band, Column) else F.lit(float(band))
    within = angle - 90.0 * F.floor(angle / 90.0)
    diagonal = F.element_at(F.array(*[F.lit(x) for x in ("NE", "SE", "SW", "NW")]), (F.floor(angle / 90.0) % 4 + 1).cast("int"))
    cardinal = F.element_at(F.array(*[F.lit(x) for x in ("N", "E", "S", "W")]), (F.rint(angle / 90.0) % 4 + 1).cast("int"))
    return F.when(F.abs(within - 45.0) <= band / 2.0, diagonal).when(angle.isNotNull(), cardinal)


def angular_gap(a: Column, b: Column) -> Column:
    deg = dims.literal_map(V.COMPASS_DEGREES)
    d = F.abs(F.element_at(deg, a) - F.element_at(deg, b))
    return F.least(d, 360 - d)


def tier(coverage: Column) -> Column:
    return (F.when(coverage > V.TIER_PRIMARY, F.lit("primary"))
            .when(coverage >= V.TIER_SECONDARY, F.lit("secondary")).otherwise(F.lit("marginal")))


def in_interval(rule: str, v: Column, lo: Column, hi: Column) -> Column:
    """Membership of ``v`` under one of the three boundary rules."""
    if rule == "inclusive_lower_exclusive_upper":
        return ((v >= lo) & (v < hi)) | ((hi >= 100) & (v >= lo))
    if rule == "inclusive_both":
        return (v >= lo) & (v <= hi)
    if rule == "exclusive_lower_inclusive_upper":
        return ((v > lo) & (v <= hi)) | ((lo <= 0) & (v == 0))
    raise ValueError(f"unknown interval rule {rule}")


def decile(pct: Column) -> Column:
    return F.least(F.floor(pct / 10), F.lit(10)).cast("int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * V.EARTH_RADIUS_KM * F.asin(F.sqrt(a))
