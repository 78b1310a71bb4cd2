"""Regions of one class on a raster: runs, opening, hole fill, components, properties, adjacency.

Rasters stay relational. A pixel table is run-length encoded once; everything after works on runs
``(patch_id, cls, row, c0, c1)``. Components are found in two steps so that no task ever holds
more than one fixed-size block: runs are labelled inside blocks of ``BLOCK`` x ``BLOCK`` pixels,
and the few labels that meet at a block edge are merged by star contraction. A raster no larger
than a block needs no second step at all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtally.functions import fixed_values as V
from groundtally.operators import taxonomy
from groundtally.session import cut_lineage

BLOCK = 512
ROW_SHIFT = 1 << 32  # a label is the first pixel of its region: row * 2^32 + column, both of them ints

RUN_KEYS = ["patch_id", "cls"]


@dataclass(frozen=True)
class MeasureParams:
    """Measurement conventions; None means not fitted and is refused when needed."""

    connectivity: int | None = V.CONNECTIVITY
    mmu_px: int | None = V.MIN_MAPPING_UNIT_PX
    opening_px: int | None = V.OPENING_PX
    dilation_px: int | None = V.DILATION_PX
    diagonal_band_deg: float | None = V.DIAGONAL_BAND_DEG
    reference_rule: str | None = V.REFERENCE_RULES[0]
    gsd_m: float = V.GSD_M

    def require(self, *names: str) -> MeasureParams:
        missing = [n for n in names if getattr(self, n) is None]
        if missing:
            raise ValueError(f"measurement parameters not fitted: {missing}")
        if "connectivity" in names and self.connectivity not in (4, 8):
            raise ValueError("connectivity must be 4 or 8")
        return self


def raster_shapes(px: DataFrame) -> DataFrame:
    return px.groupBy("patch_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))


def disk_offsets(radius: int) -> list[tuple[int, int]]:
    r = max(radius, 0)
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


def disk_rows(radius: int) -> list[tuple[int, int]]:
    """(dy, half-width) of every row of a disk."""
    r = max(radius, 0)
    return [(dy, math.isqrt(r * r - dy * dy)) for dy in range(-r, r + 1)]


def _rows_of(rows: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(half).alias("half")) for dy, half in rows])).alias("o")


# ------------------------------------------------------------------------------ masks and runs
def class_runs(mask: DataFrame) -> DataFrame:
    """Pixels (patch_id, row, col, cls) -> maximal horizontal runs; one class per pixel."""
    w = Window.partitionBy("patch_id", "row").orderBy("col")
    start = F.coalesce(
        (F.col("cls") != F.lag("cls").over(w)) | (F.col("col") != F.lag("col").over(w) + 1), F.lit(True))
    return (
        mask.select("patch_id", "row", "col", "cls")
        .withColumn("_run", F.sum(F.when(start, 1).otherwise(0)).over(w))
        .groupBy("patch_id", "row", "_run")
        .agg(F.first("cls").alias("cls"), F.min("col").alias("c0"), F.max("col").alias("c1"))
        .select("patch_id", "cls", "row", "c0", "c1")
    )


def merge_runs(runs: DataFrame) -> DataFrame:
    """Joins runs of one class that touch or overlap inside a row."""
    w = Window.partitionBy("patch_id", "cls", "row").orderBy("c0")
    reach = F.max("c1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        runs.withColumn("_new", F.when(reach.isNull() | (F.col("c0") > reach + 1), 1).otherwise(0))
        .withColumn("_run", F.sum("_new").over(w))
        .groupBy("patch_id", "cls", "row", "_run")
        .agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("_run")
    )


def open_runs(runs: DataFrame, radius: int) -> DataFrame:
    """Morphological opening with a disk, on maximal runs: a pixel survives erosion when its whole disk is mask.

    A run erodes each row of the disk's reach to the run less the disk's half-width there, and each row of the disk gives a column at
    most once; so columns met by all rows of the disk are eroded mask, counted along the ends of these intervals. The
    dilation is the union of the eroded runs, widened. An opened set lies inside the mask, so nothing has to be clipped to the raster.
    """
    if radius <= 0:
        return runs.select(*RUN_KEYS, "row", "c0", "c1")
    disk = disk_rows(radius)
    met = runs.select(*RUN_KEYS, "row", "c0", "c1", _rows_of(disk)).select(
        *RUN_KEYS, (F.col("row") - F.col("o.dy")).alias("row"), (F.col("c0") + F.col("o.half")).alias("c0"), (F.col("c1") - F.col("o.half")).alias("c1"))
    ends = met.filter("c0 <= c1").select(*RUN_KEYS, "row", F.explode(F.array(
        F.struct(F.col("c0").alias("at"), F.lit(1).alias("step")), F.struct((F.col("c1") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    w = Window.partitionBy(*RUN_KEYS, "row").orderBy("at")
    depth = (ends.groupBy(*RUN_KEYS, "row", F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
             .select(*RUN_KEYS, "row", "at", F.sum("step").over(w).alias("depth"), F.lead("at").over(w).alias("next")))
    eroded = depth.filter(F.col("depth") == len(disk)).select(*RUN_KEYS, "row", F.col("at").alias("c0"), (F.col("next") - 1).alias("c1"))
    return merge_runs(eroded.select(*RUN_KEYS, "row", "c0", "c1", _rows_of(disk)).select(
        *RUN_KEYS, (F.col("row") + F.col("o.dy")).alias("row"), (F.col("c0") - F.col("o.half")).alias("c0"), (F.col("c1") + F.col("o.half")).alias("c1")))


def gap_runs(runs: DataFrame) -> DataFrame:
    """Background runs inside the bounding box of each class, flagged where they reach its rim.

    Background on the rim of a class's bounding box is always connected to the raster border,
    so nothing outside the box has to be visited to tell holes from outside.
    """
    box = runs.groupBy(*RUN_KEYS).agg(
        F.min("row").alias("b_r0"), F.max("row").alias("b_r1"), F.min("c0").alias("b_c0"), F.max("c1").alias("b_c1"))
    w = Window.partitionBy("patch_id", "cls", "row").orderBy("c0")
    spans = (
        runs.withColumn("_prev", F.lag("c1").over(w)).withColumn("_next", F.lead("c0").over(w))
        .join(box, RUN_KEYS)
    )
    before = F.struct((F.coalesce("_prev", F.col("b_c0") - 1) + 1).alias("c0"), (F.col("c0") - 1).alias("c1"))
    after = F.struct((F.col("c1") + 1).alias("c0"),
                     F.when(F.col("_next").isNull(), F.col("b_c1")).otherwise(F.col("c1")).alias("c1"))
    beside = spans.select(*RUN_KEYS, "row", "b_r0", "b_r1", "b_c0", "b_c1",
                          F.explode(F.array(before, after)).alias("g")).select(
        *RUN_KEYS, "row", "b_r0", "b_r1", "b_c0", "b_c1", "g.c0", "g.c1").filter("c0 <= c1")
    empty = (
        box.withColumn("row", F.explode(F.sequence("b_r0", "b_r1")))
        .join(runs.select(*RUN_KEYS, "row").distinct(), [*RUN_KEYS, "row"], "left_anti")
        .select(*RUN_KEYS, "row", "b_r0", "b_r1", "b_c0", "b_c1", F.col("b_c0").alias("c0"), F.col("b_c1").alias("c1"))
    )
    rim = (F.col("row") == F.col("b_r0")) | (F.col("row") == F.col("b_r1")) | \
        (F.col("c0") == F.col("b_c0")) | (F.col("c1") == F.col("b_c1"))
    return beside.unionByName(empty).select(*RUN_KEYS, "row", "c0", "c1", rim.alias("rim"))


def fill_holes(runs: DataFrame, block: int = BLOCK, max_side: tuple[int, int] | None = None) -> DataFrame:
    """Adds every background region that no 4-neighbour path connects to the border.

    Without ``max_side`` the runs are written first, since the longest side and the filling read them again.
    """
    if max_side is None:
        runs = cut_lineage(runs)
        max_side = longest_sides(runs)
    gaps = components(gap_runs(runs), 4, block, flag="rim", max_side=max_side)
    holes = gaps.filter(~F.col("rim")).select(*RUN_KEYS, "row", "c0", "c1")
    return merge_runs(runs.select(*RUN_KEYS, "row", "c0", "c1").unionByName(holes))


# ------------------------------------------------------------------------------ components
def _runs_meeting(cls: np.ndarray, row: np.ndarray, c0: np.ndarray, c1: np.ndarray, reach: int) -> np.ndarray:
    """Place of the first run of each run's component; runs sorted by class, row and column."""
    n = len(cls)
    if not n:
        return np.zeros(0, np.int64)
    r, left = row - row.min(), c0.min()
    line = np.unique(cls, return_inverse=True)[1] * (r.max() + 2) + r
    span = c1.max() - left + 4
    starts, ends = line * span + (c0 - left), line * span + (c1 - left)
    below = (line + 1) * span
    lo = np.searchsorted(ends, below + (c0 - left) - reach, "left")
    hi = np.searchsorted(starts, below + (c1 - left) + reach, "right")
    met = np.maximum(hi - lo, 0)
    src = np.repeat(np.arange(n), met)
    dst = np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met) + np.repeat(lo, met)
    lab = np.arange(n)
    while True:
        a, b = lab[src], lab[dst]
        if (a == b).all():
            return lab
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while (lab[lab] != lab).any():
            lab = lab[lab]


def _label_block(pdf: pd.DataFrame, reach: int, flag: str | None = None) -> pd.DataFrame:
    """First-pixel labels of the runs of one block (at most BLOCK*BLOCK/2 runs per class).

    A flag true on any run of a component becomes true on all of them.
    """
    pdf = pdf.sort_values(["cls", "row", "c0"], ignore_index=True)
    cls, row, c0, c1 = (pdf[c].to_numpy(np.int64) for c in ("cls", "row", "c0", "c1"))
    lab = _runs_meeting(cls, row, c0, c1, reach)
    pdf["label"] = (row * ROW_SHIFT + c0)[lab]
    if flag:
        on = np.zeros(len(pdf), dtype=bool)
        np.logical_or.at(on, lab, pdf[flag].to_numpy(bool))
        pdf[flag] = on[lab]
    return pdf


def _edge_links(pieces: DataFrame, reach: int, tall: int, block: int) -> DataFrame:
    """Label pairs that meet across an edge of blocks, ``tall`` by ``block`` pixels."""
    top = pieces.filter(F.col("row") % tall == tall - 1).select(
        *RUN_KEYS, "cb", (F.col("row") + 1).alias("row"), F.col("c0").alias("a0"), F.col("c1").alias("a1"),
        F.col("label").alias("u"))
    bottom = pieces.filter((F.col("row") % tall == 0) & (F.col("row") > 0)).select(
        *RUN_KEYS, "cb", "row", "c0", "c1", F.col("label").alias("v"))
    down = top.join(bottom, [*RUN_KEYS, "cb", "row"]).filter(
        (F.col("a0") <= F.col("c1") + reach) & (F.col("c0") <= F.col("a1") + reach))
    west = pieces.filter(F.col("c1") % block == block - 1).select(
        *RUN_KEYS, (F.col("cb") + 1).alias("cb"),
        F.explode(F.array(*[F.col("row") + F.lit(d) for d in range(-reach, reach + 1)])).alias("row"),
        F.col("label").alias("u"))
    east = pieces.filter((F.col("c0") % block == 0) & (F.col("c0") > 0)).select(
        *RUN_KEYS, "cb", "row", F.col("label").alias("v"))
    across = west.join(east, [*RUN_KEYS, "cb", "row"])
    both = down.select(*RUN_KEYS, "u", "v").unionByName(across.select(*RUN_KEYS, "u", "v"))
    return both.filter("u <> v").select(
        *RUN_KEYS, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _contract(links: DataFrame) -> DataFrame:
    """Star contraction: (keys, u > v) links -> (keys, label, root) with the smallest label as root."""
    edges = cut_lineage(links)
    while True:
        both = edges.unionByName(edges.select(*RUN_KEYS, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*RUN_KEYS, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, [*RUN_KEYS, "u"]).select(
            *RUN_KEYS, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy(*RUN_KEYS, "u").agg(F.min("v").alias("m"))
        small = large.join(floor, [*RUN_KEYS, "u"])
        step = (
            small.select(*RUN_KEYS, F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select(*RUN_KEYS, "u", F.col("m").alias("v")))
            .filter("u <> v").distinct()
        )
        after = cut_lineage(step)
        moved = after.join(edges, [*RUN_KEYS, "u", "v"], "left_anti").limit(1).count()
        lost = 0 if moved else edges.join(after, [*RUN_KEYS, "u", "v"], "left_anti").limit(1).count()
        edges = after
        if not moved and not lost:
            return edges.select(*RUN_KEYS, F.col("u").alias("label"), F.col("v").alias("root"))


def longest_sides(runs: DataFrame) -> tuple[int, int]:
    """The greatest height and the greatest width of all rasters."""
    last = runs.agg(F.max("row"), F.max("c1" if "c1" in runs.columns else "col")).first()
    return (0, 0) if last[0] is None else (int(last[0]) + 1, int(last[1]) + 1)


def block_height(sides: tuple[int, int], block: int = BLOCK) -> int:
    """Rows of a block: narrow rasters have taller ones, of no more pixels."""
    return max(block, block * block // max(1, sides[1]))


def one_block(sides: tuple[int, int], block: int = BLOCK) -> bool:
    return sides[0] <= block_height(sides, block) and sides[1] <= block


def components(runs: DataFrame, connectivity: int = 4, block: int = BLOCK, flag: str | None = None,
               max_side: tuple[int, int] | None = None) -> DataFrame:
    """Adds `label` to runs; runs wider than a block come back in block-wide pieces.

    ``max_side`` bounds raster height and width; without it one aggregate over the
    runs finds it. Narrow rasters have taller blocks of as many pixels. Rasters no larger than a block stay one lazy grouped map; otherwise labels
    meeting at block edges are merged afterwards. ``flag`` names a boolean column to spread over
    each component.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    reach = 1 if connectivity == 8 else 0
    carry = [flag] if flag else []
    if max_side is None:
        runs = cut_lineage(runs)  # else finding the side would encode the pixels once more
        max_side = longest_sides(runs)
    tall = block_height(max_side, block)
    pieces = (
        runs.select(*RUN_KEYS, "row", "c0", "c1", *carry)
        .withColumn("rb", F.floor(F.col("row") / tall).cast("int"))
        .withColumn("cb", F.explode(F.sequence(F.floor(F.col("c0") / block).cast("int"), F.floor(F.col("c1") / block).cast("int"))))
        .withColumn("c0", F.greatest("c0", F.col("cb") * block).cast("int"))
        .withColumn("c1", F.least("c1", F.col("cb") * block + (block - 1)).cast("int"))
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", label bigint"
    labelled = pieces.groupBy("patch_id", "rb", "cb").applyInPandas(
        lambda pdf: _label_block(pdf, reach, flag), schema)
    out = [*RUN_KEYS, "label", "row", "c0", "c1", *carry]
    if one_block(max_side, block):
        return labelled.select(*out)
    labelled = cut_lineage(labelled)
    links = _edge_links(labelled, reach, tall, block)
    if links.isEmpty():
        return labelled.select(*out)
    roots = _contract(links)
    merged = (
        labelled.join(roots, [*RUN_KEYS, "label"], "left")
        .withColumn("label", F.coalesce("root", "label")).select(*out)
    )
    if not flag:
        return merged
    whole = merged.groupBy(*RUN_KEYS, "label").agg(F.max(flag).alias(flag))
    return merged.drop(flag).join(whole, [*RUN_KEYS, "label"])


# ------------------------------------------------------------------------------ measured regions
def region_properties(labelled: DataFrame) -> DataFrame:
    """Area, half-open box, centroid and box fill of every region, from closed-form run sums."""
    n = F.col("c1") - F.col("c0") + 1
    return _with_shape(labelled.groupBy(*RUN_KEYS, "label").agg(
        F.sum(n).alias("area_px"), F.min("row").alias("r0"), F.min("c0").alias("c0"),
        (F.max("row") + 1).alias("r1"), (F.max("c1") + 1).alias("c1"),
        F.sum(F.col("row") * n).alias("sum_row"), F.sum((F.col("c0") + F.col("c1")) * n).alias("sum_col2")))


REGION = "patch_id {id}, cls int, label bigint, area_px bigint, r0 int, c0 int, r1 int, c1 int, sum_row bigint, sum_col2 bigint"


def _gaps(cls: np.ndarray, row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Background runs (cls, row, c0, c1, rim) inside the bounding box of each class, as in :func:`gap_runs`; runs sorted."""
    kinds, number = np.unique(cls, return_inverse=True)
    top, bottom, left, right = (np.full(len(kinds), x, np.int64) for x in (1 << 40, -1, 1 << 40, -1))
    np.minimum.at(top, number, row)
    np.maximum.at(bottom, number, row)
    np.minimum.at(left, number, c0)
    np.maximum.at(right, number, c1)
    opens = np.ones(len(cls), bool)
    opens[1:] = (number[1:] != number[:-1]) | (row[1:] != row[:-1])
    closes = np.append(opens[1:], True)
    before = np.where(opens, left[number], np.append(0, c1[:-1]) + 1)
    parts = [(number, row, before, c0 - 1), (number[closes], row[closes], c1[closes] + 1, right[number[closes]])]
    # Rows of the box without any run of the class.
    height = bottom - top + 1
    held = np.zeros(height.sum(), bool)
    base = np.cumsum(height) - height
    held[base[number] + row - top[number]] = True
    bare = np.flatnonzero(~held)
    owner = np.searchsorted(base, bare, "right") - 1
    parts.append((owner, bare - base[owner] + top[owner], left[owner], right[owner]))
    k, r, a, b = (np.concatenate(x) for x in zip(*parts))
    some = a <= b
    k, r, a, b = k[some], r[some], a[some], b[some]
    rim = (r == top[k]) | (r == bottom[k]) | (a == left[k]) | (b == right[k])
    return kinds[k], r, a, b, rim


def _in_order(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((columns[2], columns[1], columns[0]))
    return tuple(c[order] for c in columns)


def _patch_regions(runs: pd.DataFrame, reach: int, fill: bool) -> pd.DataFrame:
    """Filled, labelled and summed regions of all classes of one raster, from its runs."""
    cls, row, c0, c1 = _in_order(*(runs[c].to_numpy(np.int64) for c in ("cls", "row", "c0", "c1")))
    if fill:
        g = _in_order(*_gaps(cls, row, c0, c1))
        lab = _runs_meeting(*g[:4], 0)
        open_ = np.zeros(len(lab), bool)
        np.logical_or.at(open_, lab, g[4])
        hole = ~open_[lab]
        cls, row, c0, c1 = _in_order(*(np.concatenate((x, y[hole])) for x, y in zip((cls, row, c0, c1), g)))
        # A hole's run ends where runs of the class begin.
        first = np.ones(len(cls), bool)
        first[1:] = (cls[1:] != cls[:-1]) | (row[1:] != row[:-1]) | (c0[1:] > c1[:-1] + 1)
        at = np.flatnonzero(first)
        cls, row, c0, c1 = cls[at], row[at], c0[at], c1[np.append(at[1:], len(first)) - 1]
    lab = _runs_meeting(cls, row, c0, c1, reach)
    heads, number = np.unique(lab, return_inverse=True)
    n = c1 - c0 + 1
    sums = {name: np.bincount(number, x, len(heads)).astype(np.int64) for name, x in (("area_px", n), ("sum_row", row * n), ("sum_col2", (c0 + c1) * n))}
    ends = {"r0": np.full(len(heads), 1 << 40), "c0": np.full(len(heads), 1 << 40), "r1": np.full(len(heads), -1), "c1": np.full(len(heads), -1)}
    for name, x, put in (("r0", row, np.minimum), ("c0", c0, np.minimum), ("r1", row + 1, np.maximum), ("c1", c1 + 1, np.maximum)):
        put.at(ends[name], number, x)
    patch = [runs["patch_id"].iloc[0]] * len(heads)
    return pd.DataFrame({"patch_id": patch, "cls": cls[heads], "label": row[heads] * ROW_SHIFT + c0[heads], "area_px": sums["area_px"],
                         **{k: ends[k] for k in ("r0", "c0", "r1", "c1")}, "sum_row": sums["sum_row"], "sum_col2": sums["sum_col2"]})


def _with_shape(sums: DataFrame) -> DataFrame:
    return (sums.withColumn("centroid_row", F.col("sum_row") / F.col("area_px"))
            .withColumn("centroid_col", F.col("sum_col2") / (2 * F.col("area_px")))
            .withColumn("bbox_fill", F.col("area_px") / ((F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0")))))


def patch_regions(own: LevelRuns, connectivity: int, fill: bool) -> DataFrame:
    """:func:`region_properties` of rasters that fit a block: filling, labelling and summing in one pass over each raster's runs."""
    reach = 1 if connectivity == 8 else 0
    kind = own.runs.schema["patch_id"].dataType.simpleString()
    return _with_shape(own.runs.select("patch_id", "cls", "row", "c0", "c1").groupBy("patch_id").applyInPandas(
        lambda pdf: _patch_regions(pdf, reach, fill), REGION.format(id=kind)))


def mmu_filter(regions: DataFrame, mmu_px: int) -> tuple[DataFrame, DataFrame]:
    """Surviving regions, and per (patch, class) how many fell below the unit."""
    dropped = regions.groupBy(*RUN_KEYS).agg(F.count_if(F.col("area_px") < mmu_px).alias("dropped_below_mmu"))
    return regions.filter(F.col("area_px") >= mmu_px), dropped


@dataclass(frozen=True)
class LevelRuns:
    """The runs of a level, written once: all that measurements need of the pixels.

    ``runs`` holds the classified runs after opening, ``raw`` those before it, ``shapes`` the raster sizes, ``side`` the greatest height and width.
    """

    runs: DataFrame
    raw: DataFrame
    shapes: DataFrame
    side: tuple[int, int]


def level_runs(px: DataFrame, level: str = "c19", opening_px: int = 0) -> LevelRuns:
    """One pass over the pixels. Unclassified runs are kept beside the others, so that they count for the sizes."""
    coded = taxonomy.to_level(px, level).select("patch_id", "row", "col", "cls")
    every = cut_lineage(class_runs(coded))
    shapes = every.groupBy("patch_id").agg((F.max("row") + 1).alias("h"), (F.max("c1") + 1).alias("w"))
    raw = every.filter("cls >= 0")
    return LevelRuns(cut_lineage(open_runs(raw, opening_px)) if opening_px else raw, raw, shapes, longest_sides(every))


def label_regions(px: DataFrame | LevelRuns, level: str = "c19", params: MeasureParams | None = None, *, fill: bool = True,
                  block: int = BLOCK) -> DataFrame:
    """Labelled runs of every class at ``level``: aggregate, open, fill, then label."""
    p = (params or MeasureParams()).require("connectivity", "mmu_px", "opening_px")
    own = px if isinstance(px, LevelRuns) else level_runs(px, level, p.opening_px)
    runs = fill_holes(own.runs, block, own.side) if fill else own.runs
    return components(runs, p.connectivity, block, max_side=own.side)


def extract_regions(px: DataFrame | LevelRuns, level: str = "c19", params: MeasureParams | None = None, *, fill: bool = True,
                    block: int = BLOCK) -> DataFrame:
    """All surviving regions of all classes of all patches in one pass.

    Rasters no larger than a block are measured from their runs in a group each; larger ones are labelled by blocks and merged.
    """
    p = (params or MeasureParams()).require("connectivity", "mmu_px", "opening_px")
    own = px if isinstance(px, LevelRuns) else level_runs(px, level, p.opening_px)
    found = patch_regions(own, p.connectivity, fill) if one_block(own.side, block) else region_properties(label_regions(own, level, p, fill=fill, block=block))
    return mmu_filter(found, p.mmu_px)[0]


def measure_classes(px: DataFrame | LevelRuns, level: str = "c19", params: MeasureParams | None = None) -> DataFrame:
    """:func:`class_facts` of whole rasters, from one pass over the pixels."""
    p = (params or MeasureParams()).require("opening_px")
    own = px if isinstance(px, LevelRuns) else level_runs(px, level, p.opening_px)
    return class_facts(extract_regions(own, level, p), own.shapes)


def class_facts(regions: DataFrame, shapes: DataFrame, gsd_m: float = V.GSD_M) -> DataFrame:
    """Per (patch, class): count, area, coverage and the three candidate reference points."""
    f = regions.groupBy(*RUN_KEYS).agg(
        F.count("*").alias("n_regions"), F.sum("area_px").alias("area_px"),
        (F.sum("sum_row") / F.sum("area_px")).alias("mask_row"),
        (F.sum("sum_col2") / (2 * F.sum("area_px"))).alias("mask_col"),
        F.max_by(F.struct("centroid_row", "centroid_col"), F.struct(F.col("area_px"), -F.col("label"))).alias("_big"),
        ((F.min("r0") + F.max("r1")) / 2).alias("box_row"), ((F.min("c0") + F.max("c1")) / 2).alias("box_col"))
    return f.join(shapes, "patch_id").select(
        *RUN_KEYS, "n_regions", "area_px", (F.col("area_px") * (gsd_m * gsd_m)).alias("area_m2"),
        (F.col("area_px") / (F.col("h") * F.col("w"))).alias("coverage"),
        (100.0 * F.col("area_px") / (F.col("h") * F.col("w"))).alias("coverage_pct"),
        "mask_row", "mask_col", F.col("_big.centroid_row").alias("big_row"), F.col("_big.centroid_col").alias("big_col"),
        "box_row", "box_col", "h", "w")


# ------------------------------------------------------------------------------ contacts
#: Columns of a cell; runs of neighbouring rows meet inside cells, so a cell holds at most this many runs of a row.
CELL = 64


def _in_cells(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.floor(F.greatest(lo, F.lit(0)) / CELL).cast("int"), F.floor(hi / CELL).cast("int"))).alias("cell")


def row_meetings(runs: DataFrame, rows: list[tuple[int, int]]) -> DataFrame:
    """Overlap join of runs with the runs of neighbouring rows, by column intervals.

    Every run visits the rows ``dy`` away, widened by ``half`` for each (dy, half), and stays in its own row too; whom it meets in
    a cell of :data:`CELL` columns is (patch_id, row, cell, a, b), ``a`` being the visitor (cls, c0, c1, dy, lo, hi) and ``b`` (cls, c0, c1).
    Ends are those of whole runs, ``lo`` and ``hi`` those of the widened visitor; a pair that meets in several cells comes from each of them.
    """
    stay, visit = F.lit(None).cast("int"), F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(half).alias("half")) for dy, half in rows])
    told = runs.select("patch_id", "cls", "row", "c0", "c1", F.explode(F.concat(
        F.array(F.struct(stay.alias("dy"), F.lit(0).alias("half"))), visit)).alias("o")).select(
        "patch_id", (F.col("row") + F.coalesce("o.dy", F.lit(0))).alias("row"), "cls", "c0", "c1", F.col("o.dy").alias("dy"),
        (F.col("c0") - F.col("o.half")).alias("lo"), (F.col("c1") + F.col("o.half")).alias("hi"))
    placed = told.select("*", _in_cells(F.col("lo"), F.col("hi")))
    met = placed.groupBy("patch_id", "row", "cell").agg(
        F.collect_list(F.when(F.col("dy").isNotNull(), F.struct("cls", "c0", "c1", "dy", "lo", "hi"))).alias("visitors"),
        F.collect_list(F.when(F.col("dy").isNull(), F.struct("cls", "c0", "c1"))).alias("own")).filter("size(visitors) > 0 and size(own) > 0")
    return met.select("patch_id", "row", "cell", "visitors", F.explode("own").alias("b")).select(
        "patch_id", "row", "cell", "b", F.explode("visitors").alias("a")).filter("a.cls <> b.cls and a.lo <= b.c1 and b.c0 <= a.hi")


def adjacency(px: DataFrame | LevelRuns, level: str = "c19", radius: int = V.DILATION_PX) -> DataFrame:
    """Every ordered class pair that touches: pixels of B inside A dilated by a disk.

    Raw class pixels, no clean-up. What the runs of A cover of a run of B is a union of intervals, so it is counted from their ends.
    """
    raw = px.raw if isinstance(px, LevelRuns) else class_runs(taxonomy.classified(px, level))
    first, last = F.col("cell") * CELL, F.col("cell") * CELL + (CELL - 1)
    met = row_meetings(raw, disk_rows(radius)).select(
        "patch_id", "row", "cell", F.col("a.cls").alias("class_a"), F.col("b.cls").alias("class_b"),
        F.greatest("a.lo", "b.c0", first).alias("lo"), F.least("a.hi", "b.c1", last).alias("hi")).filter("lo <= hi")
    w = Window.partitionBy("patch_id", "row", "cell", "class_a", "class_b").orderBy("lo")
    reach = F.coalesce(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    fresh = met.withColumn("px", F.greatest(F.col("hi") - F.greatest(F.col("lo"), reach + 1) + 1, F.lit(0)))
    return fresh.groupBy("patch_id", "class_a", "class_b").agg(F.sum("px").alias("overlap_px"))


def contact_radius(px: DataFrame | LevelRuns, radii: tuple[int, ...], level: str = "c19") -> DataFrame:
    """Smallest radius of the list at which A dilated by a disk reaches B, for all ordered class pairs in one pass.

    Two runs ``dy`` rows and ``gap`` columns apart touch at the first radius whose square holds dy^2 + gap^2. Touching is mutual, so
    runs visit the rows below alone.
    """
    raw = px.raw if isinstance(px, LevelRuns) else class_runs(taxonomy.classified(px, level))
    gap = F.greatest(F.col("b.c0") - F.col("a.c1"), F.col("a.c0") - F.col("b.c1"), F.lit(0))
    apart = F.col("a.dy") * F.col("a.dy") + gap * gap
    known = sorted(radii)
    first = F.coalesce(*[F.when(apart <= k * k, F.lit(k)) for k in known])
    met = row_meetings(raw, [(dy, half) for dy, half in disk_rows(known[-1]) if dy >= 0]).select(
        "patch_id", F.col("a.cls").alias("x"), F.col("b.cls").alias("y"), first.alias("radius")).filter("radius is not null")
    near = met.groupBy("patch_id", "x", "y").agg(F.min("radius").alias("radius"))
    both = near.select("patch_id", "radius", F.explode(F.array(
        F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("p"))
    return both.groupBy("patch_id", F.col("p.a").alias("class_a"), F.col("p.b").alias("class_b")).agg(F.min("radius").alias("radius"))
