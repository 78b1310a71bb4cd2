"""Regions against hand-made maps and a brute-force flood fill."""

from __future__ import annotations

import random

import pytest

from groundtally.functions import dims
from groundtally.operators import position, regions, taxonomy
from groundtally.operators.regions import MeasureParams

URBAN, FIELD, PINE, LAKE = 112, 211, 312, 512


def flood(mask, h, w, eight):
    """Components of a set of cells by plain flood fill."""
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    left, out = set(mask), []
    while left:
        todo, comp = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            comp.add((r, c))
            for dr, dc in steps:
                n = (r + dr, c + dc)
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(comp)
    return out


def filled(mask, h, w):
    background = {(r, c) for r in range(h) for c in range(w)} - mask
    holes = [g for g in flood(background, h, w, False) if not any(r in (0, h - 1) or c in (0, w - 1) for r, c in g)]
    return mask.union(*holes) if holes else mask


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("block", [4, 512])
def test_components_equal_flood_fill(spark, raster, connectivity, block):
    rng = random.Random(connectivity * 100 + block)
    h, w = 13, 11
    grids = {p: [[rng.choice([URBAN, URBAN, FIELD, LAKE, 999]) for _ in range(w)] for _ in range(h)] for p in range(4)}
    got = {}
    for row in regions.extract_regions(raster(grids), "c19", MeasureParams(connectivity=connectivity), block=block).collect():
        got.setdefault((row.patch_id, row.cls), []).append((row.area_px, row.r0, row.c0, row.r1, row.c1, round(row.centroid_row, 9)))
    for p, grid in grids.items():
        for code in (URBAN, FIELD, LAKE):
            cls = {r[0]: r[6] for r in dims.class_rows()}[code]
            mask = {(r, c) for r in range(h) for c in range(w) if grid[r][c] == code}
            want = []
            for comp in flood(filled(mask, h, w), h, w, connectivity == 8):
                rs, cs = [r for r, _ in comp], [c for _, c in comp]
                want.append((len(comp), min(rs), min(cs), max(rs) + 1, max(cs) + 1, round(sum(rs) / len(rs), 9)))
            assert sorted(got.get((p, cls), [])) == sorted(want)


def test_long_snake_crosses_many_blocks(spark, raster):
    n = 17
    grid = [[URBAN if r % 4 == 0 or (r % 4 == 1 and c == n - 1) or (r % 4 == 2 and c >= 0 and c == n - 1) or (r % 4 == 3 and c == n - 1) else FIELD for c in range(n)] for r in range(n)]
    urban = regions.extract_regions(raster({1: grid}), block=4, fill=False).filter("cls = 18").collect()
    assert len(urban) == 1
    assert urban[0].area_px == sum(x == URBAN for line in grid for x in line)


def test_checkerboard_depends_on_connectivity(raster):
    grid = [[URBAN if (r + c) % 2 == 0 else FIELD for c in range(4)] for r in range(4)]
    four = regions.extract_regions(raster({1: grid}), params=MeasureParams(connectivity=4), fill=False).filter("cls = 18").count()
    eight = regions.extract_regions(raster({1: grid}), params=MeasureParams(connectivity=8), fill=False).filter("cls = 18").count()
    assert (four, eight) == (8, 1)


def test_siblings_merge_before_labelling(raster):
    px = raster({1: [[111, 111, 112, 112]]})
    assert regions.extract_regions(px, "c19").count() == 1
    assert regions.extract_regions(px, "l3").count() == 2


def test_hole_is_filled_and_counts_towards_area(raster):
    grid = [[URBAN] * 5 for _ in range(5)]
    grid[2][2] = LAKE
    px = raster({1: grid})
    assert regions.extract_regions(px).filter("cls = 18").first().area_px == 25
    assert regions.extract_regions(px, fill=False).filter("cls = 18").first().area_px == 24


def test_mmu_keeps_equal_and_counts_dropped(raster):
    reg = regions.region_properties(regions.label_regions(raster({1: [[URBAN, FIELD, URBAN, URBAN, FIELD, URBAN]]})))
    kept, dropped = regions.mmu_filter(reg, 2)
    assert kept.filter("cls = 18").count() == 1
    assert dropped.filter("cls = 18").first().dropped_below_mmu == 2


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_opening_equals_brute_force(raster, radius):
    rng = random.Random(5 + radius)
    grid = [[URBAN if rng.random() < (0.8, 0.8, 0.93, 0.97)[radius] else FIELD for _ in range(31)] for _ in range(27)]
    mask = {(r, c) for r, line in enumerate(grid) for c, code in enumerate(line) if code == URBAN}
    disk = regions.disk_offsets(radius)
    eroded = {(r, c) for r, c in mask if all((r + y, c + x) in mask for y, x in disk)}
    want = {(r + y, c + x) for r, c in eroded for y, x in disk}
    runs = regions.open_runs(regions.class_runs(taxonomy.classified(raster({1: grid, 2: grid}), "c19")).filter("cls = 18"), radius).collect()
    for patch in (1, 2):
        cells = [(r.row, c) for r in runs if r.patch_id == patch for c in range(r.c0, r.c1 + 1)]
        assert want and len(cells) == len(want) and set(cells) == want


def speckled(rng, rows, cols):
    """Areas, speckle, lone classes and unclassified pixels; wider than a cell."""
    codes = [URBAN, FIELD, LAKE, 312, 999]
    return [[codes[(r // 7 + c // 19) % 3] if rng.random() < 0.85 else rng.choice(codes) for c in range(cols)] for r in range(rows)]


def test_contacts_equal_brute_force(raster):
    rng = random.Random(12)
    grids = {1: speckled(rng, 23, 150), 2: [[URBAN] * 200 + [LAKE], [FIELD] * 201], 3: [[URBAN], [999], [LAKE]]}
    px = raster(grids)
    cls = {(r.patch_id, r.row, r.col): r.cls for r in taxonomy.classified(px, "c19").collect()}
    near = {}
    for radius in range(6):
        overlap = {}
        for (p, r, c), b in cls.items():
            for a in {cls.get((p, r - dy, c - dx)) for dy, dx in regions.disk_offsets(radius)} - {None, b}:
                overlap[p, a, b] = overlap.get((p, a, b), 0) + 1
        got = {(r.patch_id, r.class_a, r.class_b): r.overlap_px for r in regions.adjacency(px, radius=radius).collect()}
        assert got == overlap, radius
        for key in overlap:
            near.setdefault(key, radius)
    for radii in ((0, 1, 2, 3, 5), (4,), (5, 1)):
        first = {k: min(x for x in radii if x >= v) for k, v in near.items() if v <= max(radii)}
        assert {(r.patch_id, r.class_a, r.class_b): r.radius for r in regions.contact_radius(px, radii).collect()} == first


@pytest.mark.parametrize("connectivity,fill", [(4, True), (8, False)])
def test_rasters_in_one_group_equal_rasters_in_blocks(raster, connectivity, fill):
    rng = random.Random(8)
    noise = [[rng.choice([URBAN, URBAN, FIELD, 999]) for _ in range(37)] for _ in range(29)]
    rings = [[URBAN if (min(r, c, 20 - r, 20 - c) // 2) % 2 else FIELD for c in range(21)] for r in range(21)]
    px = raster({1: noise, 2: rings, 3: [[LAKE]], 4: speckled(rng, 30, 40), 5: [[999, 999]]})
    params = MeasureParams(connectivity=connectivity, mmu_px=1)
    whole, pieces = (sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) for df in (
        regions.extract_regions(px, params=params, fill=fill), regions.extract_regions(px, params=params, fill=fill, block=8)))
    assert whole == pieces and len(whole) > 50


def test_contacts_read_no_pixel_twice(raster):
    px = raster({1: speckled(random.Random(1), 5, 9)})
    for df in (regions.adjacency(px), regions.contact_radius(px, (0, 1, 2, 3, 5))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        above = plan[:plan.index("LogicalRDD")]
        assert plan.count("LogicalRDD") == 1 and "Generate explode" not in above[above.rindex("Window"):]  # runs are made before anything is multiplied


def test_adjacency_radius_and_corner_contact(raster):
    apart = [[URBAN, FIELD, LAKE]]
    corner = [[URBAN, FIELD], [FIELD, LAKE]]
    def touch(grid, k):
        return regions.adjacency(raster({1: grid}), radius=k).filter("class_a = 18 and class_b = 8").count() == 1
    assert not touch(apart, 1) and touch(apart, 2)
    assert not touch(corner, 1) and touch(corner, 2)


def test_overlap_is_not_symmetric(raster):
    grid = [[URBAN, LAKE], [URBAN, FIELD], [URBAN, LAKE]]
    got = {(r.class_a, r.class_b): r.overlap_px for r in regions.adjacency(raster({1: grid})).collect()}
    assert got[(18, 1)] == 1 and got[(1, 18)] == 1 and got[(18, 8)] == 2


def test_unfitted_or_wrong_parameters_are_refused(raster):
    px = raster({1: [[URBAN]]})
    with pytest.raises(ValueError):
        regions.extract_regions(px, params=MeasureParams(connectivity=None))
    with pytest.raises(ValueError):
        regions.extract_regions(px, params=MeasureParams(connectivity=6))


def test_unknown_code_fails(raster):
    with pytest.raises(Exception, match="outside the nomenclature"):
        taxonomy.to_level(raster({1: [[777]]}), "c19").collect()


def test_levels_keep_every_pixel(raster):
    px = raster({1: [[122, 999, 211], [523, 332, 231]]})
    for level in ("l1", "l2", "l3", "c19", "coarse7"):
        assert taxonomy.to_level(px, level).count() == 6
    got = {r.code: r.cls for r in taxonomy.to_level(px, "c19").collect()}
    assert (got[122], got[332], got[999]) == (-1, -1, -2)


@pytest.mark.parametrize("where,direction", [((0, 5), "N"), ((0, 9), "NE"), ((5, 9), "E"), ((9, 9), "SE"), ((9, 5), "S"), ((9, 0), "SW"), ((5, 0), "W"), ((0, 0), "NW")])
def test_eight_directions(raster, where, direction):
    grid = [[FIELD] * 11 for _ in range(11)]
    grid[5][5] = LAKE
    grid[where[0]][where[1]] = URBAN
    if direction in ("NE", "SE", "SW"):
        grid[where[0]][where[1]] = FIELD
        grid[5 + (4 if "S" in direction else -4)][5 + (4 if "E" in direction else -4)] = URBAN
    px = raster({1: grid})
    f = regions.class_facts(regions.extract_regions(px, fill=False), regions.raster_shapes(px))
    row = position.relative_positions(f).filter("class_a = 18 and class_b = 8").first()
    assert row.valid and row.direction == direction


def test_band_edges_are_closed(spark):
    from pyspark.sql import functions as F

    from groundtally.functions.geometry import compass
    rows = [(37.0, "NE"), (36.9, "N"), (53.0, "NE"), (53.1, "E"), (0.0, "N"), (359.9, "N"), (315.0, "NW"), (225.0, "SW")]
    df = spark.createDataFrame(rows, "a double, want string").withColumn("got", compass(F.col("a"), 16))
    assert all(r.got == r.want for r in df.collect())


def test_referring_box_filters_and_qualifiers(raster):
    grid = [[FIELD] * 10 for _ in range(10)]
    for r in range(4):
        for c in range(4):
            grid[r][c] = URBAN
    grid[8][8] = grid[8][9] = URBAN
    px = raster({1: grid})
    got = {r.qualifier: r for r in position.referring_boxes(regions.extract_regions(px), regions.raster_shapes(px)).filter("cls = 18").collect()}
    assert got["largest"].area_px == 16 and got["smallest"].area_px == 2
    assert (got["largest"].x0, got["largest"].y1) == (0.0, 0.4)


def test_referring_point_reasons(spark, raster):
    px = raster({1: [[URBAN, 999], [122, LAKE]]})
    asked = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, 1.0, 0.0), (3, 1, 0.0, 1.0), (4, 1, 1.0, 1.0), (5, 1, 3.0, 0.0)], "id int, patch_id int, x double, y double")
    lab = regions.label_regions(px)
    got = {r.id: r.reason for r in position.referring_points(asked, px, regions.raster_shapes(px), lab, regions.region_properties(lab)).collect()}
    assert got == {1: "", 2: "point falls on an unclassified pixel", 3: "class 122 has no 19-class equivalent", 4: "", 5: "point outside the image"}
