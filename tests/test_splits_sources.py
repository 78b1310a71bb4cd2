"""Folds, leakage checks, guards, manifests, bands and streams."""

from __future__ import annotations

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from groundtally.functions import text
from groundtally.operators import bands, quality, splits
from groundtally.sources import files, tables


def grid(spark, tiles=("T30ABC",), n=3):
    rows = [(f"S2A_X_{t}_{r}_{c}", t, r, c, "Fr" if c < n / 2 else "De", 45.0 + i + r / 80, 3.0 + i + c / 60)
            for i, t in enumerate(tiles) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "patch_id string, tile string, row int, col int, country string, lat double, lon double")


def test_three_by_three_has_twenty_touching_pairs(spark):
    assert splits.touching_pairs(grid(spark)).first().n_pairs == 20


def test_tile_blocks_sever_nothing_and_country_blocks_do(spark):
    p = grid(spark, [f"T{30 + i}ABC" for i in range(6)], 4)
    assert splits.severed_pairs(splits.assign_folds(p, "s2_tile", 3)).count() == 0
    assert splits.severed_pairs(splits.assign_folds(p, "country", 2)).count() > 0
    assert splits.folds_per_block(splits.assign_folds(p, "s2_tile", 3)).filter("spans").count() == 0


def test_greedy_packing_order_and_refusals(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 9), ("c", 8), ("d", 2), ("e", 1)], "block string, n long")
    got = {r.block: r.fold for r in splits.pack_folds(sizes, 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 1}
    with pytest.raises(Exception, match="fewer blocks"):
        splits.pack_folds(sizes, 6).collect()
    with pytest.raises(ValueError):
        splits.pack_folds(sizes, 1)


def test_stratified_packing_spreads_a_rare_class(spark):
    sizes = spark.createDataFrame([(b, 10) for b in "abcdef"], "block string, n long")
    cont = spark.createDataFrame([(b, 1) for b in "abcdef"] + [("a", 2), ("b", 2)], "block string, cls int")
    got = {r.block: r.fold for r in splits.pack_folds_stratified(sizes, cont, 2).collect()}
    assert got["a"] != got["b"]


@pytest.mark.parametrize("seed,spread", [(1, 60.0), (2, 0.5), (3, 0.001)])
def test_min_distance_equals_all_pairs(spark, seed, spread):
    rng = random.Random(seed)
    pts = [(rng.uniform(-spread, spread), rng.uniform(-spread, spread) * 2, i % 3) for i in range(60)]
    pts += [(lat, lon, fold) for lat, lon, fold in ((10.0, 179.9, 0), (10.0, -179.9, 0))]

    def km(a, b):
        p1, p2 = math.radians(a[0]), math.radians(b[0])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))
    want = min(km(a, b) for a, b in itertools.combinations(pts, 2) if a[2] != b[2])
    got = splits.min_fold_distance(spark.createDataFrame(pts, "lat double, lon double, fold int")).first().min_km
    assert got == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_min_distance_refines_dense_cells(spark, monkeypatch):
    monkeypatch.setattr(splits, "MAX_POINT_PAIRS", 10)
    rng = random.Random(9)
    pts = [(rng.uniform(0, 0.4), rng.uniform(0, 1), 0) for _ in range(150)] + [(rng.uniform(0.6, 1), rng.uniform(0, 1), 1) for _ in range(150)]
    got = splits.min_fold_distance(spark.createDataFrame(pts, "lat double, lon double, fold int")).first().min_km

    def km(a, b):
        p1, p2 = math.radians(a[0]), math.radians(b[0])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))
    assert got == pytest.approx(min(km(a, b) for a in pts for b in pts if a[2] != b[2]), rel=1e-9)


def test_min_distance_between_far_clusters_and_across_the_date_line(spark):
    far = [(0.0, 0.0, 0), (0.1, 0.1, 0), (20.0, 30.0, 1), (20.1, 30.1, 1)]
    assert splits.min_fold_distance(spark.createDataFrame(far, "lat double, lon double, fold int")).first().min_km == pytest.approx(3974, rel=0.02)
    line = [(0.0, 179.99, 0), (0.0, -179.99, 1), (0.0, 178.0, 1)]
    assert splits.min_fold_distance(spark.createDataFrame(line, "lat double, lon double, fold int")).first().min_km == pytest.approx(2.2239, rel=1e-3)


def test_same_block_rate_equals_enumeration(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.randrange(3)) for _ in range(40)]
    cross = [(x, y) for x in rows for y in rows if x[1] != y[1]]
    got = splits.same_block_rate(spark.createDataFrame(rows, "block string, fold int")).first().rate
    assert got == pytest.approx(sum(x[0] == y[0] for x, y in cross) / len(cross))


def test_sealed_split_is_refused_unless_unlocked(spark):
    df = spark.createDataFrame([(1, "train"), (2, "bench")], "id int, split string")
    with pytest.raises(tables.SealedSplitError):
        tables.scan_annotations(df, splits=("train", "bench"))
    assert tables.scan_annotations(df, splits=("bench",), unlock="1").count() == 1
    assert not any(tables.benchmark_access(x) for x in (None, "", "true", "01", " 1"))
    with pytest.raises(Exception, match="sealed row"):
        tables.assert_unsealed(df).collect()


def test_scan_pushes_filter_and_columns(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) as input", "'x' as output", "if(id % 2 = 0, 'train', 'bench') as split").write.parquet(str(tmp_path / "a"))
    plan = tables.read_annotations(spark, str(tmp_path / "a"), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "In(split" in plan and "ReadSchema: struct<id:bigint,split:string>" in plan


def test_class_maps_prune_tiles(spark, tmp_path, raster):
    px = raster({1: [[111, 112]], 2: [[211, 211]]}).withColumn("tile", F.concat(F.lit("T3"), "patch_id"))
    tables.write_class_maps(px, str(tmp_path / "m"))
    df = tables.read_class_maps(spark, str(tmp_path / "m"), ["T31"])
    assert df.count() == 2 and "(tile" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_integrity_of_files(spark, tmp_path):
    (tmp_path / "good.bin").write_bytes(b"abc")
    (tmp_path / "bad.bin").write_bytes(b"abd")
    (tmp_path / "long er.bin").write_bytes(b"abcd")
    (tmp_path / "more.bin").write_bytes(b"x")
    (tmp_path / "empty.bin").write_bytes(b"")
    plain = "900150983cd24fb0d6963f7d28e17f72"
    man = spark.createDataFrame([("good.bin", 3, plain.upper()), ("bad.bin", 3, plain), ("long er.bin", 3, plain), ("gone.bin", 1, "x")], "name string, size long, digest string")
    got = {r.name: r.status for r in files.verify_digests(files.file_digests(spark, str(tmp_path)), man).collect()}
    assert got == {"good.bin": "ok", "bad.bin": "digest_mismatch", "long er.bin": "size_mismatch", "gone.bin": "missing", "more.bin": "unlisted"}
    with pytest.raises(ValueError):
        files.file_digests(spark, str(tmp_path), "crc")


def test_trees_of_digests_equal_plain_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FAN", 3)
    rng, lines = random.Random(2), {}
    for name, n in (("one", 1), ("some", 9), ("many", 60)):
        lines[name] = ["".join(rng.choice("abé\n") for _ in range(rng.randint(0, 9))) for _ in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines[name]))

    def plain(data):
        nodes = [hashlib.sha256(data[i:i + 7]).hexdigest() for i in range(0, max(len(data), 1), 7)]
        n = len(nodes)
        while len(nodes) > 1:
            runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
            nodes = [r[0] if len(r) == 1 else hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
        return len(data), n, nodes[0]

    want = {name: plain((tmp_path / name).read_bytes()) for name in lines}
    assert {r.name: (r.size, r.n_ranges, r.digest) for r in files.file_digests(spark, str(tmp_path), "sha256", 7).collect()} == want
    rows = spark.createDataFrame([(n, i, x) for n, own in lines.items() for i, x in enumerate(own)], "name string, i int, line string")
    rows = rows.repartition(2, "name").sortWithinPartitions("name", "i")
    assert {r.name: (r.size, r.n_ranges, r.digest) for r in files.stream_digests(rows, "sha256", 7).collect()} == want


def test_redaction(spark):
    rows = [("ghp_abcdefghijklmnop1234", "***REDACTED***"), ("/srv/app/a b.txt", "a b.txt"), ("/etc/x", "<external-path>"),
            ("see configs/m.yaml and /etc/x", "see configs/m.yaml and <external-path>"), ("see C:\\Users\\me", "see <external-path>"), ("plain", "plain")]
    df = spark.createDataFrame(rows, "v string, want string")
    got = df.withColumn("got", F.when(text.looks_secret(F.col("v")), text.redact_value(F.col("v"))).otherwise(text.redact_paths(F.col("v"), "/srv/app")))
    assert [(r.v, r.got) for r in got.collect()] == rows
    m = spark.sql("select map('API_KEY', 'x', 'name', 'y') as m").select(text.redact_map(F.col("m")).alias("m")).first().m
    assert m == {"API_KEY": "***REDACTED***", "name": "y"}


def test_patch_ids(spark):
    df = spark.createDataFrame([("S2A_1_T33UUP_12_7",), ("nothing",)], "patch_id string")
    got = [tuple(r) for r in quality.parse_patch_ids(df).orderBy("patch_id").collect()]
    assert got == [("S2A_1_T33UUP_12_7", "T33UUP", 12, 7), ("nothing", None, None, None)]
    with pytest.raises(Exception, match="without a position"):
        quality.parse_patch_ids(df, strict=True).collect()


def test_bilinear_matches_direct_formula(spark):
    rng = random.Random(6)
    src = [[rng.random() for _ in range(4)] for _ in range(3)]
    df = spark.createDataFrame([("s", "B05", r, c, src[r][c]) for r in range(3) for c in range(4)], "scene string, band string, row int, col int, value double")
    size = spark.createDataFrame([("s", 3, 4)], "scene string, h int, w int")
    for H, W in ((6, 8), (7, 5), (3, 4)):
        out = spark.createDataFrame([("s", H, W)], "scene string, out_h int, out_w int")
        got = {(r.row, r.col): r.value for r in bands.resample(df, size, out).collect()}
        assert len(got) == H * W
        for i in range(H):
            for j in range(W):
                y, x = min(max((i + .5) * 3 / H - .5, 0), 2), min(max((j + .5) * 4 / W - .5, 0), 3)
                y0, x0 = int(y), int(x)
                y1, x1, dy, dx = min(y0 + 1, 2), min(x0 + 1, 3), y - int(y), x - int(x)
                want = (src[y0][x0] * (1 - dx) + src[y0][x1] * dx) * (1 - dy) + (src[y1][x0] * (1 - dx) + src[y1][x1] * dx) * dy
                assert got[(i, j)] == pytest.approx(want)


def test_band_refusals(spark):
    df = spark.createDataFrame([("s", "B99", 0, 0, 1.0)], "scene string, band string, row int, col int, value double")
    with pytest.raises(Exception, match="unknown band"):
        bands.band_presence(df).collect()
    with pytest.raises(ValueError):
        bands.spectral_index(df, "evi")
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([(float("inf"),)], "v double").select(bands.linear_to_db(F.col("v"))).collect()
    stats = spark.createDataFrame([("B99", 0.0, 0.0, False)], "band string, mean double, std double, missing boolean")
    with pytest.raises(Exception, match="std must be positive"):
        bands.zscore(df, stats).collect()
