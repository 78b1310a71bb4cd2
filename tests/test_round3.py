"""Order statistics, in-row counts, resampling and the raster store against brute force and crashes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundtally.operators import order, scoring
from groundtally.sources import fixture
from groundtally.streaming import intake


def test_gaps_and_quantiles_equal_sorting(spark):
    rng = random.Random(4)
    rows = [(g, round(rng.choice([rng.random(), float(rng.randint(0, 5))]), 3), rng.randint(1, 4)) for g, n in (("hot", 900), ("b", 7), ("one", 1)) for _ in range(n)]
    counts = Counter()
    for g, v, n in rows:
        counts[g, v] += n
    df = spark.createDataFrame([(g, v, n) for (g, v), n in counts.items()], "g string, v double, n int").repartition(3)
    values = defaultdict(list)
    for (g, v), n in sorted(counts.items()):
        values[g] += [v] * n
    got = {(r.g, r.v): r.previous for r in order.neighbour_gaps(df, "g", "v").collect()}
    for g, all_of in values.items():
        distinct = sorted(set(all_of))
        assert [got[g, v] for v in distinct] == [None, *distinct[:-1]]
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    found = {r.g: r for r in order.exact_quantiles(df, "g", "v", "n", probs).collect()}
    assert set(found) == set(values)
    for g, all_of in values.items():
        assert [found[g][k] for k in probs] == pytest.approx([float(np.quantile(all_of, p)) for p in probs.values()], abs=1e-12)
    assert order.exact_quantiles(df.filter(F.lit(False)), "g", "v", "n", probs).count() == 0


def test_common_count_equals_multisets(spark):
    rng = random.Random(5)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.withColumn("n", scoring.common_count(F.col("a"), F.col("b"))).collect():
        assert r.n == sum((Counter(r.a) & Counter(r.b)).values())


def test_bootstrap_equals_its_definition_and_shuffles_sums(spark):
    rng = random.Random(6)
    rows = [(p, t, rng.random() < 0.6) for p in range(40) for t in ("x", "y") for _ in range(rng.randint(1, 3))]
    df = spark.createDataFrame(rows, "patch_id int, task string, correct boolean")
    got = {r.task: r for r in scoring.bootstrap_ci(df, resamples=50).collect()}
    for t in ("x", "y"):
        acc = []
        for b in range(50):
            hits = total = 0
            for p, task, correct in rows:
                if task == t:
                    bits = hashlib.md5(f"1337:{b // 8}:{p}".encode()).hexdigest()
                    times = sum(int(bits[4 * (b % 8):4 * (b % 8) + 4], 16) >= x for x in scoring.POISSON_16)
                    hits, total = hits + times * correct, total + times
            if total:
                acc.append(hits / total)
        acc.sort()
        m = len(acc)
        assert (got[t].ci_low, got[t].ci_high) == (acc[int(0.025 * m)], acc[min(int(0.975 * m), m - 1)])
    mean = sum(int(hashlib.md5(str(k).encode()).hexdigest()[:4], 16) >= x for k in range(20_000) for x in scoring.POISSON_16) / 20_000
    assert mean == pytest.approx(1, abs=0.02)  # a resample is as large as the data


def test_views_are_dealt_to_many_partitions(spark):
    dealt = fixture.spread(spark.range(1000), "id")
    dealt.collect()
    assert dealt.withColumn("p", F.spark_partition_id()).select("p").distinct().count() == 4


def test_ingest_survives_a_crash_before_the_commit(spark, tmp_path, monkeypatch):
    arriving, out = tmp_path / "in", str(tmp_path / "store")
    key = F.concat(F.lit("S2A_"), F.col("id").cast("string"), F.lit("_T"), (10 + F.col("id") % 4).cast("string"), F.lit("ABC_1_"), F.col("id").cast("string"))
    make = lambda lo, hi: spark.range(lo, hi).select(key.alias("patch_id"), F.lit("x").alias("country"))
    make(0, 40).unionByName(make(0, 5)).unionByName(spark.createDataFrame([("no tile", "x")], "patch_id string, country string")).coalesce(1).write.parquet(str(arriving))
    read = lambda: intake.file_stream(spark, str(arriving), make(0, 1).schema, "*.parquet")
    stored = lambda: intake.stored_rasters(spark, out, make(0, 1).schema)

    real = intake.commit

    def crash(*args):
        raise RuntimeError("lost between write and commit")

    monkeypatch.setattr(intake, "commit", crash)
    with pytest.raises(Exception, match="lost between"):
        intake.raster_ingest(read(), out, str(tmp_path / "state"))
    assert stored().count() == 0  # written, but not part of the store
    monkeypatch.setattr(intake, "commit", real)
    intake.raster_ingest(read(), out, str(tmp_path / "state"))  # the same batch again
    assert (stored().count(), stored().select("patch_id").distinct().count()) == (40, 40)
    make(35, 50).coalesce(1).write.mode("append").parquet(str(arriving))
    intake.raster_ingest(read(), out, str(tmp_path / "state"))
    intake.raster_ingest(read(), out, str(tmp_path / "other"))  # all of it under another checkpoint
    assert (stored().count(), stored().select("patch_id").distinct().count()) == (50, 50)
    told = sorted((r.seen, r.written, r.stored, r.no_tile) for r in intake.ingest_progress(spark, out).collect())
    assert told == [(15, 10, 5, 0), (46, 40, 5, 1), (61, 0, 60, 1)]
    near = intake.store_index(spark, out).filter("tile = '10ABC' or tile = 'T10ABC'")
    plan = intake.stored_rasters(spark, out, make(0, 1).schema, near)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
