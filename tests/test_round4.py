"""Cases of the fourth round: what the larger tables showed."""

from __future__ import annotations

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from groundtally.functions import questions
from groundtally.llm import cotraining, queries
from groundtally.operators import bands, classify, hinge, regions
from groundtally.plans import registry
from groundtally.session import ensure_checkpoint_dir

WORDS = ["ab", "cd", "ef", "gh", "ij"]


def weights_by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.execute(registry.oracle_sql()["E19_tfidf"]).fetchall())


def weights_by_spark(spark, rows):
    return sorted(tuple(r) for r in classify.term_weights(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text").collect())


def written_files(spark):
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    return sum(len(names) for _, _, names in os.walk(top))


def test_weights_move_packed_terms_and_write_none(spark, monkeypatch):
    # terms of every document were written one by one, seven times the input
    monkeypatch.setattr(classify, "CHUNK_WORDS", 7)
    rows = [(i, " ".join(WORDS[(i * k) % 5] for k in range(i % 9))) for i in range(40)] + [(90, None), (91, ""), (92, "a"), (93, "ab " * 30)]
    before = written_files(spark)
    got = weights_by_spark(spark, rows)
    assert written_files(spark) == before
    assert [g[:2] for g in got] == [w[:2] for w in weights_by_sql(rows)]
    assert all(g[2:] == pytest.approx(w[2:], abs=1.1e-6) for g, w in zip(got, weights_by_sql(rows)))


def test_weights_count_rows_as_the_sql_does_where_ids_repeat(spark):
    rows = [(1, "ab cd"), (1, "ab ef"), (2, "ab cd ef"), (None, "cd"), (None, "gh cd"), (3, "ef gh")]
    got = weights_by_spark(spark, rows)
    assert [g[:2] for g in got] == [w[:2] for w in weights_by_sql(rows)]
    assert all(g[2:] == pytest.approx(w[2:], abs=1.1e-6) for g, w in zip(got, weights_by_sql(rows)))


def test_newton_steps_end_soon_where_counts_are_large(spark, monkeypatch):
    # descent took 1,013 passes over 3,194 texts, and more with every copy of the table
    rng = random.Random(5)
    rows = []
    for _ in range(120):
        at = sorted(rng.sample(range(25), 6))
        value = [rng.random() for _ in at]
        rows.append((0, at, value, [int(at[0] > 2) if rng.random() < 0.97 else rng.randint(0, 1)], [float(rng.randint(1, 4000))]))
    df = spark.createDataFrame(rows, "task int, at array<int>, value array<double>, label array<int>, n array<double>").repartition(3)
    passes, mapped = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda *a, **k: passes.append(1) or mapped(*a, **k))
    monkeypatch.setattr(hinge, "PAIRS", 500)
    got = hinge.fit_outputs(df, {0: (25, 2)}, tolerance=1e-7)[0]
    assert len(passes) < 80
    dense, yes, n = np.zeros((120, 26)), np.zeros((120, 2)), np.array([r[4][0] for r in rows])[:, None]
    for i, (_, at, value, label, _) in enumerate(rows):
        dense[i, at], dense[i, 25], yes[i, label[0]] = value, 1, 1
    m = dense @ got
    grad = got + 2 * dense.T @ (n * ((1 - yes) * np.maximum(0, 1 + m) - yes * np.maximum(0, 1 - m)))
    assert np.linalg.norm(grad, axis=0).max() < 1e-3


def test_a_question_is_read_once_for_all_rows_that_ask_it(spark):
    # every row went through the patterns, however often its question came
    rows = [(i, q, "binary", "presence") for i, q in enumerate(["Is there any lava in the image?", "Hello there", None, ""] * 5)]
    df = spark.createDataFrame(rows, "id long, input string, type string, category string")
    for read in (questions.parse, questions.parse_for_task):
        found = read(df)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("Generate") and "Aggregate" in plan[plan.index("Generate"):]
        got = found.collect()
        assert sorted(r.id for r in got) == list(range(20))
        assert len({(r.input, r.reason) for r in got}) == 4


def test_bands_are_refused_without_dealing_pixels_by_scene(spark):
    # F8: pixels met their scene's verdict in one task a scene
    rows = [(s, b, r, c, 1.0) for s in (1, 2) for b in ("VV", "B02") for r in range(2) for c in range(2)]
    found = bands.checked_grids(spark.createDataFrame(rows, "scene int, band string, row int, col int, value double"))
    assert "SortMergeJoin [scene" not in found._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert found.count() == 16


def test_blocks_of_narrow_rasters_are_taller(spark, raster):
    # 512 rows of 40 pixels were a block, so that labels met at many edges
    assert regions.one_block((3_000, 40)) and not regions.one_block((30_000, 40)) and not regions.one_block((40, 3_000))
    rng = random.Random(8)
    runs = regions.class_runs(raster({p: ["".join(rng.choice("112") for _ in range(3)) for _ in range(41)] for p in (1, 2)}).withColumnRenamed("code", "cls"))
    for connectivity in (4, 8):
        labels = [sorted(tuple(r) for r in regions.components(runs, connectivity, block).select("patch_id", "cls", "label", "row", "c0", "c1").collect()) for block in (4, 512)]
        assert regions.block_height((41, 3), 4) == 5 and labels[0] == labels[1]


def sized(spark, h, w, out_h, out_w, scene=1):
    return spark.createDataFrame([(scene, h, w)], "scene int, h int, w int"), spark.createDataFrame([(scene, out_h, out_w)], "scene int, out_h int, out_w int")


def test_places_in_tall_rasters_fit_whole_numbers(spark):
    # r04 F1: row times target rows was a product of 32 bits, too small from 65,536 rows of a target twice as high
    rows = [(1, "B05", r, c, float(10 * (r - 89_998) + c)) for r in (89_998, 89_999) for c in (0, 1)]
    df = spark.createDataFrame(rows, "scene int, band string, row int, col int, value double")
    got = {(r.row, r.col): r.value for r in bands.resample(df, *sized(spark, 90_000, 2, 180_000, 4)).collect()}
    part = [0.0, 0.25, 0.75, 1.0]
    assert got == {(r, c): 10 * y + x for r, y in ((179_997, 0.25), (179_998, 0.75), (179_999, 1.0)) for c, x in enumerate(part)}


def test_uneven_sizes_match_the_direct_formula(spark):
    rng = random.Random(7)
    for h, w, H, W in ((1, 1, 3, 2), (1, 5, 1, 9), (4, 3, 7, 5), (7, 9, 3, 2), (5, 2, 5, 2), (2, 6, 9, 1)):
        src = [[rng.random() for _ in range(w)] for _ in range(h)]
        df = spark.createDataFrame([(1, "B05", r, c, src[r][c]) for r in range(h) for c in range(w)], "scene int, band string, row int, col int, value double")
        got = {(r.row, r.col): r.value for r in bands.resample(df, *sized(spark, h, w, H, W)).collect()}
        y, x = (np.clip((np.arange(out) + .5) * n / out - .5, 0, n - 1) for n, out in ((h, H), (w, W)))
        y0, x0 = y.astype(int), x.astype(int)
        s, dy, dx = np.array(src), (y - y0)[:, None], (x - x0)[None, :]
        y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
        want = (s[np.ix_(y0, x0)] * (1 - dx) + s[np.ix_(y0, x1)] * dx) * (1 - dy) + (s[np.ix_(y1, x0)] * (1 - dx) + s[np.ix_(y1, x1)] * dx) * dy
        assert sorted(got) == [(i, j) for i in range(H) for j in range(W)]
        assert all(got[(i, j)] == pytest.approx(want[i, j]) for i in range(H) for j in range(W))


def test_low_bands_are_checked_on_their_own_grid_and_resampled_once(spark):
    # r04 F1: the check counted resampled pixels, so that bands were resampled twice; a pixel met twice was added up
    def whole(low):
        rows = [(1, "B02", r, c, 1.0) for r in range(4) for c in range(4)] + [(1, "B05", r, c, 2.0) for r, c in low]
        df = spark.createDataFrame(rows, "scene int, band string, row int, col int, value double")
        return bands.preprocess(df, *sized(spark, 2, 2, 4, 4))[0]

    grid = [(0, 0), (0, 1), (1, 0), (1, 1)]
    tensor = whole(grid)
    assert all(r.channels[bands.CHANNELS.index("B05")] == 2 and sum(r.channels) == 3 for r in tensor.collect())
    assert tensor._jdf.queryExecution().optimizedPlan().toString().count("bit_or(") == 1
    for low in (grid[:3], grid + [(1, 1)], grid + [(2, 0)]):
        with pytest.raises(Exception, match="band B05 does not cover the grid of scene 1"):
            whole(low).collect()


def test_cotraining_reads_texts_once_and_moves_none(spark, tmp_path, monkeypatch):
    # r04 check, op10: texts were joined to the labels, by a shuffle where labels are many, and measured again for the scores
    good = F.col("id") % 2 == 1
    spark.range(400).select(F.col("id").alias("doc_id"), F.when(good, "clear sound prose here").otherwise("BUY CHEAP !!! $$$ 99").alias("text"), F.lit("en").alias("lang"),
                            F.when(good, "books").otherwise("spam").alias("source"), F.lit(20).alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    made, plans, measured, write = [], [], cotraining._measured, cotraining.written
    monkeypatch.setattr(cotraining, "_measured", lambda *a: made.append(1) or measured(*a))
    monkeypatch.setattr(cotraining, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    got = queries.op10_cotraining(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(i, i % 2 == 1) for i in range(400)]
    joined = [p for p in plans if "Join" in p]
    assert len(made) == 1 and joined and not any("text#" in p for p in joined)
