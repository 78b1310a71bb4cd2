"""Cases for what must be refused, kept whole, or equal brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundtally.functions import dims
from groundtally.functions import questions as Q
from groundtally.operators import bands, classify, splits
from groundtally.sources import tables


def grid(spark, spec):
    rows = [(s, b, r, c, 1.0) for s, b, h, w in spec for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "scene int, band string, row int, col int, value double")


def test_stack_zero_fills_absent_bands_and_refuses_partial_ones(spark):
    whole = bands.stack_channels(grid(spark, [(1, "VV", 3, 2), (1, "B02", 3, 2), (2, "B08", 1, 1)])).collect()
    assert len(whole) == 7 and all(sum(r.channels) == (2 if r.scene == 1 else 1) for r in whole)
    with pytest.raises(Exception, match="band B02 does not cover the grid of scene 1"):
        bands.stack_channels(grid(spark, [(1, "VV", 3, 2), (1, "B02", 2, 2)])).collect()
    with pytest.raises(Exception, match="does not cover"):
        target = spark.createDataFrame([(1, 4, 4)], "scene int, out_h int, out_w int")
        bands.stack_channels(grid(spark, [(1, "VV", 3, 2)]), target).collect()


def test_packing_of_many_blocks_is_linear(spark):
    sizes = spark.range(200_000).selectExpr("concat('b', id) AS block", "1 + id % 7 AS n")
    got = splits.pack_folds(sizes, 5).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in got) == list(range(5)) and sum(r["count"] for r in got) == 200_000


def test_manifest_table_round_trip_and_malformed_table(spark, tmp_path):
    folds = spark.createDataFrame([("p1", "b", 0), ("p2", "c", 1)], "patch_id string, block string, fold int")
    tables.write_manifest(folds, str(tmp_path / "m"))
    assert sorted(map(tuple, tables.read_manifest(spark, str(tmp_path / "m")).collect())) == [("p1", "b", 0), ("p2", "c", 1)]
    folds.drop("fold").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="malformed"):
        tables.read_manifest(spark, str(tmp_path / "bad"))
    folds.selectExpr("patch_id", "block", "cast(null as int) AS fold").write.parquet(str(tmp_path / "null"))
    with pytest.raises(Exception, match="malformed"):
        tables.read_manifest(spark, str(tmp_path / "null")).collect()


def test_classifier_learns_saves_and_refuses_one_label(spark, tmp_path):
    rows = [(f"Is there any forêt number {i}?", "presence") for i in range(20)] + [(f"How many lakes like {i}?", "count") for i in range(20)]
    train = spark.createDataFrame(rows, "text string, label string")
    model = classify.fit(train, "text", "label", iterations=20)
    test = spark.createDataFrame([("any foret there?",), ("how many?",)], "text string")
    want = {"any foret there?": "presence", "how many?": "count"}
    assert {r.text: r.predicted for r in model.predict(test, "text").collect()} == want
    model.save(spark, str(tmp_path / "model"))
    again = classify.TextClassifier.load(spark, str(tmp_path / "model"))
    assert {r.text: r.predicted for r in again.predict(test, "text").collect()} == want and again.train_hash == model.train_hash
    with pytest.raises(ValueError, match="two labels"):
        classify.fit(train.filter("label = 'count'"), "text", "label")


def longest_first(text, forms):
    """Mentions by masking: the longest form first, each form where it stands free, in order of place."""
    low, taken, found = text.lower(), [False] * len(text), []
    for form, name in sorted(forms, key=lambda f: (-len(f[0]), f[0])):
        at = low.find(form)
        while at >= 0:
            end = at + len(form)
            free = (at == 0 or not low[at - 1].isalnum()) and (end == len(low) or not low[end].isalnum())
            if free and not any(taken[at:end]):
                taken[at:end] = [True] * (end - at)
                found.append((at, name))
            at = low.find(form, at + 1)
    return list(dict.fromkeys(n for _, n in sorted(found)))


def test_class_mentions_equal_masking(spark):
    rng = random.Random(11)
    forms = [(f, c) for f, c, *_ in dims.surface_forms()]
    plain = [(f, c) for f, c in forms if "," not in f]
    texts = [" ".join(rng.choice([rng.choice(plain)[0], "and", "near", "the", "covered by"]) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, input string")
    got = {r.id: list(r.m) for r in frame.select("id", Q.mentions(frame.input).alias("m")).collect()}
    assert all(list(dict.fromkeys(got[i])) == longest_first(t, plain) for i, t in enumerate(texts))


def test_sample_hash_doesnt_depend_on_order_or_partitions(spark):
    ids = spark.range(500).selectExpr("'g' AS g", "concat('p', id) AS v")
    one = tables.sample_hash(ids, "g", "v").collect()
    assert one == tables.sample_hash(ids.orderBy("v").repartition(7), "g", "v").collect() and one[0].n_samples == 500
    assert one != tables.sample_hash(ids.filter("v <> 'p3'"), "g", "v").collect()


def dense_fit(x, y, cost=1.0):
    """Squared hinge by Newton steps on a dense matrix, bias as a last column."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        short = np.maximum(0, 1 - y * (x @ w))
        on = x[short > 0]
        grad = w - 2 * cost * (x.T @ (y * short))
        if np.linalg.norm(grad) < 1e-10:
            break
        step = np.linalg.solve(np.eye(len(w)) + 2 * cost * on.T @ on, grad)
        loss = lambda v: 0.5 * v @ v + cost * (np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
        t = 1.0
        while loss(w - t * step) > loss(w) - 1e-4 * t * grad @ step and t > 1e-10:
            t /= 2
        w = w - t * step
    return w


def test_labels_fitted_together_equal_one_against_rest(spark):
    rng = random.Random(3)
    words = ["lake", "urban", "forêt", "near", "many", "cover", "the", "is"]
    rows = []
    for task, labels in (("a", "xyz"), ("b", "pq"), ("c", "only")):
        for _ in range(150):
            text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
            rows.append((task, text, labels if task == "c" else rng.choice(labels) if rng.random() < 0.4 else labels["lake" in text]))
    rows += [("a", None, "x"), ("b", "lake", None)]
    train = spark.createDataFrame(rows, "task string, text string, label string").repartition(3)
    model = classify.fit(train, "text", "label", "task", sublinear=False)
    assert model.tasks == ["a", "b", "c"] and sorted(model.weights) == [0, 1]
    for t, name in enumerate("ab"):
        place = {r.term: (r.place, r.idf) for r in model.vocabulary.filter(F.col("task") == t).collect()}
        own = [(text, label) for task, text, label in rows if task == name and text is not None and label is not None]
        x = np.zeros((len(own), len(place)))
        for k, (text, _) in enumerate(own):
            toks = text.replace("ê", "e").split()
            for term in toks + [" ".join(p) for p in zip(toks, toks[1:])]:
                if term in place:
                    x[k, place[term][0]] += place[term][1]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        for k, label in enumerate(model.labels[t]):
            want = dense_fit(x, np.array([1.0 if y == label else -1.0 for _, y in own]))
            assert np.abs(model.weights[t][:, k] - want).max() < 1e-4
    got = {r.text: r.predicted for r in model.predict(spark.createDataFrame([("b", "lake"), ("c", "x"), ("z", "y")], "task string, text string"), "text", "task").collect()}
    assert got == {"lake": "q", "x": None, "y": None}
