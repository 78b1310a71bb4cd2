"""Answers on synthetic maps, scores, intervals, tests and text overlap."""

from __future__ import annotations

import math
import random

import pytest

from groundtally.operators import answers, regions, scoring

COLS = "id int, patch_id int, input string, output string, type string, category string"


def answer(spark, raster, grid, *rows):
    px = raster({1: grid})
    f = regions.class_facts(regions.extract_regions(px), regions.raster_shapes(px))
    ann = spark.createDataFrame([(i, 1, *r) for i, r in enumerate(rows)], COLS)
    return {r.id: r for r in answers.answer_all(ann, f, regions.adjacency(px)).collect()}


def two_blocks():
    grid = [[211] * 20 for _ in range(20)]
    for r in range(3):
        for c in range(3):
            grid[r + 1][c + 1] = 112    # north-west
            grid[r + 15][c + 15] = 512  # south-east
    return grid


def test_answers_by_task(spark, raster):
    opts = "? a) top-left, b) bottom-right, c) left, d) below"
    got = answer(
        spark, raster, two_blocks(),
        ("Is there any urban fabric in the image?", "yes", "binary", "presence"),
        ("Is there any pastures in the image?", "no", "binary", "presence"),
        ("Does arable land cover at least 90% of the image?", "yes", "binary", "area"),
        ("Are there exactly two connected regions of urban fabric?", "no", "binary", "count"),
        ("Is urban fabric touching inland waters?", "no", "binary", "adjacency"),
        ("Where is the urban fabric located compared to the inland waters" + opts, "a", "mcq", "relative pos"),
        ("Relative to the urban fabric, where is the inland waters" + opts, "b", "mcq", "relative pos"),
        ("Which covers most? a) Pastures, b) Urban fabric, c) Arable land, d) Mixed forest", "c", "mcq", "presence"),
        ("How many regions of urban fabric? a) 4, b) 1, c) 7, d) 9", "b", "mcq", "count"),
        ("How much is arable land? a) 0 to 10%, b) 10 to 50%, c) 60 to 80%, d) 85 to 100%", "d", "mcq", "area"),
        ("Does urban fabric cover the image?", "no", "binary", "area"),
        ("Is pastures far? a) x, b) y", "a", "mcq", "presence"),
        ("In which season? a) Spring, b) Summer, c) Autumn, d) Winter", "a", "mcq", "season"))
    assert [got[i].answer for i in range(13)] == ["yes", "no", "yes", "no", "no", "a", "b", "c", "b", "d", None, None, None]
    assert got[10].reason == "area question with no threshold"
    assert got[11].reason == "expected 4 options, parsed 2"
    assert got[12].reason.startswith("metadata task")


def test_nearest_direction_ties_are_counted(spark, raster):
    px = raster({1: two_blocks()})
    f = answers.named_facts(regions.class_facts(regions.extract_regions(px), regions.raster_shapes(px)))
    ann = spark.createDataFrame([(0, 1, "Where is the urban fabric relative to the inland waters? a) top, b) left, c) right, d) below", "a", "mcq", "relative pos")], COLS)
    row = answers.mcq_relative(answers.parsed_questions(ann), f).first()
    assert (row.direction, row.answer, row.tied) == ("NW", "a", 2)


def test_strict_and_attempted(spark):
    rows = [("p", "t", False, True, ""), ("p", "t", False, False, ""), ("q", "t", True, False, "why"), ("q", "u", True, False, "why")]
    got = {r.task: r for r in scoring.score_tasks(spark.createDataFrame(rows, "patch_id string, task string, abstained boolean, correct boolean, reason string")).collect()}
    assert got["t"].strict_accuracy == pytest.approx(1 / 3) and got["t"].attempted_accuracy == 0.5
    assert got["u"].attempted_accuracy == 0.0


def test_clustered_interval_is_wider(spark):
    rng = random.Random(1)
    rows = []
    for p in range(20):
        ok = rng.random() < 0.6
        for i in range(10):
            rows.append((f"p{p}", "clustered", ok))
            rows.append((f"p{p}-{i}", "independent", ok))
    got = {r.task: r for r in scoring.bootstrap_ci(spark.createDataFrame(rows, "patch_id string, task string, correct boolean"), resamples=200).collect()}
    assert got["clustered"].ci_high - got["clustered"].ci_low > got["independent"].ci_high - got["independent"].ci_low


def test_mcnemar_equals_binomial_sum(spark):
    rows, want = [], {}
    for key, (b, c) in enumerate([(0, 0), (1, 0), (3, 9), (29, 16), (400, 460), (5000, 5200)]):
        rows += [(key, True, False)] * b + [(key, False, True)] * c + [(key, True, True)] * 3
        n, k = b + c, min(b, c)
        want[key] = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    got = scoring.mcnemar(spark.createDataFrame(rows, "k int, x_right boolean, y_right boolean"), "k").collect()
    for r in got:
        assert r.p_value == pytest.approx(want[r.k], rel=1e-8)


def test_lcs_and_bleu(spark):
    def lcs(a, b):
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
        return dp[-1][-1]
    rng = random.Random(3)
    pairs = [([rng.choice("abcde") for _ in range(rng.randrange(0, 40))], [rng.choice("abcde") for _ in range(rng.randrange(0, 40))]) for _ in range(50)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a array<string>, b array<string>")
    for r in df.select("id", scoring.lcs_length("a", "b").alias("n")).collect():
        assert r.n == lcs(*pairs[r.id])
    same = spark.createDataFrame([(1, "the lake is north of the city", "the lake is north of the city")], "id int, hyp string, ref string")
    assert scoring.corpus_bleu(same).first().bleu4 == pytest.approx(100.0)
    assert scoring.rouge_l(same).first().rouge_l == pytest.approx(100.0)


def test_spread_rank_is_a_permutation(spark):
    df = spark.createDataFrame([(t, i) for t in "ab" for i in range(300)], "t string, i int")
    got = scoring.spread_rank(df, ["t"], "i").collect()
    for t in "ab":
        assert sorted(r["rank"] for r in got if r.t == t) == list(range(300))
