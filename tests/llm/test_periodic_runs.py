from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from groundtally.llm import periodic_runs as p
from groundtally.llm.queries import plant_period, run_digests
from tests.llm.conftest import messy_texts


def naive_runs(words):
    """All periods tried at all places; a stretch counts under its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - i
            if length >= max(24, 3 * q):
                found.setdefault((i, length), q)
            i = end + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def naive_row(i, text):
    words = plant_period(i, p.WORDS.findall(text or ""))
    runs = naive_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def periodic(rng):
    """Words with nested, neighbouring and broken periods."""
    out = []
    while len(out) < rng.randint(5, 400):
        unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 16, 17, 31, 40]))]
        if rng.random() < 0.3:
            unit = unit[:2] * rng.randint(2, 12) + unit
        out += (unit * rng.randint(1, 12))[:rng.randint(1, 200)]
        if rng.random() < 0.4:
            out += [rng.choice("abz")]
    return out


def test_runs_equal_all_periods_tried():
    rng = random.Random(11)
    texts = [periodic(rng) for _ in range(400)] + [["a"] * 3000, [], ["x"] * 24, ["x"] * 23, list("ab" * 11) + ["a"], list("ab" * 12), list("abcdefghi" * 3)[:26], list("abcdefghi" * 3)]
    for text, (runs, kept) in zip(texts, p._batch_runs(texts)):
        want = naive_runs(text)
        assert [(r["start"], r["length"], r["period"]) for r in runs] == want
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert kept == [w for k, w in enumerate(text) if k not in gone]


def test_wavelet_matrix_counts_and_selects():
    rng = np.random.default_rng(2)
    for m in (1, 2, 7, 64, 100):
        values = rng.permutation(m)
        matrix = p.WaveletMatrix(values)
        lo = rng.integers(0, m, 200)
        hi = rng.integers(lo + 1, m + 1)
        bound = rng.integers(0, m + 1, 200)
        assert matrix.below(lo, hi, bound).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(lo, hi, bound)]
        k = rng.integers(0, hi - lo)
        assert matrix.kth(lo, hi, k).tolist() == [int(np.sort(values[a:b])[x]) for a, b, x in zip(lo, hi, k)]


def test_query_rows_equal_definition(make_docs):
    rng = random.Random(4)
    texts = [(i, t) for i, t in messy_texts() if t is None or len(t) < 20_000]
    texts += [(i, " ".join(periodic(rng)) if rng.random() < 0.4 else " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 300)))) for i in range(1000, 1120)]
    got = Counter(tuple(r) for r in run_digests(p.periodic_runs(make_docs(texts), rewrite=plant_period)).collect())
    assert got == Counter(naive_row(i, t) for i, t in texts)
    assert any(r[1] for r in got) and p.periodic_runs(make_docs([])).count() == 0


def test_long_texts(make_docs):
    texts = [(1, "a b c " * 60_000), (2, " ".join(f"w{i}" for i in range(100_000))), (3, "x" * 500_000)]
    got = {r.id: r for r in p.periodic_runs(make_docs(texts)).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 180_000, 3)] and got[1].collapsed == "a b c"
    assert got[2].runs == [] and got[2].collapsed == texts[1][1] and got[3].n_words == 1
