from __future__ import annotations

import random
from collections import defaultdict

import pytest

from groundtally.llm import jaccard_join as j
from tests.llm.conftest import messy_texts


def shingles(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute(texts):
    """(id, size, smallest id reachable) of every row, over all pairs of distinct sets."""
    sets = [shingles(t) for _, t in texts]
    distinct = [s for s in set(sets) if s]
    parent = {s: s for s in distinct}

    def find(x):
        while parent[x] is not x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(distinct)):
        for b in range(a):
            x, y = distinct[a], distinct[b]
            if 100 * len(x & y) >= 75 * len(x | y):
                parent[find(x)] = find(y)
    ids = defaultdict(list)
    for (i, _), s in zip(texts, sets):
        if s and i is not None:
            ids[find(s)].append(i)
    return [(i, len(s), (min(ids[find(s)]) if ids[find(s)] else None) if s else i) for (i, _), s in zip(texts, sets)]


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_messy_documents_equal_all_pairs(messy):
    assert key(j.jaccard_components(messy).collect()) == key(brute(messy_texts()))


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_passages_and_edges_of_the_threshold_equal_all_pairs(make_docs, seed, monkeypatch):
    if seed == 2:  # few frequent shingles, so that lists are long and mixed
        monkeypatch.setattr(j, "FREQUENT", 3)
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 40))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(12):
        text = [word() for _ in range(rng.randint(5, 60))] + (passage if rng.random() < 0.6 else [])
        for _ in range(rng.randint(1, 9)):  # drifts away from where it began, link by link
            texts.append((len(texts), " ".join(text)))
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = word()
            text += [word()] * rng.randint(0, 1)
    texts += [(1000 + i, " ".join(passage + [word() for _ in range(rng.randint(0, 14))])) for i in range(25)]
    assert key(j.jaccard_components(make_docs(texts)).collect()) == key(brute(texts))


def test_one_document_of_each_component_stays(messy, make_docs):
    left = j.one_of_each(messy)
    assert left.columns == messy.columns
    ids = [r.doc_id for r in left.collect()]
    firsts = {c for i, n, c in brute(messy_texts())}
    assert set(ids) == firsts
    assert j.jaccard_components(make_docs([])).count() == 0


def test_near_copies_without_an_id_or_with_the_same_one(make_docs):
    words = [f"w{i}" for i in range(100)]
    near = lambda k, mark: " ".join(words[:k] + [mark] + words[k + 1:])
    other = " ".join(f"v{i}" for i in range(60))
    copies = [(None, near(5, "x")), (None, near(50, "y")), (None, near(5, "x"))]
    blank = [(None, ""), (None, None), (None, "")]
    left = lambda rows: sorted(((r.doc_id, r.text) for r in j.one_of_each(make_docs(rows)).collect()), key=repr)
    alone = left([*copies, (None, other), *blank])
    assert len(alone) == 5 and (None, other) in alone and len({t for _, t in alone if t and t != other}) == 1
    assert left([*copies, (7, near(20, "z")), (7, other)]) == sorted([(7, near(20, "z")), (7, other)], key=repr)
    assert left([(3, near(5, "x")), (7, near(50, "y")), (7, other)]) == [(3, near(5, "x")), (7, other)]


def test_hashes_tell_sets_apart():
    make = j.Shingler(5)
    assert make(" A b\tc\n\nd  e ").tolist() == make("a b c d e").tolist()
    assert make("a b").size == 1 and make("a b").tolist() != make("b a").tolist() and make(" \n").size == 0
    text = " ".join(f"w{i % 900}" for i in range(3000))
    assert make(text).size == len(shingles(text))


def test_pairs_compared_grow_with_the_sets(make_docs, monkeypatch):
    """A passage makes up most of many texts that aren't linked."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(30)]
    texts = [(i, " ".join([word() for _ in range(3)] + passage + [word() for _ in range(3)])) for i in range(150)]
    compared = []
    plausible = j._plausible
    monkeypatch.setattr(j, "_plausible", lambda pairs, *a: compared.append(pairs.count()) or plausible(pairs, *a))
    assert key(j.jaccard_components(make_docs(texts)).collect()) == key(brute(texts))
    assert sum(compared) < 4 * len(texts), compared
