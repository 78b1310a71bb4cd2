from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from groundtally.llm import merkle_manifest as m
from groundtally.llm.queries import tampered_leaf
from tests.llm.conftest import SCHEMA, rows_of

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][k:k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, k):
    out = []
    for nodes in tree[:-1]:
        first = k // 16 * 16
        out.append((nodes[first:k], nodes[k + 1:first + 16]))
        k //= 16
    return out


def naive(rows):
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        t = text
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and text is not None:
            t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups[source].append((i is not None, i or 0, leaf_of((i, source, lang, n, text)), leaf_of((i, source, lang, n, t))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([r[2] for r in sorted(groups[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names]) if names else []
    out = Counter()
    for g, s in enumerate(names):
        for k, (known, i, leaf, claimed) in enumerate(sorted(groups[s])):
            path = siblings(trees[s], k) + siblings(top, g)
            node = claimed
            for before, after in path:
                node = digest("".join([*before, node, *after]))
            root = top[-1][0]
            out[i if known else None, leaf, trees[s][-1][0], root, digest("".join("".join(b + a) for b, a in path)), node, node == root] += 1
    return out


def found(docs):
    made = m.proofs(m.build_manifest(docs, COLUMNS, claimed=tampered_leaf(docs)))
    return Counter(tuple(r) for r in made.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_addresses_fill_the_block_once():
    for leaves in (1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096):
        for count in {m.levels_of(leaves), 4}:
            sizes = m.level_sizes(leaves, count)
            if sizes[-1] == 1:
                places = np.concatenate([m.address(leaves, count, k, np.arange(s)) for k, s in enumerate(sizes)])
                assert sorted(places) == list(range(sum(sizes)))
                assert m.address(leaves, count, count - 1, np.zeros(1, int))[0] == 0


def test_upper_half_comes_first():
    low = m.address(4096, 4, 1, np.arange(256))
    assert low.min() == 17 and (np.diff(low) == 17).all()  # behind root and its 16 children, one subtree of 17 after the other


def test_manifest_equals_plain_trees(spark):
    rng = random.Random(3)
    rows = []
    for source, n in (("a", 1), ("b", 16), ("c", 17), ("é", 300), (None, 33), ("", 2), ("hot", 9000)):
        rows += [(i, rng.choice(["Some Text", "lower", "", None, "Ünï ÀB"]) , rng.choice(["en", None]), source, rng.choice([1, None]))
                 for i in rng.sample(range(100_000), n)]
    rows += [(None, "A", "en", "hot", 1)] * 40 + [(7, "A", "en", "hot", 1), (7, "B", "en", "hot", 1), (7, "B", "en", "hot", 1), (8, "Long " * 60_000, "en", "b", 1)]
    docs = spark.createDataFrame([(*r, *rows_of([(0, "")])[0][5:]) for r in rows], SCHEMA)
    assert found(docs.repartition(5)) == naive(rows)


def test_roots_without_proofs_and_many_groups(spark):
    rows = [(i, f"T{i}", "en", "s" if i < 700 else f"g{i}", 1) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    leaves = docs.select(F.lit("").alias("grp"), "doc_id", m.leaf_digest(F.col("text")).alias("digest"))
    stores = m.build_stores(m.ranked(leaves, "doc_id").select("grp", "rank", "n", "digest"))
    want = levels([leaf_of((r[1],)) for r in rows])[-1][0]
    assert m.group_roots(stores).first().root.hex() == want
    assert found(docs) == naive(rows)


def test_empty_table_and_saved_blocks(spark, make_docs, tmp_path):
    assert found(make_docs([])) == Counter()
    made = m.build_manifest(make_docs([(1, "x"), (2, None)]), COLUMNS)
    made.save(str(tmp_path / "manifest"))
    block = spark.read.parquet(str(tmp_path / "manifest/groups-0")).first()
    assert (block.leaves, block.levels, len(block.nodes)) == (2, 2, 96)
    assert m.build_manifest(make_docs([]), COLUMNS).root().count() == 0
