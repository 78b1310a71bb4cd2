from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundtally.llm import chunk_reuse as c
from groundtally.llm.queries import id_digests
from groundtally.llm.tokens import vocabulary_path
from tests.llm.conftest import messy_texts

PATH = vocabulary_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(8)
    parts = ["The", "don't", "I'LL", "\xc0\xc9", "e\u0301", "\u0301x", "\u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03c2", "\u6570\u636e\u5904\u7406", "\u6570" * 90, "12345", "<|endoftext|>",
             "a<|startoftext|>b", "\U0001f600", "\u200b", "\u01c5", "\u0130stanbul", "\ufb01", "'", "''s", "\u2026", "x\x1cy", "\x1f", "<\u0338", "\u1100\u1161", "\u3131\u314f", "\uac00"]
    blanks = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x85", "\xa0", "\u2003", "\u3000", "\u2028", ""]
    return ["".join(rng.choice(parts) + rng.choice(blanks) for _ in range(rng.randint(0, 150))) for _ in range(300)]


def test_words_encode_as_whole_texts_do(library):
    own = c.WordCoder(PATH)
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert c._id_lists([own.encode(text)], own.kind).to_pylist() == [want], text


def test_pieces_cut_anywhere_join_exactly(library):
    own, rng = c.WordCoder(PATH), random.Random(9)
    for text in odd_texts():
        places = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 30)))
        joiner = c.Joiner(own)
        for a, b in zip([0, *places], [*places, len(text)]):
            joiner.add(*c.encode_piece(text[a:b], own))
        assert c._id_lists([joiner.finish()], own.kind).to_pylist() == [library.encode(text, add_special_tokens=False).ids], text


def test_cuts_follow_content():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(600))
    one, two = c.cut(" ".join(word() for _ in range(50)) + passage), c.cut(passage + "tail")
    assert "".join(one).endswith(passage) and "".join(two) == passage + "tail"
    assert len(set(one) & set(two)) >= len(two) - 4 and len(two) > 5
    assert c.cut("") == [] and "".join(c.cut("a" * 100_000)) == "a" * 100_000


def expected(library, texts):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        yield i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_query_rows_equal_library(make_docs, library):
    rng = random.Random(6)
    base = [t for _, t in messy_texts() if t and 300 < len(t) < 5000] + [t for t in odd_texts() if len(t) > 200][:40]
    texts = [*messy_texts(), *enumerate(odd_texts(), 1000)]
    for i in range(2000, 2150):  # documents that share passages, cut anywhere
        texts.append((i, "".join(t[rng.randint(0, 40):][:rng.randint(100, 3000)] for t in rng.sample(base, rng.randint(1, 4)))))
    texts += [(3000, texts[-1][1])] * 60 + [(None, texts[-2][1])] * 5
    got = Counter(tuple(r) for r in id_digests(c.decode_ids(c.encode_texts(make_docs(texts), PATH), PATH)).collect())
    assert got == Counter(expected(library, texts))
    assert got == Counter(tuple(r) for r in id_digests(c.encode_texts(make_docs(texts), PATH, decode=True)).collect())


def test_full_slot_table_changes_nothing(make_docs, library, monkeypatch):
    monkeypatch.setattr(c.Shared, "__contains__", lambda self, digest: True)
    texts = messy_texts()[:20]
    got = {r.id: r.ids for r in c.encode_texts(make_docs(texts), PATH).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts}


def test_empty_table_and_unknown_ids(spark, make_docs, library):
    assert c.encode_texts(make_docs([]), PATH).count() == 0
    rows = spark.createDataFrame([(1, [518, 99_999, 520], "x"), (2, None, "x"), (3, [], "x"), (4, [49407, 1], "x")], "id int, ids array<int>, decoded string")
    got = {r.id: r.decoded for r in c.decode_ids(rows, PATH).collect()}
    assert got == {1: library.decode([518, 520]), 2: "", 3: "", 4: library.decode([49407, 1], skip_special_tokens=False)}
    assert c.decode_ids(rows.filter(F.lit(False)), PATH).count() == 0
