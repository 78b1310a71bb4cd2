from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from groundtally.llm import bpe_transducer as bt
from groundtally.llm import packing, token_store
from groundtally.llm.tokens import TokenEncoder, vocabulary_path
from tests.llm.conftest import messy_texts

PIECES = ["a", "aa", "b", " ", "  ", "\n", "\t", "é", "ß", "😀", "日本", "'s", "'ll", "12", "_", "==", " the", "ing", "zzz", "0", "<|endoftext|>", " ", "\r\n", "don't", "x" * 30]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def test_encoder_equals_library(library):
    encode = TokenEncoder(vocabulary_path(), remembered=50).encode
    for text in [*random_texts(3000, 1), *[t or "" for _, t in messy_texts()]]:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert encode(None) == b""


@pytest.mark.parametrize("seed", range(6))
def test_grammar_expands_to_what_was_compressed(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 6 if seed % 2 else 300, 4000).astype(np.uint32)
    ids[500:900] = 3  # a long run of one pair
    ends = rng.random(4000) < 0.01
    ends[-1] = True
    first, rules, lengths, symbols, after = token_store.compress(ids, ends.copy(), least_count=3)
    assert (token_store.expand(first, rules, lengths, symbols) == ids).all() and symbols.size < ids.size
    assert after.sum() == ends.sum()
    assert [token_store.expand(first, rules, lengths, np.array([first + i])).size for i in range(len(rules))] == lengths.tolist()
    inside = ~after[:-1]
    assert np.unique((symbols[:-1].astype(np.int64) << 32 | symbols[1:])[inside], return_counts=True)[1].max(initial=0) < 6  # runs aaa count twice
    wide = token_store.compress(ids + np.uint32(1 << 20), ends.copy(), least_count=3)
    assert (token_store.expand(*wide[:4]) == ids + (1 << 20)).all() and wide[3].size == symbols.size
    for a, b in ((0, 1), (17, 2500), (3999, 4000), (450, 950)):
        assert (token_store.expand_range(first, rules, lengths, symbols, a, b) == ids[a:b]).all()


def test_store_round_trip(messy, make_docs, library, spark, tmp_path):
    want, start = [], 0
    for i, t in sorted(messy_texts(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = str(tmp_path / "store")
    token_store.write_store(messy, path, shard_tokens=2000)
    got = token_store.decode_store(token_store.read_store(spark, path)).select("id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    assert token_store.store_round_trip(make_docs([])).count() == 0


def test_transducer_equals_tiktoken(monkeypatch):
    monkeypatch.setattr(bt, "MAX_STEPS", 300)
    monkeypatch.setattr(bt, "MAX_WORDS", 40)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = bt.TextCodec(path, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.machine.ranks, special_tokens={})
    for text in [*random_texts(4000, 2), *[t or "" for _, t in messy_texts() if len(t or "") < 5000], "b" * 3000, "abab" * 400]:
        ids = codec.encode(text)
        assert ids == other.encode_ordinary(text)
        data, chars = zip(*codec.decode_stream(ids, block=3))
        assert b"".join(data) == text.encode() and "".join(chars) == text


def test_utf8_reader_in_any_cuts():
    data = "aé日😀z".encode() + b"\xff\xc3"
    for size in range(1, 7):
        stream = bt.Utf8Stream()
        out = "".join(stream.feed(data[i:i + size]) for i in range(0, len(data), size)) + stream.close()
        assert out == "aé日😀z��"


def test_encode_and_decode_frames(messy, make_docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = bt.decode_ids(bt.encode_texts(messy, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert sorted(((r.id, r.text) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t in messy_texts()), key=repr)
    assert bt.code_digests(messy, path, public_tokenizers.PATTERN).count() == len(messy_texts())
    assert bt.code_digests(make_docs([]), path, public_tokenizers.PATTERN).count() == 0


def test_equal_pieces_are_dealt_evenly(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
                                    F.lit(300).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    packed = packing.pack_pieces(rows, capacity=2048, pieces_a_partition=300).collect()
    assert len(packed) == 3000 and 500 <= len({r.sequence_id for r in packed}) <= 510  # a partition rounds up once
    bins = {r.bins for r in packed}
    assert max(bins) < 2 * 50, bins  # a partition of a tenth of the pieces fills 50 sequences


def test_a_store_orders_lost_ids_in_several_ranges(spark, tmp_path):
    docs = spark.range(400).select(F.when(F.col("id") % 2 > 0, F.col("id")).alias("doc_id"), F.lit("same words here").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a table this small would end in one range
    try:
        token_store.write_store(docs.repartition(4), str(tmp_path / "s"), shard_tokens=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = token_store.decode_store(token_store.read_store(spark, str(tmp_path / "s"))).orderBy("start").collect()
    assert [r.id for r in rows] == [None] * 200 + list(range(1, 400, 2))
    parts = spark.read.parquet(str(tmp_path / "s")).select("part", F.explode("doc_ids").alias("id")).filter("id is null").select("part").distinct().count()
    assert parts > 1


@pytest.mark.parametrize("per", [4, 5, 1000])
def test_packing_places_every_piece_once(messy, library, per):
    pieces = packing.cut_pieces(messy, capacity=128)
    packed = packing.pack_pieces(pieces, capacity=128, pieces_a_partition=per).collect()
    by_seq, tokens = {}, 0
    for r in packed:
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.length == 128 or r.piece == 0
        assert r.bound <= r.bins
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in messy_texts())
    assert sum(r.length for r in packed) == sum(want)
    assert sorted((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in packed if r.id is not None) == sorted(tuple(r) for r in pieces.collect() if r.id is not None)


def fewest(lengths, capacity):
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best and k < len(lengths):
            return
        if k == len(lengths):
            best = min(best, len(rooms))
            return
        for i in range(len(rooms)):
            if rooms[i] >= lengths[k]:
                place(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1:]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_bounds_hold_and_can_be_tight():
    rng = random.Random(3)
    met = 0
    for _ in range(60):
        capacity = rng.choice([10, 12, 30])
        lengths = sorted((rng.randint(1, capacity - 1) for _ in range(7)), reverse=True)
        least, bound = fewest(lengths, capacity), packing.lower_bound(np.array(lengths), capacity)
        bins, offsets, room = packing.best_fit(lengths, capacity)
        assert bound <= least <= len(room)
        met += bound == len(room)
    assert met > 30
    assert packing.lower_bound(np.array([7, 7, 7]), 12) == 3  # more than the total needs


def test_packing_of_nothing(make_docs):
    assert packing.pack_pieces(packing.cut_pieces(make_docs([]))).count() == 0
