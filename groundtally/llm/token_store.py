"""Token ids in binary shards, compressed by a grammar of repeated pairs (Re-Pair).

A shard is one row of a Parquet table: ids of a run of documents in id order, in which frequent
pairs are replaced by nonterminals round by round. A round replaces many pairs at once: the most
frequent ones first, as long as no symbol is the left half of one and the right half of another, so
that chosen occurrences never overlap. Rules keep their expansion lengths, so any range of a shard
is decoded without expanding the rest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundtally.llm.tokens import encoder, vocabulary_path
from groundtally.session import ensure_checkpoint_dir

SHARD_TOKENS = 1 << 20
MAX_SYMBOL = 1 << 16
#: Pairs replaced in a round at most; others wait for the next one.
ROUND_PAIRS = 4096

SHARD_SCHEMA = ("part int, shard int, n_tokens long, first_rule int, rules binary, rule_lengths binary, symbols binary, "
                "doc_ids array<long>, doc_tokens binary, doc_symbols binary")


def _choose(codes: np.ndarray, counts: np.ndarray, most: int, bits: int) -> np.ndarray:
    """Pairs to replace, most frequent first, no symbol on both sides; sorted codes."""
    role: dict[int, int] = {}
    chosen = []
    for code in codes[np.lexsort((codes, -counts))].tolist():
        left, right = code >> bits, code & ((1 << bits) - 1)
        if left == right:
            if left in role:
                continue
            role[left] = 3
        else:
            if role.get(left, 1) != 1 or role.get(right, 2) != 2:
                continue
            role[left], role[right] = 1, 2
        chosen.append(code)
        if len(chosen) == most:
            break
    return np.array(sorted(chosen), codes.dtype)


def compress(ids: np.ndarray, ends: np.ndarray, least_count: int = 64):
    """(first_rule, rules, rule lengths, symbols, ends of documents among the symbols).

    ``ends`` marks the last id of every document; no pair reaches over it. Goes on until no pair is met
    ``least_count`` times or no symbol is free: symbols have 16 bits where the ids leave room in them, otherwise 32.
    """
    first = int(ids.max()) + 1 if ids.size else 0
    bits, kind = (16, np.uint32) if first < MAX_SYMBOL else (32, np.uint64)
    rules, lengths = np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    symbols = ids.astype(np.uint32)
    while True:
        free = (1 << bits) - first - len(rules)
        if free <= 0 or symbols.size < 2:
            break
        codes = (symbols[:-1].astype(kind) << kind(bits)) | symbols[1:]
        inside = np.sort(codes[~ends[:-1]])
        if not inside.size:
            break
        starts = np.flatnonzero(np.concatenate(([True], inside[1:] != inside[:-1])))
        counts = np.diff(np.append(starts, inside.size))
        often = counts >= least_count
        chosen = _choose(inside[starts][often], counts[often], min(free, ROUND_PAIRS), bits)
        if not chosen.size:
            break
        # a table by left and right symbol, each numbered among the chosen ones, 0 for all others
        pairs = np.stack([chosen >> kind(bits), chosen & kind((1 << bits) - 1)], axis=1).astype(np.uint32)
        lefts, left_no = np.unique(pairs[:, 0], return_inverse=True)
        rights, right_no = np.unique(pairs[:, 1], return_inverse=True)
        number = np.zeros((2, first + len(rules)), np.uint32)
        number[0, lefts], number[1, rights] = np.arange(1, lefts.size + 1), np.arange(1, rights.size + 1)
        pair_no = np.zeros((lefts.size + 1, rights.size + 1), np.int16)
        pair_no[left_no + 1, right_no + 1] = np.arange(1, chosen.size + 1)
        rank = pair_no.ravel()[number[0][symbols[:-1]] * np.uint32(rights.size + 1) + number[1][symbols[1:]]]
        at = np.flatnonzero((rank > 0) & ~ends[:-1])
        rank = rank[at].astype(np.int64) - 1
        run = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))  # runs of one pair aa: every other place
        even = (np.arange(at.size) - np.repeat(run, np.diff(np.append(run, at.size)))) % 2 == 0
        at, rank = at[even], rank[even]
        size_of = np.concatenate([np.ones(first, np.uint32), lengths])
        lengths = np.concatenate([lengths, size_of[pairs[:, 0]] + size_of[pairs[:, 1]]])
        symbols[at] = first + len(rules) + rank
        rules = np.concatenate([rules, pairs])
        ends[at] = ends[at + 1]
        stay = np.ones(symbols.size, bool)
        stay[at + 1] = False
        symbols, ends = symbols[stay], ends[stay]
    return first, rules, lengths, symbols, ends


def _expansions(first: int, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, length) of each symbol's ids in one flat array, and the array."""
    size_of = np.concatenate([np.ones(first, np.int64), lengths.astype(np.int64)])
    offset = np.cumsum(size_of) - size_of
    flat = np.empty(int(size_of.sum()), np.uint32)
    flat[:first] = np.arange(first)
    at, size = offset.tolist(), size_of.tolist()
    for symbol, (left, right) in enumerate(rules.tolist(), first):
        start, middle = at[symbol], at[symbol] + size[left]
        flat[start:middle] = flat[at[left]:at[left] + size[left]]
        flat[middle:middle + size[right]] = flat[at[right]:at[right] + size[right]]
    return offset, size_of, flat


def expand(first: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """All ids that ``symbols`` stand for."""
    offset, size_of, flat = _expansions(first, rules, lengths)
    sizes = size_of[symbols]
    begins = np.cumsum(sizes) - sizes
    return flat[np.repeat(offset[symbols] - begins, sizes) + np.arange(int(sizes.sum()))]


def expand_range(first: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard; only symbols that reach into the range are expanded."""
    size_of = np.concatenate([np.ones(first, np.int64), lengths])
    ends = np.cumsum(size_of[symbols])
    a, b = np.searchsorted(ends, [start, stop - 1], side="right")
    begin = ends[a - 1] if a else 0
    return expand(first, rules, lengths, symbols[a:b + 1])[start - begin:stop - begin]


def _shards(path: str, end_id: int, shard_tokens: int):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SHARD_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end, part = encoder(path).encode, end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        names: list = []
        pieces: list[bytes] = []
        held, shard = 0, 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(pieces), "<u4")
            tokens = np.array([len(p) // 4 for p in pieces], np.int64)
            ends = np.zeros(ids.size, bool)
            ends[np.cumsum(tokens) - 1] = True
            first, rules, lengths, symbols, ends = compress(ids, ends)
            last = np.flatnonzero(ends)
            row = {"part": part, "shard": shard, "n_tokens": int(ids.size), "first_rule": first, "rules": rules.astype("<u2" if rules.size and rules.max() < MAX_SYMBOL else "<u4").tobytes(),
                   "rule_lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u2" if symbols.max() < MAX_SYMBOL else "<u4").tobytes(),
                   "doc_ids": names, "doc_tokens": tokens.astype("<u4").tobytes(), "doc_symbols": np.diff(last, prepend=-1).astype("<u4").tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                pieces.append(encode(text.as_py()) + end)
                held += len(pieces[-1]) // 4
                if held >= shard_tokens:
                    yield close()
                    names, pieces, held, shard = [], [], 0, shard + 1
        if pieces:
            yield close()

    return run


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text, end it with ``end_id``, and write compressed shards in ascending id order to ``path``.

    Null texts are empty and hold the end id alone; null ids come first; rows that repeat an id
    follow each other by the first 64 characters of their texts, in as many ranges as they fill. A shard closes after the document that fills it, so
    a very long text makes a long shard but is never cut. An empty table makes an empty store.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    keys = ["id", "head", "salt"]
    keyed = rows.withColumn("head", F.substring("text", 1, 64)).withColumn("salt", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions("id", "head", "text", "salt")
    ordered.select("id", "text").mapInArrow(_shards(vocabulary or vocabulary_path(), end_id, shard_tokens), SHARD_SCHEMA).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a store, with ``base``: how many ids all shards before hold."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    by_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part of the writing job
    bases = by_part.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = (shards.select("part", "shard", "n_tokens").join(bases, "part")
              .select("part", "shard", (F.col("part_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("base")))
    return shards.join(places, ["part", "shard"])


def _shard_arrays(row: dict):
    wide = "<u2" if len(row["symbols"]) == 2 * int(np.frombuffer(row["doc_symbols"], "<u4").sum()) else "<u4"
    wide_rules = "<u2" if len(row["rules"]) == len(row["rule_lengths"]) else "<u4"  # two halves a rule, four bytes a length
    return (row["first_rule"], np.frombuffer(row["rules"], wide_rules).reshape(-1, 2).astype(np.uint32), np.frombuffer(row["rule_lengths"], "<u4"), np.frombuffer(row["symbols"], wide).astype(np.uint32))


def decode_store(shards: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids): the documents of a store, decoded from its shards."""
    schema = "id long, start long, n_tokens long, ids_crc32 long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = expand(*_shard_arrays(row)).astype("<u4").tobytes()
                tokens = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
                cuts = [0, *(4 * np.cumsum(tokens)).tolist()]
                own = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
                starts = (np.cumsum(tokens) - tokens + row["base"]).tolist()
                yield pa.RecordBatch.from_pydict({"id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(starts, pa.int64()),
                                                  "n_tokens": pa.array(tokens.tolist(), pa.int64()),
                                                  "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()), "ids": pa.array(own, pa.binary())})

    return shards.mapInArrow(run, schema)


def store_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write a store into the shared folder and decode it from the files."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_store(docs, path, id_col, text_col, vocabulary)
    return decode_store(read_store(spark, path))
