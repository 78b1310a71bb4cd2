"""BPE encoding that reuses content-defined chunks: what documents share is encoded once.

A rolling hash over 32 characters cuts texts where their content says so, so a passage is cut alike wherever it
stands. Chunks met more than once move, each text once, to be encoded; all other text is encoded where it lies. Chunks end
anywhere, inside words too, so joins are repaired: from a join outwards the text is encoded again up to the
places where the old encodings and the new one agree for certain.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtally.llm.common import written

#: Characters the rolling hash sees, least length of a chunk, and the part of all places that are cuts (1 in 2^9). A shared chunk costs its digest and
#: its row twice in a shuffle, and its document moves; shorter chunks would save less encoding than that.
WINDOW, LEAST_CHUNK, CUT_BITS = 32, 128, 9
#: Slots of the table that tells chunks met once from others, one bit each: 8 MB whatever the corpus. A fuller table moves more chunks and changes no result.
SLOTS, SLOTS_A_ROW = 1 << 26, 1 << 15
#: Words and digests of chunks that a worker remembers, in each generation.
WORDS_REMEMBERED, CHUNKS_REMEMBERED = 400_000, 100_000
#: Characters of text after which a task hands its rows on.
HANDED_ON = 2_000_000

_RARE_SPACE = re.compile("[\x1c-\x1f]")  # str.split() takes these for blanks, tokenizers don't
_BLANKS = re.compile(r"[ \t\n\r]+")
_FIRST_BLANK, _LAST_BLANK = re.compile(r"[ \t\n\r]"), re.compile(r"[ \t\n\r][^ \t\n\r]*\Z")


# ------------------------------------------------------------------------------ chunks
def cut(text: str) -> list[str]:
    """Chunks of a text by a rolling hash of its last characters; joined they are the text."""
    if len(text) <= LEAST_CHUNK:
        return [text] if text else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    step = 1
    while step < WINDOW:  # sums of 2, 4, ... characters, older ones shifted further
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint32(step)
        h, step = wider, step * 2
    chunks, start = [], 0
    for end in (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        if end - start >= LEAST_CHUNK:
            chunks.append(text[start:end])
            start = end
    if start < len(text):
        chunks.append(text[start:])
    return chunks


def chunk_digest(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode(), digest_size=16).digest()


def slot_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") % SLOTS


class WordCoder:
    """Ids of text by a tokenizer that drops white space, word by word, with two generations of words remembered.

    No token, pattern or normal form reaches over a blank, so words can be encoded apart; the tests hold this against the library. Words are
    never cut. Ids are unsigned little-endian integers of ``width`` bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = array(self.kind, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self.young) >= WORDS_REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[word] = found
        return found

    def encode(self, text: str) -> bytes:
        words = _BLANKS.split(text) if _RARE_SPACE.search(text) else text.split()
        known = self.young.get
        return b"".join([known(w) or (self._word(w) if w else b"") for w in words])


_coders: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """One coder a path in each Python worker, kept from task to task."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


# ------------------------------------------------------------------------------ pieces and joins
def encode_piece(text: str, own: WordCoder) -> tuple[str, bytes | None, str]:
    """(head, ids, tail): the ids between the first and the last blank, and the text on either side.

    A text without a blank is all head, and its ids are null: nothing in it is certain before its neighbours are known.
    """
    first = _FIRST_BLANK.search(text)
    if not first:
        return text, None, ""
    last = _LAST_BLANK.search(text).start()
    return text[:first.start()], own.encode(text[first.start():last + 1]), text[last + 1:]


class Joiner:
    """Ids of a text from its pieces in order. At a blank the encodings of a piece and of the whole text agree.

    What lies between the last blank of what came before and the first blank of a piece is encoded again; where a piece has none, the
    window grows by all of it and on into the next.
    """

    def __init__(self, own: WordCoder):
        self.own, self.out, self.window = own, [], ""

    def add(self, head: str, ids: bytes | None, tail: str) -> None:
        self.window += head
        if ids is not None:
            self.out += [self.own.encode(self.window), ids]
            self.window = tail

    def finish(self) -> bytes:
        return b"".join([*self.out, self.own.encode(self.window)])


class Shared:
    """Which chunks are met more than once, by slot: certain to hold all that are."""

    def __init__(self, rows: list):
        self.rows = {r["row"]: r["bits"] for r in rows}

    def __contains__(self, digest: bytes) -> bool:
        slot = slot_of(digest)
        bits = self.rows.get(slot // SLOTS_A_ROW)
        return bits is not None and bits[slot % SLOTS_A_ROW >> 3] >> (slot & 7) & 1 == 1


def _pack_slots(key: tuple, rows: pa.Table) -> pa.Table:
    on = np.zeros(SLOTS_A_ROW, np.uint8)
    on[rows["slot"].to_numpy() % SLOTS_A_ROW] = 1
    return pa.table({"row": [key[0].as_py()], "bits": [np.packbits(on, bitorder="little").tobytes()]})


def shared_chunks(texts: DataFrame) -> Shared:
    """Counts chunks by slot and keeps one bit of each crowded slot: at most 2,048 rows of 4 KB reach the driver."""
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slot_of(chunk_digest(c)) for text in batch.column("text") for c in cut(text.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["slot"])

    crowded = texts.select("text").mapInArrow(slots, "slot long").groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    packed = crowded.select("slot", F.floor(F.col("slot") / SLOTS_A_ROW).alias("row")).groupBy("row").applyInArrow(_pack_slots, "row long, bits binary")
    return Shared(packed.collect())


def _id_lists(encoded: list[bytes], kind: str) -> pa.Array:
    flat = np.frombuffer(b"".join(encoded), np.dtype(kind).newbyteorder("<")).astype(np.int32)
    ends = np.cumsum([0] + [len(e) // array(kind).itemsize for e in encoded])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


PIECES = "row binary, id {id}, place int, digest binary, chunk string, head string, ids binary, tail string"


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, ids array<int>) of every row of ``docs``, equal to the library's ids without special tokens added.

    With ``decode`` the ids are decoded where they are made, as by :func:`decode_ids`, so that no second Python worker stands beside the first.

    For tokenizers that drop white space and mark word ends. Null and empty texts have no ids. Strings of special tokens inside a text are encoded as
    the library does. Rows that repeat an id or a text are each answered: every row gets a number of its own in the written pieces. Whole texts are encoded;
    texts without any shared chunk never move. Of a group of copies each chunk is encoded once, and its ids go to all rows that have
    it by a join that Spark may split. An empty table gives no rows. Other columns are not read, so their names are free.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    shared = spark.sparkContext.broadcast(shared_chunks(texts))
    schema = f"id {kind}, ids array<int>" + (", decoded string" if decode else "")

    def answers():
        """From ids and encoded texts to a batch of the result."""
        own, back = coder(path), _decoder(path) if decode else None

        def answer(ids: list, out: list[bytes], kinds: pa.DataType) -> pa.RecordBatch:
            lists = _id_lists(out, own.kind)
            columns = {"id": pa.array(ids, kinds), "ids": lists} | ({"decoded": back(lists)} if back else {})
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return answer

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without a shared chunk."""
        own, met, answer = coder(path), shared.value, answers()
        for batch in batches:
            ids, out, held = [], [], 0
            for i, value in zip(batch.column("id"), batch.column("text")):
                text = value.as_py() or ""
                if not any(chunk_digest(c) in met for c in cut(text)):
                    ids.append(i.as_py())
                    out.append(own.encode(text))
                    held += len(text)
                if held > HANDED_ON:
                    yield answer(ids, out, batch.column("id").type)
                    ids, out, held = [], [], 0
            yield answer(ids, out, batch.column("id").type)

    names = [c.split()[0] for c in PIECES.split(", ")]

    def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with shared chunks: those by digest, with their text the first time a task meets them, and encoded text between them.

        The id stands at a row's first piece alone.
        """
        own, met, told = coder(path), shared.value, set()
        for batch in batches:
            types = [pa.binary(), batch.column("id").type, pa.int32(), pa.binary(), pa.string(), pa.string(), pa.binary(), pa.string()]
            rows: list[tuple] = []
            held = 0
            for i, value in zip(batch.column("id"), batch.column("text")):
                text = value.as_py() or ""
                marked = [(c, d, d in met) for c in cut(text) for d in (chunk_digest(c),)]
                if not any(m for _, _, m in marked):
                    continue
                row, between, first = uuid.uuid4().bytes, [], len(rows)
                for chunk, digest, moves in [*marked, ("", b"", True)]:
                    if not moves:
                        between.append(chunk)
                        continue
                    if between:
                        rows.append((row, i.as_py() if len(rows) == first else None, len(rows) - first, None, None, *encode_piece("".join(between), own)))
                        between = []
                    if digest:
                        if len(told) >= CHUNKS_REMEMBERED:
                            told.clear()
                        rows.append((row, i.as_py() if len(rows) == first else None, len(rows) - first, digest, None if digest in told else chunk, None, None, None))
                        told.add(digest)
                held += len(text)
                if held > HANDED_ON:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            found = [encode_piece(c.as_py(), own) for c in batch.column("chunk")]
            heads, ids, tails = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(heads, pa.string()), pa.array(ids, pa.binary()), pa.array(tails, pa.string())],
                                             names=["digest", "head", "ids", "tail"])

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces sorted by row and place, one text at a time."""
        own, answer = coder(path), answers()
        joiner, row, i, ids, out, held = Joiner(own), None, None, [], [], 0
        for batch in batches:
            kinds = batch.column("id").type
            for r, this, head, piece, tail in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "head", "ids", "tail"))):
                if r != row:
                    if row is not None:
                        ids.append(i)
                        out.append(joiner.finish())
                        held += len(out[-1])
                    joiner, row, i = Joiner(own), r, this
                joiner.add(head, piece, tail)
                if held > HANDED_ON:
                    yield answer(ids, out, kinds)
                    ids, out, held = [], [], 0
        if row is not None:
            yield answer([*ids, i], [*out, joiner.finish()], kinds)

    pieces = written(texts.mapInArrow(in_pieces, PIECES.format(id=kind)), "zstd")
    encoded = pieces.filter("chunk is not null").select("digest", "chunk").distinct().mapInArrow(
        encode_chunks, "digest binary, head string, ids binary, tail string")
    moved = pieces.filter("digest is not null").select("row", "id", "place", "digest").join(encoded, "digest")
    columns = ["row", "id", "place", "head", "ids", "tail"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = (pieces.filter("digest is null").select(*columns).unionByName(moved.select(*columns))
             .repartition(parts, "row").sortWithinPartitions("row", "place").mapInArrow(join_pieces, schema))
    return texts.mapInArrow(alone, schema).unionByName(whole)


def _decoder(path: str):
    """From lists of ids to texts, a batch at a time."""
    tokenizer = coder(path).tokenizer
    tokens = pa.array([tokenizer.id_to_token(i) for i in range(max(tokenizer.get_vocab().values()) + 1)], pa.large_string())

    def decode(lists: pa.Array) -> pa.Array:
        lists = pc.fill_null(lists, []) if lists.null_count else lists
        sizes = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
        flat = lists.flatten()
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens)))
        words = tokens.take(pc.if_else(known, flat, pa.scalar(None, pa.int32())))
        if words.null_count:
            there = words.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.concatenate(([0], np.cumsum(there)))[sizes]
            words = words.drop_null()
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(sizes, pa.int64()), words), pa.scalar(" ", pa.large_string())).cast(pa.string())

    return decode


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text that the library's ``decode`` gives with special tokens kept.

    For tokenizers without a decoder: tokens as the vocabulary writes them, joined by one blank. Null and empty lists give an empty text. An id the
    vocabulary lacks is left out, as the library does. A column ``decoded`` is replaced.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    kept = [c for c in encoded.columns if c != "decoded"]
    schema = StructType([*encoded.select(*kept).schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), decode(batch.column(ids_col))], names=[*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(run, schema)
