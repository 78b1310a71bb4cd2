"""Best-fit packing of documents into token sequences, certified by lower bounds.

Each partition packs its pieces by best-fit decreasing and proves a lower bound on its number of
sequences by dual-feasible functions. Where the bound is met the packing is optimal and settled.
Elsewhere the sequences with room are opened, and partitions exchange them and pack anew, until
nothing is gained. A partition that fails to do better keeps what it was given.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtally.llm.common import written
from groundtally.llm.tokens import encoder, vocabulary_path

CAPACITY, PIECES_A_PARTITION = 2048, 100_000
PIECE_SCHEMA = "id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = f"{PIECE_SCHEMA}, sequence_id long, offset long, open boolean, bins long, bound long"


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
               vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the token ids of each document, cut where they exceed ``capacity``.

    Of a longer document the first piece takes the remainder, all others are full. A null text is
    empty and makes one piece of the end id alone; repeated rows make pieces of their own.
    """
    path, end = vocabulary or vocabulary_path(), end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            out: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                start, stop = 0, (total - 1) % capacity + 1
                for piece in range(-(-total // capacity)):
                    out.append((name, piece, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])))
                    start, stop = stop, stop + capacity
            columns = zip(*out) if out else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, PIECE_SCHEMA)


def lower_bound(lengths: np.ndarray, capacity: int, folds: int = 24) -> int:
    """No packing of ``lengths`` uses fewer bins: the best of two families of dual-feasible functions.

    One drops pieces under a threshold and rounds those that leave less than it up to a whole bin;
    the other rounds shares of a bin down to multiples of 1/k. Any such function keeps every
    feasible bin at one or less, so its total over all pieces, rounded up, is a bound.
    """
    if not lengths.size:
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    best = -(-int(total[-1]) // capacity)
    edge = np.arange(1, capacity // 2 + 1)
    whole = number[-1] - number[capacity - edge]
    between = total[capacity - edge] - total[edge - 1]
    best = max(best, int((whole + -(-between // capacity)).max()) if edge.size else 0)
    sizes = np.flatnonzero(counts)
    for k in range(1, folds + 1):
        share = (k + 1) * sizes
        units = np.where(share % capacity == 0, k * sizes, share // capacity * capacity)  # of 1 / (k * capacity)
        best = max(best, -(-int((units * counts[sizes]).sum()) // (k * capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each piece, taken in the given (decreasing) order, and each bin's room left.

    Open bins lie in stacks by room; a bit set over the rooms finds the tightest that fits.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, room_of, bins, offsets = 0, [], [], []
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            own, room = len(room_of), capacity
            room_of.append(capacity)
        bins.append(own)
        offsets.append(capacity - room)
        room_of[own] = room = room - length
        if room:
            stacks[room].append(own)
            rooms |= 1 << room
    return bins, offsets, room_of


def _pack(capacity: int, round_no: int, least_room: int):
    """Packs a whole partition; bounded, since partitions are cut by their number of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        lengths = table.column("length").to_numpy()
        before = table.column("sequence_id").to_numpy() if round_no else np.zeros(0)
        bound = lower_bound(lengths, capacity)
        bins, offsets, room = best_fit(lengths.tolist(), capacity)
        number = len(room)
        if round_no and number >= np.unique(before).size:
            number, sequence, offset = np.unique(before).size, before, table.column("offset").to_numpy()
            opened = np.zeros(lengths.size, bool) if number == bound else capacity - _filled(sequence, lengths) >= least_room
        else:
            own = np.array(bins, np.int64)
            sequence, offset = (round_no << 56) + (TaskContext.get().partitionId() << 24) + own, np.array(offsets, np.int64)
            opened = np.zeros(lengths.size, bool) if number == bound else np.array(room)[own] >= least_room
        made = {"sequence_id": sequence, "offset": offset, "open": opened, "bins": np.full(lengths.size, number), "bound": np.full(lengths.size, bound)}
        for name in ("id", "piece", "start", "length", "ids_crc32"):
            made[name] = table.column(name)
        names = [x.split()[0] for x in PACKED_SCHEMA.split(", ")]
        yield from pa.table({n: made[n] for n in names}).to_batches(max_chunksize=10_000)

    return run


def _filled(sequence: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    _, place = np.unique(sequence, return_inverse=True)
    return np.bincount(place, weights=lengths).astype(np.int64)[place]


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, pieces_a_partition: int = PIECES_A_PARTITION,
                least_room: int | None = None) -> DataFrame:
    """Pieces with sequence_id and offset, and ``bins`` and ``bound`` of the partition that packed them last.

    Full pieces are sequences of their own. Sequences with ``least_room`` free (a 32nd by default)
    in a partition over its bound are opened and sent, whole, to other partitions, until a round saves
    no sequence or what is open fits one partition. Pieces are dealt by row, so a partition holds about
    ``pieces_a_partition`` of them, whatever the corpus and however many are equal. Ties are packed in the order of
    id, piece and digest; pieces without an id are pieces like others. An empty table gives no rows.
    """
    least_room = max(1, capacity // 32) if least_room is None else least_room
    pieces = written(pieces)
    one = F.lit(1).cast("long")
    done = (pieces.filter(F.col("length") >= capacity)
            .select("*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                    F.lit(False).alias("open"), one.alias("bins"), one.alias("bound")))
    loose = pieces.filter(F.col("length") < capacity)
    deal: Column = F.monotonically_increasing_id()
    round_no, before = 0, None
    while count := loose.count():
        parts = math.ceil(count / pieces_a_partition)
        dealt = (loose.withColumn("deal", F.xxhash64(deal, F.lit(round_no))).repartition(parts, "deal").drop("deal")
                 .sortWithinPartitions(F.desc("length"), "id", "piece", "ids_crc32"))
        packed = written(dealt.mapInArrow(_pack(capacity, round_no, least_room), PACKED_SCHEMA))
        sequences = packed.filter("offset = 0").count()
        if parts == 1 or sequences == before:
            done = done.unionByName(packed)
            break
        done = done.unionByName(packed.filter("not open"))
        loose, deal = packed.filter("open").drop("open", "bins", "bound"), F.col("sequence_id")
        before = loose.filter("offset = 0").count()
        round_no += 1
    return done.drop("open")
