"""Self-join of documents on the Jaccard similarity of their word n-grams, by set-relation skipping.

Equal sets are one set from the start. Of two sets that reach the threshold the first few elements,
in one global order with frequent elements last, must share one; those prefixes are the index. Its lists are
worked off in rounds. In each, a few sets of every list, drawn anew, are its pivots, and a set meets a few others at most, the
pivots it shares most lists with; verified links give components; rounds go on while they link much. A list whose sets are
all in one component is skipped whole: their links change no answer. In the lists that stay mixed, sets outside the largest component meet the rest,
block by block: two sets are brought together only where nothing before the shared element need be shared, as in the list of the first
one they share; blocks of one list are skipped by that bound and by size, and for sets that were compared with
one and the same pivot the overlap is bounded by what is known of the pivot's. Sketches rule out most of the rest, and
only undecided pairs are read in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from groundtally.llm.common import digest_of, written

WORDS, PER_CENT = 5, 75
#: Counters by which the global order tells frequent shingles; a shingle's counter is its hash modulo their number. They change
#: the work, never the result. They move in blocks.
FREQUENT, BLOCK, CHUNK_SHINGLES = 1 << 22, 1 << 14, 1 << 20
#: Rounds of pivots go on while a round brings more than this part of all links so far.
GAIN = 1 / 20
#: Pivots of a list, and pairs of a set, in the first, second, ... round.
PIVOTS, MEETS = (4, 16, 64), (2, 4, 8)
SLOTS = 1 << 20


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes.

    A shingle's hash is a sum over its bytes, blanks made single: a random number for the byte times
    a power of an odd number for its place. Running sums over the text give all shingles at once.
    """

    _LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))

    def __init__(self, words: int):
        import xxhash

        self.words, self.digest = words, xxhash.xxh3_64_intdigest
        self.of_byte = np.array([self.digest(b"byte %d" % i) for i in range(256)], np.uint64)
        self.factor = self.digest(b"place") | 1
        self._powers(1 << 14)

    def _powers(self, size: int) -> None:
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[0] = down[0] = 1
        up[1:], down[1:] = self.factor, pow(self.factor, -1, 1 << 64)
        self.up, self.down = np.cumprod(up), np.cumprod(down)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass").translate(self._LOWER)
        if b"  " in raw or raw[:1] == b" " or raw[-1:] == b" ":
            raw = b" ".join(raw.split())
        if not raw:
            return np.zeros(0, np.uint64)
        data = np.frombuffer(raw, np.uint8)
        if data.size >= self.up.size:
            self._powers(2 * data.size)
        sums = np.empty(data.size + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.of_byte[data] * self.up[:data.size], out=sums[1:])
        blanks = np.flatnonzero(data == 32)
        n = max(blanks.size + 2 - self.words, 1)
        starts, ends = np.zeros(n, np.int64), np.full(n, data.size)
        starts[1:] = blanks[:n - 1] + 1
        ends[:-1] = blanks[self.words - 1:self.words + n - 2]
        mixed = (sums[ends] - sums[starts]) * self.down[starts]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed.sort()
        first = np.ones(n, bool)
        np.not_equal(mixed[1:], mixed[:-1], out=first[1:])
        return mixed[first]

    def sketch(self, shingles: np.ndarray) -> bytes:
        """Bit i is the parity of the shingles that end in i; as many bits as shingles, up to a power of two, 64 at least.

        Bits in which two sketches differ are no more than elements in which the sets differ. A sketch
        folds to half its size by adding its halves.
        """
        bits = 1 << max(6, (shingles.size - 1).bit_length())
        parity = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(parity.astype(bool), bitorder="little").tobytes()

    def name(self, shingles: np.ndarray) -> int:
        """A 63-bit name of a set; with the set's size it stands for the set."""
        return self.digest(shingles.tobytes()) >> 1


def _sets(batches: Iterator[pa.RecordBatch], words: int):
    make = Shingler(words)
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield make, name, make(text.as_py())


def _batches(rows: list[tuple], types: dict) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def name_sets(docs: DataFrame, words: int, counters: int) -> DataFrame:
    """Rows of two kinds from one scan: documents (id, n, set, sketch) and blocks of a task's counters (set_name: the block, sketch: packed).

    An id may be of any type; it is passed on.
    """
    kind_of_id = docs.schema[0].dataType
    types = {"kind": pa.int32(), "id": to_arrow_type(kind_of_id), "n": pa.int64(), "set_name": pa.int64(), "sketch": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chunk: list[np.ndarray] = []
        held = 0
        counts = np.zeros(counters, np.uint32)

        def count() -> None:
            slots = (np.concatenate(chunk) % np.uint64(counters)).astype(np.int64)
            counts[:] += np.bincount(slots, minlength=counters).astype(np.uint32)

        for make, name, shingles in _sets(batches, words):
            rows.append((0, name, shingles.size, make.name(shingles), make.sketch(shingles)) if shingles.size else (0, name, 0, None, None))
            chunk.append(shingles)
            held += shingles.size
            if held >= CHUNK_SHINGLES:
                count()
                chunk, held = [], 0
            if len(rows) >= 20_000:
                yield _batches(rows, types)
                rows.clear()
        if chunk:
            count()
        for start in range(0, counters, BLOCK):
            block = counts[start:start + BLOCK]
            if block.any():
                rows.append((1, None, block.size, start // BLOCK, pa.compress(block.tobytes(), "zstd", asbytes=True)))
        yield _batches(rows, types)

    return docs.mapInArrow(run, f"kind int, id {kind_of_id.simpleString()}, n long, set_name long, sketch binary")


def frequency_classes(blocks: DataFrame, counters: int) -> np.ndarray:
    """Two classes for each doubling of a counter, 0 where it is at most one. ``counters`` bytes, whatever the corpus."""
    types = {"block": pa.int64(), "classes": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.frombuffer(pa.decompress(packed, 4 * n, "zstd", asbytes=True), np.uint32)
                sums[block] = sums[block] + counts if block in sums else counts.astype(np.uint64)
        yield _batches([(b, np.floor(2 * np.log2(np.maximum(c, 1))).astype(np.uint8).tobytes()) for b, c in sums.items()], types)

    classes = np.zeros(counters, np.uint8)
    parts = min(64, -(-counters // BLOCK))
    found = blocks.select("set_name", "n", "sketch").repartition(parts, "set_name").mapInArrow(run, "block long, classes binary")
    for block, packed in found.collect():  # one byte a counter
        classes[block * BLOCK:block * BLOCK + len(packed)] = np.frombuffer(packed, np.uint8)
    return classes


def least_overlap(a: Column, b: Column, per_cent: int) -> Column:
    """The smallest intersection with which sets of these sizes link, as an integer."""
    return F.ceil(F.lit(per_cent) * (a + b) / F.lit(100 + per_cent))


def prefix_postings(docs: DataFrame, words: int, per_cent: int, classes: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, common, size, packed): the index prefix of every set, once a task for equal sets, in columns of bytes.

    Postings are packed by the bucket they belong to before they move, many to a row. Those of frequent
    tokens are dealt by set, so that no list of them meets in one task; the others by token.
    """
    order = docs.sparkSession.sparkContext.broadcast(classes)  # FREQUENT bytes
    # eight times what a counter holds in the middle, 256 at least
    often = max(16, int(np.median(classes)) + 6)
    counters = classes.size
    types = {"bucket": pa.int32(), "common": pa.bool_(), "size": pa.int32(), "packed": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        seen: set[tuple[int, int]] = set()
        parts: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            token, name, n, pos, common = (np.concatenate(c) for c in zip(*parts))
            bucket = (np.where(common, name.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), token) >> np.uint64(32)) % np.uint64(buckets)
            key = bucket * np.uint64(2) + common
            by_key = np.argsort(key, kind="stable")
            key = key[by_key]
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            columns = [c[by_key] for c in (token, name, n, pos)]
            rows = [(int(key[a]) >> 1, bool(key[a] & np.uint64(1)), b - a, b"".join(c[a:b].tobytes() for c in columns)) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            return _batches(rows, types)

        for make, _, shingles in _sets(batches, words):
            n = shingles.size
            if not n:
                continue
            name = make.name(shingles)
            if (name, n) in seen:
                continue
            if len(seen) < 1_000_000:
                seen.add((name, n))
            take = n - (-(-per_cent * n // 100)) + 1
            cls = rank[shingles % np.uint64(counters)]
            pick = np.argsort(cls, kind="stable")[:take]
            parts.append((shingles[pick], np.full(take, name, np.int64), np.full(take, n, np.uint32), np.arange(take, dtype=np.uint32), cls[pick] >= often))
            held += take
            if held >= 300_000:
                yield out()
                parts, held = [], 0
        if parts:
            yield out()

    return docs.mapInArrow(run, "bucket int, common boolean, size int, packed binary")


def _possible(token: np.ndarray, n: np.ndarray, pos: np.ndarray, per_cent: int) -> np.ndarray:
    """Which postings, sorted by token, may be of the first element shared with some set of their list, by size and position.

    A partner has the least size of the list or more; in a list of two it is known.
    """
    if not token.size:
        return np.zeros(0, bool)
    begins = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    sizes = np.diff(np.append(begins, token.size))
    n, rest = n.astype(np.int64), n.astype(np.int64) - pos
    fits = (100 + per_cent) * rest >= per_cent * (n + np.maximum(np.repeat(np.minimum.reduceat(n, begins), sizes), -(-per_cent * n // 100)))
    a = begins[sizes == 2]
    b = a + 1
    fits[a] = fits[b] = (100 * np.minimum(n[a], n[b]) >= per_cent * np.maximum(n[a], n[b])) & ((100 + per_cent) * np.minimum(rest[a], rest[b]) >= per_cent * (n[a] + n[b]))
    return fits


def _shared(postings: DataFrame, partitions: int, per_cent: int) -> DataFrame:
    """(token, set_name, n, pos) of tokens in two sets or more, each once; frequent tokens are known to be.

    Of other tokens, postings that can't be where a link is met first are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            for common, size, packed in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                read[common].append((np.frombuffer(packed, np.uint64, size), np.frombuffer(packed, np.int64, size, 8 * size),
                                     np.frombuffer(packed, np.uint32, size, 16 * size), np.frombuffer(packed, np.uint32, size, 20 * size)))
        for common, parts in read.items():
            if not parts:
                continue
            token, name, n, pos = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(token, kind="stable")
            same = token[order[1:]] == token[order[:-1]]
            order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if not common else order
            order = order[np.lexsort((name[order], token[order]))]
            token, name, n, pos = token[order], name[order], n[order], pos[order]
            first = np.ones(token.size, bool)
            first[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1]) | (n[1:] != n[:-1])
            token, name, n, pos = token[first], name[first], n[first], pos[first]
            if not common:
                fits = _possible(token, n, pos, per_cent)
                token, name, n, pos = token[fits], name[fits], n[fits], pos[fits]
                same = token[1:] == token[:-1]
                many = np.concatenate(([False], same)) | np.concatenate((same, [False])) if token.size else np.zeros(0, bool)
                token, name, n, pos = token[many], name[many], n[many], pos[many]
            out = pa.table({"token": token.view(np.int64), "set_name": name, "n": n.astype(np.int32), "pos": pos.astype(np.int32)})
            yield from out.to_batches(max_chunksize=50_000)

    return postings.repartition(partitions, "bucket").mapInArrow(run, "token long, set_name long, n int, pos int")


def _slots_of(names: DataFrame) -> np.ndarray:
    """Which of a fixed number of slots hold a name: a bounded filter, never the names."""
    rows = names.select(F.pmod("set_name", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toPandas()
    slots = np.zeros(SLOTS, bool)
    slots[rows["slot"].to_numpy(np.int64)] = True
    return slots


def read_sets(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(set_name, n, shingles) of the wanted sets and of some that share a slot with one."""
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(np.packbits(_slots_of(wanted)))
    types = {"set_name": pa.int64(), "n": pa.int32(), "shingles": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.unpackbits(held.value).astype(bool)
        seen: set[tuple[int, int]] = set()
        rows: list[tuple] = []
        for make, _, shingles in _sets(batches, words):
            n = shingles.size
            name = make.name(shingles) if n else 0
            if not n or not slots[name % SLOTS] or (name, n) in seen:
                continue
            if len(seen) < 1_000_000:
                seen.add((name, n))
            rows.append((name, n, shingles.view(np.int64)))
            if len(rows) >= 256:
                yield _batches(rows, types)
                rows = []
        if rows:
            yield _batches(rows, types)

    found = docs.mapInArrow(run, "set_name long, n int, shingles array<long>")
    return found.groupBy("set_name", "n").agg(F.first("shingles").alias("shingles"))


def _plausible(pairs: DataFrame, sketches: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, na, b, nb) with ``cap``, what their sketches leave for the overlap, and whether that allows a link."""
    def fold(sketch: bytes, size: int) -> int:
        value, have = int.from_bytes(sketch, "little"), len(sketch)
        while have > size:
            have //= 2
            value = (value ^ value >> 8 * have) & ((1 << 8 * have) - 1)
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            caps, likely = [], []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))):
                size = min(len(x), len(y))
                differ = (fold(x, size) ^ fold(y, size)).bit_count()
                caps.append((na + nb - differ) // 2)
                likely.append(caps[-1] >= -(-per_cent * (na + nb) // (100 + per_cent)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "na", "b", "nb")), pa.array(caps, pa.int32()), pa.array(likely, pa.bool_())],
                                             names=["a", "na", "b", "nb", "cap", "likely"])

    side = lambda s: sketches.select(F.col("set_name").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"x{s}"))
    both = pairs.join(side("a"), ["a", "na"]).join(side("b"), ["b", "nb"])
    return both.select("a", "na", "b", "nb", "xa", "xb").mapInArrow(run, "a long, na int, b long, nb int, cap int, likely boolean")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, na, b, nb) with their overlap, from the whole sets."""
    left = sets.select(F.col("set_name").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("set_name").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, ["a", "na"]).join(right, ["b", "nb"])
    return both.select("a", "na", "b", "nb", F.size(F.array_intersect("sa", "sb")).alias("overlap"))


def contract(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that (u, v) links reach, by alternating star contractions."""
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u")
        step = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v")))
                .filter("u <> v").distinct())
        after = written(step)
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = after


def _may_link(x: Mapping[str, Column] | Column, y: Mapping[str, Column] | Column, per_cent: int, first: bool = False) -> Column:
    """Size and position: whether this token, what comes after it and what comes before reach the least overlap.

    With ``first`` without what comes before: nothing of that is shared at the first token that two linked sets share, so every
    link is met in the list of its first shared token.
    """
    nx, ny, px, py = (s[c] for c in ("n", "pos") for s in (x, y))
    before = F.lit(0) if first else F.least(px, py)
    return (100 * F.least(nx, ny) >= per_cent * F.greatest(nx, ny)) & (before + F.least(nx - px, ny - py) >= least_overlap(nx, ny, per_cent))


def _pivot_pairs(labelled: DataFrame, per_cent: int, round_no: int, compared: DataFrame | None) -> DataFrame:
    """Pairs (a, na, b, nb): sets b with pivots of their lists that are in other components.

    A list has :data:`PIVOTS` pivots at most, a set :data:`MEETS` pairs, the more the later the round. The pivots are drawn by
    hash of the round. Pairs of ``compared`` (a, b) are passed over; of the others those that share most lists are taken. From
    the second round on, a list's largest component isn't led to the others, as they are led to it.
    """
    pivots, meets = (few[min(round_no, len(few) - 1)] for few in (PIVOTS, MEETS))
    place = F.struct(F.xxhash64("set_name", F.lit(round_no)).alias("key"), "root", "set_name", "n", "pos")
    drawn = labelled.groupBy("token", F.pmod("set_name", F.lit(pivots)).alias("part")).agg(F.min(place).alias("p"))
    drawn = drawn.groupBy("token").agg(F.collect_list("p").alias("drawn"))
    led = labelled if compared is None else labelled.filter("root <> first_root")
    other = lambda p: (p["root"] != F.col("root")) & _may_link(F.struct("n", "pos"), p, per_cent)
    met = led.join(drawn, "token").select(F.col("set_name").alias("b"), F.col("n").alias("nb"), F.explode(F.filter("drawn", other)).alias("p"))
    found = met.groupBy("b", "nb", F.col("p.set_name").alias("a"), F.col("p.n").alias("na"), F.col("p.key").alias("key")).agg(F.count(F.lit(1)).alias("lists"))
    if compared is not None:
        found = found.join(compared, ["a", "b"], "left_anti")
    best = found.groupBy("b", "nb").agg(F.slice(F.sort_array(F.collect_list(F.struct("lists", "key", "a", "na")), asc=False), 1, meets).alias("best"))
    return best.select("b", "nb", F.explode("best").alias("p")).select("p.a", "p.na", "b", "nb")


def _mixed(labelled: DataFrame) -> DataFrame:
    """Lists with sets of two components or more, with the component of each that has most sets in all as ``first_root``."""
    ends = labelled.groupBy("token").agg(F.max(F.struct("sets", "root")).alias("largest"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1")
    return labelled.drop("sets").join(ends.select("token", F.col("largest.root").alias("first_root")), "token")


def similar_sets(docs: DataFrame, words: int = WORDS, per_cent: int = PER_CENT) -> tuple[DataFrame, DataFrame]:
    """Documents (id, n, set_name) and components (set_name, root) of sets linked to another; ``docs`` has id and text."""
    spark = docs.sparkSession
    rows = written(name_sets(docs, words, FREQUENT))
    named = rows.filter("kind = 0").select("id", "n", "set_name")
    classes = frequency_classes(rows.filter("kind = 1"), FREQUENT)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = written(_shared(prefix_postings(docs, words, per_cent, classes, 4 * partitions), partitions, per_cent))
    sketches = rows.filter("kind = 0 and n > 0").groupBy("set_name", F.col("n").cast("int").alias("n")).agg(F.first("sketch").alias("sketch"))
    sides = lambda p: p.select(F.col("a").alias("set_name")).unionByName(p.select(F.col("b").alias("set_name")))
    links = lambda v: v.filter(F.col("overlap") >= least_overlap(F.col("na"), F.col("nb"), per_cent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    both_ways = lambda p: p.select("a", "b").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b")))

    labelled = lists.withColumn("root", F.col("set_name"))
    capped = exact = linked = roots = None
    total = round_no = 0
    while True:
        pairs = _pivot_pairs(labelled, per_cent, round_no, None if capped is None else both_ways(capped))
        round_no += 1
        caps = written(_plausible(pairs, sketches, per_cent))
        likely = caps.filter("likely").drop("cap", "likely")
        overlaps = written(_verified(likely, read_sets(docs, words, sides(likely))))
        capped = caps if capped is None else capped.unionByName(caps)
        exact = overlaps if exact is None else exact.unionByName(overlaps)
        gained = links(overlaps).count()
        total += gained
        if gained or roots is None:
            linked = links(exact)
            roots = contract(linked)
            sized = roots.join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("sets")), "root").withColumnRenamed("node", "set_name")
            known_roots = lists.join(sized, "set_name", "left").withColumn("root", F.coalesce("root", "set_name")).withColumn("sets", F.coalesce("sets", F.lit(1)))
            labelled = _mixed(known_roots)
            labelled = written(labelled)
        if gained <= GAIN * total:
            break

    # what is known of each set's overlap with its smallest pivot: exactly (c), or at most (cap)
    known = (capped.join(exact, ["a", "na", "b", "nb"], "left").groupBy(F.col("b").alias("set_name"))
             .agg(F.min(F.struct(F.col("a").alias("pivot"), F.coalesce("overlap", "cap").alias("cap"), F.col("overlap").alias("c"))).alias("k")))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / per_cent)).cast("int")
    step = F.floor(F.log2(F.col("pos") + 1.0)).cast("int")
    opened = written(labelled.join(known, "set_name", "left").select("*", "k.pivot", "k.cap", "k.c").drop("k").withColumn("band", band).withColumn("step", step))
    apart = opened.filter("root <> first_root")
    block = lambda d: d.groupBy("token", "band", "step").agg(F.min("n").alias("n0"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    x, y = block(apart).alias("x"), block(opened).alias("y")
    c = lambda s, k: F.col(f"{s}.{k}")
    near = (F.abs(c("x", "band") - c("y", "band")) <= 1) & (F.least(c("x", "rest"), c("y", "rest")) >= least_overlap(c("x", "n0"), c("y", "n0"), per_cent))
    blocks = (x.join(y, (c("x", "token") == c("y", "token")) & near)
              .select(c("x", "token").alias("token"), c("x", "band").alias("xb"), c("x", "step").alias("xs"), c("y", "band").alias("yb"), c("y", "step").alias("ys")))
    ax = apart.alias("x").join(blocks.alias("k"), (c("x", "token") == c("k", "token")) & (c("x", "band") == c("k", "xb")) & (c("x", "step") == c("k", "xs")))
    ax = ax.select("x.*", "k.yb", "k.ys").alias("x")
    beside = lambda s: c(s, "n") - F.coalesce(c(s, "c"), F.lit(0))  # noqa: E731  outside the pivot at most
    derived = F.least(c("x", "cap"), c("y", "cap")) + F.least(beside("x"), beside("y"))
    bounded = (c("x", "pivot") == c("y", "pivot")) & (derived < least_overlap(c("x", "n"), c("y", "n"), per_cent))
    once = (c("y", "root") == c("y", "first_root")) | (c("x", "set_name") < c("y", "set_name"))
    undecided = (c("x", "root") != c("y", "root")) & once & _may_link({k: c("x", k) for k in ("n", "pos")}, {k: c("y", k) for k in ("n", "pos")}, per_cent, first=True) & ~F.coalesce(bounded, F.lit(False))
    rest = ax.join(opened.alias("y"), (c("x", "token") == c("y", "token")) & (c("x", "yb") == c("y", "band")) & (c("x", "ys") == c("y", "step")) & undecided)
    swap = c("x", "set_name") > c("y", "set_name")
    more = rest.select(*(F.when(swap, c(s, k)).otherwise(c(t, k)).alias(o) for o, s, t, k in (("a", "y", "x", "set_name"), ("na", "y", "x", "n"), ("b", "x", "y", "set_name"), ("nb", "x", "y", "n")))).distinct()
    more = written(_plausible(more.join(both_ways(capped), ["a", "b"], "left_anti"), sketches, per_cent).filter("likely").drop("cap", "likely"))
    second = written(_verified(more, read_sets(docs, words, sides(more))))
    return named, contract(linked.unionByName(links(second)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of its set, and the smallest id that links reach.

    A set holds the distinct ``words``-grams of the text, A-Z lower-cased; a shorter text is one
    gram. Sets link when their Jaccard similarity reaches ``per_cent``. Null, empty and blank texts
    have no set, link with nothing and are their own component. Repeated rows share a component. A null id is
    passed over by the smallest id; a component without any id has none. An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    named, roots = similar_sets(rows, words, per_cent)
    by_set = named.filter("n > 0").groupBy("set_name").agg(F.min("id").alias("least"))
    rooted = by_set.join(roots.withColumnRenamed("node", "set_name"), "set_name", "left").withColumn("root", F.coalesce("root", "set_name"))
    rooted = written(rooted)
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = rooted.join(by_root, "root").select("set_name", "component_id")
    full = named.filter("n > 0").join(of_set, "set_name").select("id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(named.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which each component keeps the one with the smallest id; rows without a set all stay.

    Rows are told apart by id and digest of the text. A null id comes after any other, and among equal ids the
    smallest digest stays; of repeated rows one stays.
    """
    number, digest = docs[id_col].cast("long"), digest_of(docs[text_col])
    key = lambda i, sha: F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), sha)
    named, roots = similar_sets(docs.select(F.struct(number.alias("id"), digest.alias("sha")).alias("id"), docs[text_col].alias("text")))
    order = F.struct(F.col("id.id").isNull().alias("lost"), F.col("id.id").alias("id"), F.col("id.sha").alias("sha"))
    by_set = named.filter("n > 0").groupBy("set_name").agg(F.min(order).alias("least"))
    rooted = by_set.join(roots.withColumnRenamed("node", "set_name"), "set_name", "left").withColumn("root", F.coalesce("root", "set_name"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("least")).select(key(F.col("least.id"), F.col("least.sha")).alias("doc_key"), F.lit(True).alias("one"))
    bare = named.filter("n = 0").select(key(F.col("id.id"), F.col("id.sha")).alias("doc_key"), F.lit(False).alias("one")).distinct()
    packed = docs.select(F.struct("*").alias("doc"), key(number, digest).alias("doc_key")).withColumn("row", F.monotonically_increasing_id())
    kept = packed.join(firsts.unionByName(bare), "doc_key").withColumn("row", F.when(F.col("one"), F.lit(-1)).otherwise(F.col("row")))
    return kept.dropDuplicates(["doc_key", "row"]).select("doc.*")
