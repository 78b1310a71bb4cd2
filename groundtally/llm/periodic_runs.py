"""Periodic runs of words by internal pattern matching.

A run of period q that repeats three times contains a dyadic block (2^k words at a multiple of 2^k) that occurs again q words
later. So every block asks where it occurs next in the window behind it: the suffix array puts all occurrences of a block side by side, and a
wavelet matrix over it tells the first, the last and the number of those that fall into the window. In a window of a block's length they form an
arithmetic progression, which names at most three candidate periods. Candidates are extended both ways to their whole runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_WORDS, LEAST_REPEATS = 24, 3
#: Blocks of 8 words and more: a run of 24 words holds one whose next occurrence lies in it too, whatever its period.
FIRST_LEVEL = 3
#: Words taken together by one call of numpy; a longer text is a batch of its own.
BATCH_WORDS = 1 << 16
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


class Suffixes:
    """Ranks of all substrings of 2^k words of a sequence of codes, level by level, until all of them are unique.

    Each text must end in a code of its own, so that nothing equal reaches over an end. A rank is the place of the first of its equals in
    the suffix order; only places that still have an equal are sorted again.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        rank, size = np.zeros(n, np.int64), np.ones(n, np.int64)
        active, key = np.arange(n), codes.astype(np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            order = np.argsort(key, kind="stable")
            at, key = active[order], key[order]
            place = np.arange(len(at))
            first = np.ones(len(at), bool)
            first[1:] = key[1:] != key[:-1]
            began = np.maximum.accumulate(np.where(first, place, 0))
            old = rank[at]
            opens = np.ones(len(at), bool)
            opens[1:] = old[1:] != old[:-1]
            rank, size = rank.copy(), size.copy()
            rank[at] = old + began - np.maximum.accumulate(np.where(opens, place, 0))
            edges = np.append(np.flatnonzero(first), len(at))
            size[at] = np.repeat(np.diff(edges), np.diff(edges))
            self.levels.append((rank, size))
            active = np.sort(at[size[at] > 1])
            if not len(active):
                break
            key = rank[active] * n + rank[active + (1 << len(self.levels) - 1)]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on are equal."""
        start, i, j = i, i.copy(), j.copy()
        for k in range(len(self.levels) - 2, -1, -1):
            rank = self.levels[k][0]
            step = (rank[i] == rank[j]) * (1 << k)
            i += step
            j += step
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and j are equal; i is the smaller."""
        start, i, j = i, i.copy(), j.copy()
        for k in range(len(self.levels) - 2, -1, -1):
            rank, step = self.levels[k][0], 1 << k
            same = (i >= step) & (rank[np.maximum(i - step, 0)] == rank[np.maximum(j - step, 0)])
            i -= same * step
            j -= same * step
        return start - i


class WaveletMatrix:
    """Order statistics of value ranges inside index ranges of an array of 0..m-1, many queries at once."""

    def __init__(self, values: np.ndarray):
        self.planes = []
        for bit in range(int(len(values)).bit_length() - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            zeros = np.concatenate(([0], np.cumsum(~one)))
            self.planes.append((bit, zeros))
            values = np.concatenate((values[~one], values[one]))

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values at lo..hi-1 are smaller than bound."""
        found = np.zeros_like(lo)
        for bit, zeros in self.planes:
            a, b = zeros[lo], zeros[hi]
            up = (bound >> bit) & 1 == 1
            found += np.where(up, b - a, 0)
            lo, hi = np.where(up, zeros[-1] + lo - a, a), np.where(up, zeros[-1] + hi - b, b)
        return found

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) at lo..hi-1."""
        found = np.zeros_like(lo)
        for bit, zeros in self.planes:
            a, b = zeros[lo], zeros[hi]
            up = k >= b - a
            found += up * (1 << bit)
            k = np.where(up, k - (b - a), k)
            lo, hi = np.where(up, zeros[-1] + lo - a, a), np.where(up, zeros[-1] + hi - b, b)
        return found


def _candidates(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs, among them one for every run."""
    none = np.zeros(0, np.int64)
    if len(suffixes.levels) <= FIRST_LEVEL:
        return none, none
    held = np.flatnonzero(suffixes.levels[FIRST_LEVEL][1] > 1)  # ascending; all others occur once
    last = suffixes.levels[-1][0]
    array = held[np.argsort(last[held])]
    order = last[array]
    matrix = WaveletMatrix(np.searchsorted(held, array))
    places, periods = [none], [none]
    for level in range(FIRST_LEVEL, len(suffixes.levels) - 1):
        length, (rank, size) = 1 << level, suffixes.levels[level]
        blocks = held[held % length == 0]
        blocks = blocks[size[blocks] > 1]
        lo = np.searchsorted(order, rank[blocks])
        hi = lo + size[blocks]
        for near, far in [(1, length + 1), (length + 1, 2 * length)] if level == FIRST_LEVEL else [(length, 2 * length)]:
            skip = matrix.below(lo, hi, np.searchsorted(held, blocks + near))
            met = matrix.below(lo, hi, np.searchsorted(held, blocks + far)) - skip
            some = met > 0
            b, a, z, s, m = blocks[some], lo[some], hi[some], skip[some], met[some]
            first, final = held[matrix.kth(a, z, s)], held[matrix.kth(a, z, s + m - 1)]
            places += [b, b[m == 2]]
            periods += [first - b, (final - b)[m == 2]]
            # Three occurrences or more: the block itself has the progression's period, and where that breaks off behind
            # the block and behind its occurrences are a period of the run apart.
            many = m > 2
            b, first, p = b[many], first[many], ((final - first)[many] // (m[many] - 1))
            far_apart = first + suffixes.forward(first, first + p) - b - suffixes.forward(b, b + p)
            places.append(b[far_apart > 0])
            periods.append(far_apart[far_apart > 0])
    return np.concatenate(places), np.concatenate(periods)


def find_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period. See :class:`Suffixes` for the codes."""
    suffixes = Suffixes(codes)
    at, period = _candidates(suffixes)
    inside = at + period < len(codes)
    at, period = at[inside], period[inside]
    start = at - suffixes.backward(at, at + period)
    length = at + period + suffixes.forward(at, at + period) - start
    runs = (length >= LEAST_WORDS) & (length >= LEAST_REPEATS * period)
    # A multiple of the smallest period is extended to just the same stretch.
    found = np.unique(np.stack([start, length, period], 1)[runs], axis=0)
    if len(found):
        found = found[np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(1)))]
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2]


def _batch_runs(texts: list[list[str]]) -> Iterator[tuple[list[dict], list[str]]]:
    """Runs and kept words of each list of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    numbers: dict[str, int] = {}
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(sizes.sum()))
    text_of = np.repeat(np.arange(len(texts)), sizes)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    codes = np.arange(starts[-1], dtype=np.int64) - starts[-1]  # negative: the ends, all different
    codes[np.arange(len(words)) + text_of] = text_of * (len(numbers) + 1) + words
    start, length, period = find_runs(codes)
    dropped = np.zeros(len(codes) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    dropped = np.cumsum(dropped) > 0
    edges = np.searchsorted(start, starts)
    for k, text in enumerate(texts):
        base, own = int(starts[k]), slice(edges[k], edges[k + 1])
        runs = [{"start": s - base, "length": n, "period": q} for s, n, q in zip(start[own].tolist(), length[own].tolist(), period[own].tolist())]
        yield runs, [w for w, gone in zip(text, dropped[base:base + len(text)].tolist()) if not gone] if runs else text


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[object, list[str]], list[str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are stretches without blanks. A run is a longest stretch of words with smallest period q, of 24 words and
    three periods at least. ``collapsed`` keeps of each run its first period: a word is left out if any run holds it behind its first q words.
    ``rewrite`` changes a row's words first, given its id. Null and empty texts have no words, no runs and an empty ``collapsed``.
    Rows that repeat an id or a text are each answered. Whole texts are read, where they lie; texts are taken
    together up to 65,536 words, and a longer text alone, so a task holds no more than its longest text. An empty table gives no rows. Other columns
    are not read, so their names are free.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def answer(ids: list, texts: list[list[str]], id_type: pa.DataType) -> pa.RecordBatch:
        runs, kept = zip(*_batch_runs(texts))
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, run_type),
                                           pa.array([" ".join(k) for k in kept], pa.string())], names=["id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for i, text in zip(batch.column(0), batch.column(1)):  # one text at a time leaves Arrow
                words = WORDS.findall(text.as_py() or "")
                ids.append(i.as_py())
                texts.append(rewrite(ids[-1], words) if rewrite else words)
                held += len(words)
                if held >= BATCH_WORDS:
                    yield answer(ids, texts, batch.column(0).type)
                    ids, texts, held = [], [], 0
            if ids:
                yield answer(ids, texts, batch.column(0).type)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
