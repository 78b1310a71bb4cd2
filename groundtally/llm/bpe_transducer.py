"""Byte-level BPE as a finite-state transducer that is made deterministic while it is used.

A sequence of tokens is what the merges make of its bytes exactly when each neighbouring pair is:
no merge may ever have crossed the seam. That gives a transducer over bytes whose live paths all read the same bytes:
a path is a run of tokens that fit each other, ended by a node of the vocabulary's trie. A state of the
deterministic machine is the set of live paths after what they have in common has been emitted; states and
steps are made when first met. Paths that start more than one longest token ago have died, so
output lags by a bounded number of bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame

from groundtally.llm.common import map_rows
from groundtally.llm.tokens import plainly_spaced

NONE = -1
#: Bounds of a worker's memory; when one is reached the machine or the words start afresh.
MAX_STEPS, MAX_FITS, MAX_WORDS = 900_000, 500_000, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BpeTransducer:
    """Encodes single pieces of bytes by ``ranks``, lower ranks merged first, leftmost first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [NONE]
        self.halves: dict[int, tuple[int, int]] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self._merge(token, rank)
                if len(parts) != 2:
                    continue  # no merges lead to it; only a whole piece can be this token
                self.halves[rank] = (parts[0], parts[1])
            node = 0
            for byte in token:
                below = self.trie[node].get(byte)
                if below is None:
                    below = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(NONE)
                node = below
            self.token_at[node] = rank
        self.forget()

    def _merge(self, token: bytes, below: int) -> list[int]:
        """What merges of ranks under ``below`` leave of a token's bytes."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, i = min(((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if rank >= below:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(symbol, born, merged away) down one side of a token's tree; times are ranks, bytes are there from the start."""
        found = self.spines.get((token, side))
        if found is None:
            found, end = [], 1 << 60
            while True:
                halves = self.halves.get(token)
                found.append((token, NONE if halves is None else token, end))
                if halves is None:
                    break
                token, end = halves[side], token
            self.spines[found[0][0], side] = found
        return found

    def fit(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the seam between two neighbouring tokens.

        Symbols meet at the seam while both exist, and their pair merges when its rank comes before
        the merge that takes either away. At equal ranks the one further left goes first.
        """
        known = self.fits.get((left, right))
        if known is None:
            ranks, text = self.ranks, self.bytes_of
            known = True
            for a, born_a, end_a in self._spine(left, 1):
                for b, born_b, end_b in self._spine(right, 0):
                    if born_a < end_b and born_b < end_a:
                        rank = ranks.get(text[a] + text[b])
                        if rank is not None and rank < end_a and rank <= end_b:
                            known = False
            if len(self.fits) >= MAX_FITS:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def forget(self) -> None:
        start = (NONE, ((0, ()),))
        self.states: dict[tuple, int] = {start: 0}
        self.paths: list[tuple] = [start]
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.made = 0

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Read one byte: every live path goes down the trie, and the one token that fits ends here."""
        last, paths = self.paths[state]
        live, ended = [], None
        for node, run in paths:
            below = self.trie[node].get(byte)
            if below is None:
                continue
            token = self.token_at[below]
            before = run[-1] if run else last
            if token != NONE and ended is None and (before == NONE or self.fit(before, token)):
                ended = (*run, token)
            if self.trie[below]:
                live.append((below, run))
        live.append((0, ended))
        sure = 0
        while all(len(run) > sure and run[sure] == ended[sure] for _, run in live):
            sure += 1
        emitted = ended[:sure]
        rest = tuple([(node, run[sure:]) for node, run in live])
        if sure:
            last = emitted[-1]
        key = (last if any(not run for _, run in rest) else NONE, rest)  # what was emitted matters only to a path without a token
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = len(self.paths)
            self.paths.append(key)
            self.steps.append({})
        self.steps[state][byte] = found = (target, emitted)
        self.made += 1
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if self.made > MAX_STEPS:
            self.forget()
        out: list[int] = []
        state, steps = 0, self.steps
        for byte in piece:
            found = steps[state].get(byte) or self._step(state, byte)
            state = found[0]
            if found[1]:
                out += found[1]
        return out + list(self.paths[state][1][-1][1])


class Utf8Stream:
    """An incremental UTF-8 reader: bytes come in any cut, whole characters go out.

    Its state is the unfinished character at the end; what can't be finished becomes U+FFFD.
    """

    def __init__(self):
        self.rest = b""

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        keep = 0
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                keep = back if need > back else 0
                break
            if byte < 0x80:
                break
        cut = len(data) - keep
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


class TextCodec:
    """Whole texts to ids and back. The memory of words, of two generations, is bounded and doesn't change results."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.machine = BpeTransducer(read_ranks(path))
        self.pieces = regex.compile(pattern).findall
        #: Words after a blank, without it, and words that begin a line: each in two generations.
        self.young: tuple[dict[str, tuple[int, ...]], dict[str, tuple[int, ...]]] = ({}, {})
        self.old: tuple[dict[str, tuple[int, ...]], dict[str, tuple[int, ...]]] = ({}, {})
        self.line_feed = self._ids("\n")

    def _ids(self, text: str) -> tuple[int, ...]:
        encode = self.machine.encode
        return tuple([i for p in ([text] if text[text[0] == " ":].isalpha() else self.pieces(text)) for i in encode(p.encode("utf-8"))])

    def _word(self, word: str, first: bool) -> tuple[int, ...]:
        ids = self.old[first].get(word)
        if ids is None:
            ids = self._ids(word if first else " " + word)
        if len(self.young[0]) + len(self.young[1]) >= MAX_WORDS:
            for young, old in zip(self.young, self.old):
                old.clear()
                old.update(young)
                young.clear()
        self.young[first][word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not plainly_spaced(text):
            encode = self.machine.encode
            return list(chain.from_iterable(encode(p.encode("utf-8")) for p in self.pieces(text)))
        inner, starts, word = self.young[0].get, self.young[1].get, self._word
        out: list[tuple[int, ...]] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(starts(first) or word(first, True))
            out += [inner(w) or word(w, False) for w in rest]
            out.append(self.line_feed)
        out.pop()
        return list(chain.from_iterable(out))

    def decode_stream(self, ids: Iterable[int], block: int = 4096) -> Iterator[tuple[bytes, str]]:
        """(bytes, characters) as they become whole, block by block."""
        stream, table, held = Utf8Stream(), self.machine.bytes_of, list(ids)
        for start in range(0, len(held), block):
            data = b"".join([table[i] for i in held[start:start + block]])
            yield data, stream.feed(data)
        yield b"", stream.close()


_codecs: dict[tuple[str, str], TextCodec] = {}


def codec(path: str, pattern: str) -> TextCodec:
    """One codec a vocabulary in each Python worker, kept from task to task."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = TextCodec(path, pattern)
    return _codecs[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row; a null text is empty and has no ids; repeated rows and null ids stay as they are."""

    def make():
        encode = codec(path, pattern).encode
        return lambda rows: {"id": rows["id"], "ids": [encode(t) for t in rows["text"]]}

    return map_rows(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), "id long, ids array<int>", make)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, text) from (id, ids)."""

    def make():
        decode = codec(path, pattern).decode_stream
        return lambda rows: {"id": rows["id"], "text": ["".join(text for _, text in decode(i or ())) for i in rows["ids"]]}

    return map_rows(encoded, "id long, text string", make)


def code_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded, both told by digests."""

    def make():
        own = codec(path, pattern)

        def one(text: str | None) -> tuple[int, str, str]:
            ids, decoded = own.encode(text), hashlib.sha256()
            for data, _ in own.decode_stream(ids):
                decoded.update(data)
            return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), decoded.hexdigest()

        def batch(rows: dict) -> dict:
            told = list(zip(*map(one, rows["text"]))) or [(), (), ()]
            return {"id": rows["id"], "n_tokens": told[0], "ids_sha256": told[1], "decoded_sha256": told[2]}

        return batch

    return map_rows(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")),
                    "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
