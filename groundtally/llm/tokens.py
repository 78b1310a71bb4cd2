"""Token ids by the tokenizers library, with a bounded memory of pieces of text already encoded."""

from __future__ import annotations

import os
from array import array

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plainly_spaced(text: str) -> bool:
    """Whether all white space is lone blanks and line feeds between words.

    Then the byte-level tokenizers always cut before a blank, which belongs to the word after it, and around a
    line feed. Other white space (runs, tabs, at either end) depends on what surrounds it.
    """
    return " ".join(text.split()) == text.replace("\n", " ")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use: a printable byte is its own, the others follow 255."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(spare)) for b in range(256)}


class TokenEncoder:
    """Text to ids, as little-endian 32-bit unsigned bytes, by the library's tokenizer.

    Words are looked up in two generations of a memory, ``remembered`` pieces each; when the young
    one is full it becomes the old one. Unknown words go piece by piece through the library's BPE model.
    Where the tokenizer isn't plain byte-level BPE, or the white space isn't plain, the library
    encodes the whole text at once. Results do not depend on the way.
    """

    def __init__(self, path: str, remembered: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        shape = str(self.tokenizer.pre_tokenizer)
        self.plain = self.tokenizer.normalizer is None and shape.startswith("ByteLevel(") and "add_prefix_space=False" in shape and "use_regex=True" in shape
        self.remembered = remembered
        self.letters = _byte_letters()
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        #: Words after a blank, without it, and words that begin a line: each in two generations.
        self.young: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.line_feed = self._pieces("\n") if self.plain else b""

    def _pieces(self, text: str) -> bytes:
        model, letters = self.tokenizer.model, self.letters
        cut = [text] if text[text[0] == " ":].isalpha() else self.pieces(text)
        return array("I", [t.id for p in cut for t in model.tokenize(p.encode().decode("latin-1").translate(letters))]).tobytes()

    def _word(self, word: str, first: bool) -> bytes:
        found = self.old[first].get(word)
        if found is None:
            found = self._pieces(word if first else " " + word)
        if len(self.young[0]) + len(self.young[1]) >= self.remembered:
            for young, old in zip(self.young, self.old):
                old.clear()
                old.update(young)
                young.clear()
        self.young[first][word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain or any(s in text for s in self.special) or not plainly_spaced(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        inner, starts, word = self.young[0].get, self.young[1].get, self._word
        out: list[bytes] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(starts(first) or word(first, True))
            out += [inner(w) or word(w, False) for w in rest]
            out.append(self.line_feed)
        out.pop()
        return b"".join(out)


_encoders: dict[str, TokenEncoder] = {}


def encoder(path: str) -> TokenEncoder:
    """One encoder a path in each Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = TokenEncoder(path)
    return _encoders[path]
