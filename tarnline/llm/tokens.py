"""Fast exact use of the tokenizers library: units between white space are encoded once each and looked up after.

A pre-tokenizer of either kind used here never joins characters across a white-space run other than
taking one leading space along, so a text's ids are the ids of its units in turn. Texts whose white space
is not single spaces and line feeds are encoded as a whole. The table of units is bounded (UNITS); a unit that
finds no place is encoded anew each time.
"""

from __future__ import annotations

import re
import struct

import public_tokenizers
from tokenizers import Tokenizer

from tarnline.llm.common import released

UNITS = 400_000
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
STOPS = (".", ",")
_CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space to Python, not to the library


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_LETTER = byte_letters()


def letters(word: str, space: str = "") -> str:
    """A word of letters as a byte-level vocabulary spells it."""
    return space + (word if word.isascii() else "".join(map(_LETTER.__getitem__, word.encode())))


class Units(dict):
    """Ids of units as little-endian unsigned 32-bit integers; encode gives those of a unit not yet there."""

    def __init__(self, encode, limit: int = UNITS):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(unit)
        if len(self) < self.limit:
            self[unit] = ids
        return ids


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class SpacedEncoder:
    """Splits a text at single spaces and line feeds and joins the ids of what lies between.

    plain(unit) encodes a unit without and spaced(word) one with a leading space; whole(text) any other text.
    """

    def __init__(self, plain, spaced, whole):
        self.plain, self.spaced, self.whole = Units(plain, 50_000), Units(spaced), whole

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        white, found = text.count(" ") + text.count("\n"), text.split()
        # As many words as single gaps make, and no other white space than those.
        if len(found) != white + 1 or sum(map(len, found)) + white != len(text):
            return self.whole(text)
        plain, spaced, end, out = self.plain, self.spaced.__getitem__, self.plain["\n"], []
        for line in text.split("\n"):
            words = line.split(" ")
            words[0] = plain[words[0]]
            words[1:] = map(spaced, words[1:])
            words.append(end)
            out += words
        out.pop()
        return b"".join(out)


class ByteBpe:
    """encode(text): as the library's encode(text, add_special_tokens=False) with byte_bpe_50k.json."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.units = SpacedEncoder(self.unit, lambda word: self.unit(word, " "), self.unit_by_library)
        self.encode = self.units.encode

    def unit_by_library(self, text: str) -> bytes:
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def unit(self, word: str, space: str = "") -> bytes:
        if LETTERS.fullmatch(word):
            return packed([t.id for t in self.model.tokenize(letters(word, space and "Ġ"))])
        if word[-1:] in STOPS and LETTERS.fullmatch(word, 0, len(word) - 1):
            return (self.units.spaced if space else self.units.plain)[word[:-1]] + self.units.plain[word[-1]]
        return self.unit_by_library(space + word)


class WordBpe:
    """encode(text): as the library's encode(text, add_special_tokens=False) with word_bpe_49k.json, which drops white space."""

    def __init__(self, name: str = "word_bpe_49k.json"):
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.units = Units(self.unit)

    def encode(self, text: str) -> bytes:
        if any(c in text for c in _CONTROL):
            return self.unit_by_library(text)
        return b"".join(map(self.units.__getitem__, text.split()))

    def unit_by_library(self, text: str) -> bytes:
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def unit(self, unit: str) -> bytes:
        if LETTERS.fullmatch(unit):
            return packed([t.id for t in self.model.tokenize(letters(unit.lower()))])
        if unit[-1:] in STOPS and LETTERS.fullmatch(unit, 0, len(unit) - 1):
            return self.units[unit[:-1]] + self.units[unit[-1]]
        return self.unit_by_library(unit)


_READY: dict[type, object] = {}


def ready(kind: type):
    """One encoder of a kind for each Python worker; others are dropped, so that tables don't add up."""
    if kind not in _READY:
        _READY.clear()
        released()
        _READY[kind] = kind()
    return _READY[kind]
