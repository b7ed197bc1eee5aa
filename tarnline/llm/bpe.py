"""Byte-level BPE encoding and decoding as a streaming transducer, and back with an incremental byte-to-text machine.

A sequence of tokens is a text's encoding exactly if each two neighbours are the encoding of what they spell
together; call such pairs joinable. So the encoding of every prefix of a run of bytes is the encoding of some shorter
prefix and one joinable token, and is unique. The transducer keeps, for each of the last `lookahead` prefixes, the
token that ends there. Whatever follows, the final encoding passes through one of those prefixes, since no token
is longer than the lookahead; hence every token that all of them share is stable and is emitted. The sufficient
lookahead is computed from the merge list: the length in bytes of the longest token that merges can make. What is kept is
bounded by the lookahead and by the tokens on which its prefixes still differ, not by the text.

Every run of every text goes through the transducer, whatever its length; ids of runs that come again are kept in bounded tables, as are
answers about pairs. Texts are read in pieces: a piece is encoded up to its last safe border between words, and where it has none, as in a
run longer than the piece, runs are fed to the transducer as they come and their ids leave it as they become stable.

Texts are split into runs by the pattern of the vocabulary's pre-tokenizer; added tokens split first. A null text counts as empty
and has no tokens. Empty tables give no rows, and repeated rows or ids come out as often as they go in.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnline.llm.common import slices
from tarnline.llm.tokens import LETTERS, STOPS, SpacedEncoder, Units, byte_letters, packed, ready

#: Fixed value: the pre-tokenizer's pattern, with Unicode's white space written out.
_S = r"\t-\r \x85\xa0  -     　"
CLASSES = tuple(regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", rf"[^{_S}\p{{L}}\p{{N}}]+", f"[{_S}]+"))  # what continues a run, white space last
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
PAIRS = 400_000
PIECE = 1 << 16
HELD = 4096
END = 3
SHORT = tuple(range(END - 1, 0, -1))


class Merges:
    """A vocabulary with its merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        spell = lambda token: bytes(byte[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.spelling = {i: spell(t) for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.token: dict[bytes, int] = {b: i for i, b in self.spelling.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merged = {}
        for rank, (a, b) in enumerate(merges):
            self.merged.setdefault((self.token[spell(a)], self.token[spell(b)]), (rank, self.token[spell(a) + spell(b)]))
        #: Of each token that a merge makes: the first such merge's rank and parts.
        self.made: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, c) in self.merged.items():
            self.made.setdefault(c, (rank, a, b))
        self.lookahead = max(map(len, self.reachable()))
        #: Sizes of the tokens that end in certain bytes, the longest first.
        ends: dict[bytes, set[int]] = {}
        for spelled in self.token:
            if len(spelled) >= END:
                ends.setdefault(spelled[-END:], set(range(1, END))).add(len(spelled))
        self.sizes = {end: tuple(sorted(found, reverse=True)) for end, found in ends.items()}
        self.spelling |= {i: t.encode() for t, i in self.added.items()}
        self._pairs: dict[int, bool] = {}

    def reachable(self) -> set[bytes]:
        """What merges can make, from single bytes on, in the order of the list."""
        made = {bytes([b]) for b in range(256)}
        for (a, b), _ in sorted(self.merged.items(), key=lambda x: x[1][0]):
            if self.spelling[a] in made and self.spelling[b] in made:
                made.add(self.spelling[a] + self.spelling[b])
        return made

    def merge(self, run: bytes) -> list[int]:
        """By definition: the best-ranked pair first, leftmost of equals, until none is left."""
        ids = [self.token[run[k : k + 1]] for k in range(len(run))]
        while len(ids) > 1:
            rank, at, new = min(((*self.merged[p], k) for k, p in enumerate(pairwise(ids)) if p in self.merged), key=lambda x: (x[0], x[2]), default=(None, None, None))
            if rank is None:
                break
            new, at = at, new
            ids[at : at + 2] = [new]
        return ids

    def joinable(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: no merge across the border comes before those that make them.

        The border lies between the right edge of what becomes a and the left edge of what becomes b. Seen backwards from the finished
        tokens, the later of the two last merges at the edges is undone first; each pair of edges met so stood side by side until that
        merge, and must not have had an earlier merge of its own. Of merges of one rank the leftmost goes first.
        """
        key = a << 32 | b
        if (known := self._pairs.get(key)) is None:
            known = self._apart(a, b)
            if len(self._pairs) < PAIRS:
                self._pairs[key] = known
        return known

    def _apart(self, a: int, b: int) -> bool:
        made, merged = self.made, self.merged
        end = (len(merged), 0)  # when the pair at the border stops being side by side: rank, 0 left of it, 1 at it, 2 right of it
        while True:
            across = merged.get((a, b))
            if across is not None and (across[0], 1) < end:
                return False
            left, right = made.get(a), made.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and (left[0], 0) > (right[0], 2):
                end, a = (left[0], 0), left[2]
            else:
                end, b = (right[0], 2), right[1]


class Transducer:
    """Bytes of one run in, stable ids out: feed as often as there are bytes, then finish, which makes it ready for the next run."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._reset()

    def _reset(self) -> None:
        self.data = b""  # what follows the last token emitted
        #: Of each prefix of data: the token that ends there, and where that begins; at 0 the last token emitted, if there is one.
        self.last: list[int | None] = [None]
        self.begin = [0]

    @property
    def held(self) -> int:
        return len(self.last)

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for k in range(0, len(data), self.merges.lookahead):
            self._step(data[k : k + self.merges.lookahead])
            if len(self.data) >= 2 * self.merges.lookahead:
                out += self._stable()
        return out

    def _step(self, part: bytes) -> None:
        sizes, token, joinable, last, begin = self.merges.sizes.get, self.merges.token.get, self.merges.joinable, self.last, self.begin
        data = self.data = self.data + part
        for end in range(len(last), len(data) + 1):
            for size in sizes(data[max(0, end - END) : end], SHORT):
                at = end - size
                if at >= 0 and (t := token(data[at:end])) is not None and ((before := last[at]) is None or joinable(before, t)):
                    last.append(t)
                    begin.append(at)
                    break

    def _stable(self) -> list[int]:
        """The tokens up to the last prefix that all live prefixes share; what lies before it is dropped."""
        n = len(self.data)
        at = set(range(n - self.merges.lookahead + 1, n + 1))
        while len(at) > 1:
            p = max(at)
            at.remove(p)
            at.add(self.begin[p])
        p = at.pop()
        out = self._back(p)
        self.data, self.last = self.data[p:], self.last[p:]
        self.begin = [max(0, b - p) for b in self.begin[p:]]  # of prefixes that do not pass p none is live
        return out

    def _back(self, p: int) -> list[int]:
        out = []
        while p:
            out.append(self.last[p])
            p = self.begin[p]
        return out[::-1]

    def finish(self) -> list[int]:
        out = self._back(len(self.data))
        self._reset()
        return out


class Runs:
    """Text in, ids out, where a run may be longer than any piece: what can't be told yet is held, and of a long run only its last characters."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.machine = encoder, Transducer(encoder.merges)
        self.margin = max([2, *(len(t) + 1 for t in encoder.merges.added)])  # an added token or a contraction may begin there, or after one white space
        self.text, self.more = "", None  # more: what continues the run that the machine is in

    def feed(self, piece: str, final: bool = False) -> bytes:
        self.text += piece
        out = []
        while True:
            if self.more is not None:
                out.append(self._continue(final))
                if self.more is not None:
                    return b"".join(out)
            added = self.encoder.split.search(self.text) if self.encoder.split is not None else None
            stop = added.start() if added else len(self.text)
            known = stop if added or final else stop - self.margin
            at = 0
            for m in PATTERN.finditer(self.text, 0, stop):
                if m.end() > known:
                    if len(m[0]) > HELD + self.margin:
                        self.more = next(c for c in CLASSES if c.match(m[0][-1]))
                        out.append(packed(self.machine.feed(self.text[m.start() : known].encode())))
                        at = known
                    break
                out.append(self.encoder.runs[m[0]])
                at = m.end()
            self.text = self.text[at:]
            if self.more is None:
                if not added:
                    return b"".join(out)
                out.append(packed([self.encoder.merges.added[added[0]]]))
                self.text = self.text[len(added[0]) :]

    def _continue(self, final: bool) -> bytes:
        """Feeds the machine with what the text has more of its run, and finishes it where the run ends."""
        added = self.encoder.split.search(self.text) if self.encoder.split is not None else None
        stop = added.start() if added else len(self.text)
        m = self.more.match(self.text, 0, stop)
        end = m.end() if m else 0
        known = stop if added or final else stop - self.margin
        ended = end <= known
        if not ended:
            end = max(0, known)
        elif self.more is CLASSES[-1] and end < stop:
            end -= 1  # the last white space before something else stands apart
        out = self.machine.feed(self.text[:end].encode())
        self.text = self.text[end:]
        if ended:
            out += self.machine.finish()
            self.more = None
        return packed(out)


class Encoder:
    """encode(text): ids as the tokenizers library has them with add_special_tokens=False, packed; stream() for pieces of text."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        self.merges = Merges(public_tokenizers.path(name))
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.merges.added, key=len, reverse=True))) + ")") if self.merges.added else None
        if any(c.isspace() for t in self.merges.added for c in t):
            raise ValueError("an added token with white space can't be told at borders between words")
        self.machine = Transducer(self.merges)
        self.runs = Units(lambda run: packed(self.run(run.encode())), 50_000)
        self.spaced = SpacedEncoder(self.unit, lambda word: self.unit(word, " "), self.whole)
        self.encode = self.spaced.encode

    def run(self, run: bytes) -> list[int]:
        return self.machine.feed(run) + self.machine.finish()

    def unit(self, word: str, space: str = "") -> bytes:
        """A unit between white space; those of letters, with a stop or without, are one run and need no pattern."""
        if LETTERS.fullmatch(word):
            return packed(self.run((space + word).encode()))
        if word[-1:] in STOPS and LETTERS.fullmatch(word, 0, len(word) - 1):
            return (self.spaced.spaced if space else self.spaced.plain)[word[:-1]] + self.spaced.plain[word[-1]]
        return self.whole(space + word)

    def whole(self, text: str) -> bytes:
        if self.split is None:
            return b"".join(map(self.runs.__getitem__, PATTERN.findall(text)))
        out = []
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                out.append(packed([self.merges.added[part]]))
            elif part:
                out += map(self.runs.__getitem__, PATTERN.findall(part))
        return b"".join(out)

    def stream(self, pieces: Iterable[str]) -> Iterator[bytes]:
        """Ids of the pieces' concatenation, as they become stable.

        A piece's end waits for the next piece from the last place at which a word begins: a white-space character that follows
        another character than white space, if none follows it but a word's. What has no such place goes run by run.
        """
        held, slow = "", None
        for piece in pieces:
            if slow is not None:
                yield slow.feed(piece)
                if slow.more is not None or len(slow.text) > HELD:
                    continue
                held, slow = slow.text, None
            else:
                held += piece
            cut = max(held.rfind(" "), held.rfind("\n"))
            while cut > 0 and (held[cut - 1].isspace() or held[cut + 1 : cut + 2].isspace() or cut + 1 == len(held)):
                cut = max(held.rfind(" ", 0, cut), held.rfind("\n", 0, cut))
            if cut > 0:
                yield self.encode(held[:cut])
                held = held[cut:]
            if len(held) > HELD:
                slow = Runs(self)
                yield slow.feed(held)
                held = ""
        yield slow.feed("", True) if slow is not None else self.encode(held)


class Decoder:
    """decode(blocks of packed ids): text as it becomes certain; bytes that are no UTF-8 give U+FFFD each maximal piece."""

    def __init__(self, merges: Merges):
        self.spelling = merges.spelling

    def decode(self, blocks: Iterable[bytes]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        spell = self.spelling.__getitem__
        for block in blocks:
            yield machine.decode(b"".join(map(spell, np.frombuffer(block, "<u4").tolist())))
        yield machine.decode(b"", True)


def _round_trip(keep: bool, block: int):
    def round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ready(Encoder)
        decoder = Decoder(encoder.merges)
        for batch in batches:
            for run in slices(batch, "text"):
                out: list[list] = [[] for _ in range(5)]
                for text in run.column("text").to_pylist():
                    text = text or ""
                    digest, decoded, n, parts, ids = hashlib.sha256(), hashlib.sha256(), 0, [], []

                    def coded(text: str = text, digest=digest, ids: list = ids) -> Iterator[bytes]:
                        nonlocal n
                        for found in encoder.stream(text[k : k + PIECE] for k in range(0, len(text), PIECE)):
                            n += len(found) // 4
                            digest.update(found)
                            if keep:
                                ids.append(found)
                            yield from (found[k : k + 4 * block] for k in range(0, len(found), 4 * block))

                    for part in decoder.decode(coded()):
                        decoded.update(part.encode())
                        if keep:
                            parts.append(part)
                    row = (n, digest.hexdigest(), decoded.hexdigest(), b"".join(ids), "".join(parts))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
                n = 5 if keep else 3
                cells = [run.column("doc_id"), *(pa.array(c, t) for c, t in zip(out[:n], kinds, strict=False))]
                yield pa.RecordBatch.from_arrays(cells, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: n + 1])

    return round_trip


def encode_decode(docs: DataFrame, keep: bool = True, block: int = 4096) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep, ids (little-endian 32-bit) and decoded.

    One pass where the texts are read, without a shuffle. block: ids decoded at a time.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_round_trip(keep, block), schema)
