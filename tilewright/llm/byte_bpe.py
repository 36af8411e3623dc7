"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can be the last of its encoding: the suffix token that
may stand after the last token of the prefix before it. Storing that token for each prefix gives the encoding of any
prefix by walking back, lets bytes be appended without touching what is stored, and lets an edit keep all that is
before it.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A whole-text split at each space is exact unless a space stands between white space and white space or the end.
_UNEVEN = regex.compile(r"\s (?!\S)")


#: Known pairs of neighbours, chunks and matches that a worker holds at most.
PAIRS, CHUNKS, MATCHES = 1_000_000, 250_000, 250_000


class Vocabulary:
    """Ranks of byte strings, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.longest = max(map(len, ranks), default=0)
        self.left, self.right = list(range(len(self.bytes))), list(range(len(self.bytes)))
        self.merged: dict[tuple[int, int], int] = {}
        self.sound: dict[bytes, int] = {}  # tokens that the merges reach
        self.lengths = [*map(len, self.bytes)]
        self._pairs: dict[int, bool] = {}
        for rank, token in sorted((r, t) for t, r in ranks.items()):
            if len(token) == 1:
                self.sound[token] = rank
                continue
            for k in range(1, len(token)):
                a, b = self.sound.get(token[:k]), self.sound.get(token[k:])
                # only merges of lower ranks are known so far: the halves that they leave apart are this token's
                if a is not None and b is not None and self._apart(a, b):
                    self.left[rank], self.right[rank], self.merged[a, b], self.sound[token] = a, b, rank, rank
                    break

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b as neighbours: undoes the later of the two merges until none is left, and
        looks for a merge across the border that would have come first."""
        before = len(self.bytes)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                return False
            inner_a, inner_b = self.right[a], self.left[b]
            if a > b and inner_a != a:
                before, a = a, inner_a
            elif inner_b != b:
                before, b = b + 1, inner_b
            elif inner_a != a:
                before, a = a, inner_a
            else:
                return True

    def extend(self, last: list[int], piece: bytes) -> None:
        """Fills in the last token of each prefix of piece that `last` lacks."""
        sound, longest, pairs = self.sound.get, self.longest, self._pairs
        known = pairs.get
        for end in range(len(last), len(piece) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = sound(piece[start:end])
                if token is not None:
                    if not start:
                        break
                    pair = last[start] << 32 | token
                    fits = known(pair)
                    if fits is None:
                        if len(pairs) > PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self._apart(last[start], token)
                    if fits:
                        break
            else:
                raise ValueError(f"no token for byte {piece[end - 1]}")
            last.append(token)

    def walk_back(self, last: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= self.lengths[last[end]]
        return out[::-1]


class PrefixTable:
    """The last token of every prefix of one piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b"") -> None:
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Appends bytes: what is stored for shorter prefixes stays."""
        self.piece += more
        self.vocabulary.extend(self.last, self.piece)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replaces piece[start:end]; prefixes up to start keep their tokens."""
        tail = new + self.piece[end:]
        self.piece = self.piece[:start]
        del self.last[start + 1 :]
        self.append(tail)

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix that ends at `end`."""
        return self.vocabulary.walk_back(self.last, len(self.piece) if end is None else end)


class Recent(dict):
    """Remembers make(key) in two generations of `room` keys: those of the older that are not met again go."""

    def __init__(self, make: Callable, room: int) -> None:
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, key: str) -> object:
        found = self.old.get(key)
        return self.put(key, self.make(key) if found is None else found)

    def put(self, key: str, value: object) -> object:
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Encodes texts: every match of the pattern by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.vocabulary, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        self.matches = Recent(self._match, MATCHES)
        self.chunks = Recent(self._chunk, CHUNKS)

    def piece(self, match: str) -> list[int]:
        raw = match.encode("utf-8", "replace")
        whole = self.vocabulary.ranks.get(raw)
        if whole is not None:
            return [whole]
        last = [-1]
        self.vocabulary.extend(last, raw)
        return self.vocabulary.walk_back(last, len(raw))

    def _match(self, match: str) -> bytes:
        return array("I", self.piece(match)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk[1:].isalpha() and chunk[0] == " " and chunk[1:].isascii():
            return self._match(chunk)  # one match of its own
        return b"".join([self.matches[m] for m in self.pattern.findall(chunk)])

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers. Splits at spaces first, so that frequent words
        are looked up once; a text with longer runs of white space is split by the pattern alone."""
        if _UNEVEN.search(text):
            return b"".join([self.matches[m] for m in self.pattern.findall(text)])
        first, *rest = text.split(" ")
        chunks = self.chunks
        return chunks[first] + b"".join([chunks[" " + x] for x in rest])

    def decoded(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class EditableEncoding:
    """The encoding of a text under edits: only matches near an edit are split and encoded again."""

    #: An edit can change how the text before it was split by at most so many matches (contractions, trailing space).
    BACK = 3

    def __init__(self, encoder: Encoder, text: str = "") -> None:
        self.encoder, self.text, self.matches = encoder, "", []
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end] by new."""
        ends = np.cumsum([len(m) for m, _ in self.matches]).tolist()
        begins = [0, *ends[:-1]] if ends else []
        keep = max(0, sum(e <= start for e in ends) - self.BACK)
        at = begins[keep] if keep < len(begins) else (ends[-1] if ends else 0)
        moved = len(new) - (end - start)
        after = {b + moved: k for k, b in enumerate(begins) if b >= end}
        self.text = self.text[:start] + new + self.text[end:]
        fresh = []
        for m in self.encoder.pattern.finditer(self.text, at):
            if m.start() in after and m.start() >= start + len(new):
                self.matches = self.matches[:keep] + fresh + self.matches[after[m.start()] :]
                return
            fresh.append((m[0], self.encoder.piece(m[0])))
        self.matches = self.matches[:keep] + fresh

    def tokens(self) -> list[int]:
        return [*chain.from_iterable(ids for _, ids in self.matches)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(read_ranks(path), pattern)


def bpe_encode(text: Column, path: str, pattern: str) -> Column:
    """The ids of a text as packed little-endian unsigned 32-bit integers; null and empty texts have none. Texts of any
    length are encoded whole; special tokens in a text are ordinary text. path: a rank file present on all machines."""

    @F.pandas_udf("binary")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path, pattern)
        for batch in texts:
            yield pd.Series([own.packed(x) if x else b"" for x in batch], dtype=object)

    return encode(text)


def bpe_decode(packed: Column, path: str, pattern: str) -> Column:
    """The bytes of packed ids; null ids give no bytes."""

    @F.pandas_udf("binary")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path, pattern)
        for batch in ids:
            yield pd.Series([own.decoded(x) if x else b"" for x in batch], dtype=object)

    return decode(packed)


def token_count(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")
