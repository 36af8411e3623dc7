"""Packing token sequences by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most max_len tokens. The histogram of piece lengths (at most max_len rows) goes to
the driver, which places lengths longest first, each into the shortest pack that it fits, working on counts of packing
patterns and never on pieces. A piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.scratch import small_batches, stored
from tilewright.llm.words import gathered, spans, words_of
from tilewright.llm.workers import give_back, kept, lean

#: Ranks are dealt within blocks of the documents, so that no length, however common, is ranked in one task.
BLOCKS = 512
#: Bytes of text that a task encodes at once: its words, ids and their places take some twenty-five times that.
PART_BYTES = 1 << 21


@dataclass
class Remembered:
    """Words and their ids in a few arrays: as objects they would take some ten times the memory."""

    words: pa.BinaryArray
    flat: np.ndarray  # ids of all words
    begins: np.ndarray  # of each word in `flat`
    sizes: np.ndarray

    @staticmethod
    def of(words: pa.BinaryArray, packed: list[bytes]) -> Remembered:
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        return Remembered(words, np.frombuffer(b"".join(packed), "<u4"), np.cumsum(sizes) - sizes, sizes)

    def packed(self, k: int) -> bytes:
        return self.flat[self.begins[k] : self.begins[k] + self.sizes[k]].tobytes()

    def with_more(self, new: Remembered) -> Remembered:
        joined = [np.concatenate(x) for x in ((self.flat, new.flat), (self.begins, new.begins + len(self.flat)), (self.sizes, new.sizes))]
        return Remembered(pa.concat_arrays([self.words, new.words]), *joined)


class ChunkTokenizer:
    """Ids of words. The tokenizer drops white space and never joins across it, so a text's ids are those of its words,
    one after the other. It lower-cases, and it parts letters from what follows them, so a word shares its ids with its
    other forms: in capitals, or before a full stop or comma."""

    #: Words that are encoded as one text; the ids are parted again at the tokens that end a word.
    JOINED = 512
    #: Such texts that are encoded in one call: an encoding takes some hundred bytes a token.
    AT_ONCE = 8

    def __init__(self, path: str, room: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        self.marks = {x: self._alone(x.decode()) for x in (b"", b".", b",")}
        none = Remembered.of(pa.array([], pa.binary()), [])
        self.room, self.known, self.older = room, none, none

    def _alone(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _words(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of words of letters alone, many in one text."""
        groups = [words[k : k + self.JOINED] for k in range(0, len(words), self.JOINED)]
        texts = [b" ".join(g).decode() for g in groups]
        few = (self.tokenizer.encode_batch_fast(texts[k : k + self.AT_ONCE], add_special_tokens=False) for k in range(0, len(texts), self.AT_ONCE))
        for group, found in zip(groups, chain.from_iterable(few), strict=True):
            ids = np.array(found.ids, "<u4")
            last = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(last) != len(group):  # a letter whose lower case is no letter
                yield from (self._alone(w.decode()) for w in group)
                continue
            raw = ids.tobytes()
            yield from map(raw.__getitem__, map(slice, [0, *last], last))

    def _new(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of distinct words that aren't remembered; some are words that are, with a mark after them."""
        found, new, bases = [b""] * len(words), [], {}
        for k, word in enumerate(words):
            mark = word[-1:] if word.endswith((b".", b",")) else b""
            base = word[: len(word) - len(mark)]
            if base.isalpha() or not base.isascii() and (text := base.decode()).isalpha() and text.lower().isalpha():
                new.append((k, base, mark))
                bases[base] = None
            else:
                found[k] = self._alone(word.decode())
        marked = pa.array(list({base for _, base, mark in new if mark}), pa.binary())
        for held in (self.older, self.known):
            at = pc.index_in(marked, value_set=held.words)
            for base, k in zip(marked.to_pylist(), at.to_pylist(), strict=True):
                if k is not None:
                    bases[base] = held.packed(k)
        lacking = [w for w, ids in bases.items() if ids is None]
        bases.update(zip(lacking, self._words(lacking), strict=True))
        for k, base, mark in new:
            found[k] = bases[base] + self.marks[mark]
        return found

    def ids_of(self, words: pa.Array) -> Remembered:
        """The ids of distinct words in lower case (A-Z); frequent ones are remembered, in two generations."""
        words = words.cast(pa.binary())
        if len(self.known.words) > self.room:
            self.older, self.known = self.known, Remembered.of(words[:0], [])
        at, begins, sizes = np.zeros(len(words), bool), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        flats, first = [], 0
        for held in (self.known, self.older):
            place = pc.fill_null(pc.index_in(words, value_set=held.words), -1).to_numpy()
            own = np.flatnonzero((place >= 0) & ~at)
            begins[own], sizes[own], at[own] = held.begins[place[own]] + first, held.sizes[place[own]], True
            flats.append(held.flat)
            first += len(held.flat)
        rest = np.flatnonzero(~at)
        lacking = words.take(pa.array(rest))
        new = Remembered.of(lacking, self._new(lacking.to_pylist()))
        begins[rest], sizes[rest] = new.begins + first, new.sizes
        self.known = self.known.with_more(new)
        return Remembered(words, np.concatenate([*flats, new.flat]), begins, sizes)


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return kept(ChunkTokenizer, path)


def text_ids(texts: pa.Array, tokenizer: ChunkTokenizer, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with end_id after it, and how many each has."""
    words = words_of(texts)
    told = tokenizer.ids_of(words.distinct)
    flat = np.append(told.flat, np.uint32(end_id))
    begins, sizes = np.append(told.begins, len(told.flat)), np.append(told.sizes, 1)
    at = np.insert(words.index.astype(np.int64), np.cumsum(words.counts), len(sizes) - 1)  # an end after each text
    totals = np.add.reduceat(sizes[at], words.starts + np.arange(len(texts)))
    return flat[spans(begins[at], sizes[at])], totals


def cut_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, max_len: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """cut_pieces() of one task's batches (id, text)."""
    tokenizer = chunk_tokenizer(path)
    for batch in gathered(lean(batches, keeps=True), "text", PART_BYTES):
        ids, totals = text_ids(batch["text"], tokenizer, end_id)
        give_back()
        n = -(-totals // max_len)
        of_text = np.repeat(np.arange(len(n)), n)
        start = spans(np.zeros(len(n), np.int64), n) * max_len
        length = np.minimum(max_len, totals[of_text] - start)
        raw, at = memoryview(ids.tobytes()), (np.cumsum(totals) - totals)[of_text] + start
        pieces = [raw[a:b] for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
        told = pa.array([bytes(x) if keep_ids else zlib.crc32(x).to_bytes(4, "big") for x in pieces], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(of_text)), pa.array(totals[of_text]), pa.array(start), pa.array(length), told], ["id", "doc_tokens", "start", "length", "ids"])


def cut_pieces(docs: DataFrame, path: str, end_id: int, max_len: int, keep_ids: bool) -> DataFrame:
    """docs(id, text) -> (id, doc_tokens, start, length, ids), a row for each piece: the ids of each text and end_id
    after them, cut every max_len ids. A null text is empty and has end_id alone. Without keep_ids a piece holds the
    CRC-32 of its ids in four bytes instead of them."""
    cut = functools.partial(cut_batches, path=path, end_id=end_id, max_len=max_len, keep_ids=keep_ids)
    return docs.mapInArrow(cut, f"id {docs.schema['id'].dataType.simpleString()}, doc_tokens long, start long, length long, ids binary")


def pack_histogram(counts: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a pack, longest first) and how many packs have each.

    counts: pieces of each length. Lengths are placed longest first; the packs that a length goes to next are the
    shortest ones, those with the most room. Work and patterns grow with max_len, not with the number of pieces.
    """
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted((r for r in by_room if r >= length), reverse=True):
            if not left:
                break
            placed = []
            packs = by_room.pop(room)
            while packs and left:
                pattern, n = packs.pop()
                fit = room // length
                full, rest = min(n, left // fit), 0
                if full:  # as many of this length as a pack takes
                    placed.append((pattern + (length,) * fit, full))
                    left -= full * fit
                if full < n and 0 < left < fit:
                    placed.append((pattern + (length,) * left, 1))
                    left, rest = 0, 1
                if n - full - rest:
                    packs.append((pattern, n - full - rest))
                    if not left:
                        break
            if packs:
                by_room[room] += packs
            for pattern, n in placed:
                by_room[max_len - sum(pattern)].append((pattern, n))
        if left:
            fit = max_len // length
            full, rest = divmod(left, fit)
            if full:
                by_room[max_len - fit * length].append(((length,) * fit, full))
            if rest:
                by_room[max_len - rest * length].append(((length,) * rest, 1))
    return sorted((p for packs in by_room.values() for p in packs if p[1]), reverse=True)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, ranges of ranks and where they go: rank r in [first, last] is in sequence
    sequence + r - first, at `offset`."""
    rows, given, sequence = [], defaultdict(int), 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, given[length], given[length] + n - 1, sequence, offset))
            given[length] += n
            offset += length
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "last", "sequence", "offset"])


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, max_len: int = 4096, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (packed
    little-endian unsigned 32-bit integers) if keep_ids.

    Every id of every document, with end_id after it, is in exactly one piece, and the pieces of a sequence stand in
    it without gaps from 0. A null text is empty: its document is the one id end_id. Rows that repeat an identifier
    are packed each by itself; a null identifier is kept as null. Other columns of docs play no part. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cut = cut_pieces(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path, end_id, max_len, keep_ids)
    pieces = stored(cut.withColumn("block", F.pmod(F.xxhash64("id", "start"), F.lit(BLOCKS)).cast("int")), "pieces")
    block_counts = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in block_counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = places(pack_histogram(counts, max_len))
    before = block_counts.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    ranked = (
        pieces.withColumn("own", F.row_number().over(Window.partitionBy("length", "block").orderBy("id", "start")) - 1)
        .join(before, ["length", "block"])
        .withColumn("rank", F.col("before") + F.col("own"))
    )
    rooms = {int(n): (g["first"].to_numpy(), g["sequence"].to_numpy(), g["offset"].to_numpy()) for n, g in ranges.groupby("length")}
    held = spark.sparkContext.broadcast(rooms)  # grows with max_len alone

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        for n in length.unique():
            own = (length == n).to_numpy()
            first, sequence, offset = held.value[int(n)]
            ranks = rank.to_numpy()[own]
            k = np.searchsorted(first, ranks, side="right") - 1
            out[own, 0], out[own, 1] = sequence[k] + ranks - first[k], offset[k]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    crc = F.crc32("ids") if keep_ids else F.conv(F.hex("ids"), 16, 10).cast("long")
    return ranked.withColumn("at", placed("length", "rank")).select(
        F.col("id").alias(id_col), "start", "length", crc.alias("ids_crc32"), "doc_tokens", "at.sequence_id", "at.offset", *["ids"] * keep_ids
    )
