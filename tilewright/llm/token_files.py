"""Token ids in files, each compressed by a grammar of its pairs (Re-Pair).

A file is a row of blocks, and a block holds some pieces of documents, one after the other. In each round the pairs that
stand often enough in the block's sequence are replaced by new symbols, more frequent ones first where they overlap;
the count that is enough falls from round to round. A block stores its rules and how many ids each stands for, so that any
stretch can be decoded without the rest. Documents stand in the order of their identifiers, over all files.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.packing import chunk_tokenizer, text_ids
from tilewright.llm.scratch import new_folder, small_batches, stored
from tilewright.llm.words import gathered, spans

#: Ids of a block, and about how many bytes of text a task writes to its file.
BLOCK_IDS, FILE_BYTES = 1 << 18, 16 << 20
#: Times that a pair must stand in a sequence: a rule costs as much as it saves there.
LEAST = 8
#: From round to round the count that is enough becomes so many times less.
FEWER = 4
#: The rounds end when one shortens the sequence by less than this share.
WORTH = 1 / 256
#: A block: MAGIC, bytes of the block after this header, pieces, ids, first new symbol, rules, symbols, bytes of a symbol.
MAGIC, HEADER = b"RPB1", struct.Struct("<4sQIQIIIB")
SENT_BYTES = 8 << 20
FILE = "folder string, file string, part long, n_documents long, n_ids long, stored_bytes long"


def replace_pairs(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, rules, first): the ids with pairs replaced. Symbol first + k stands for the pair rules[k], whose symbols
    are smaller."""
    first = int(ids.max()) + 1 if len(ids) else 0
    sequence, rules, symbol, enough = ids.astype(np.uint64), [], first, None
    while len(sequence) > 1:
        keys = sequence[:-1] << np.uint64(32) | sequence[1:]
        slots = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).view(np.int64)
        bounds = np.bincount(slots, minlength=1 << 18)  # of pairs that share a slot
        enough = max(least, (int(bounds.max()) if enough is None else enough) // FEWER)
        at = np.flatnonzero((bounds >= enough)[slots])
        pairs, own, counts = np.unique(keys[at], return_inverse=True, return_counts=True)
        often = np.flatnonzero(counts >= enough)
        rank = np.full(len(counts), len(counts))
        rank[often[np.argsort(-counts[often], kind="stable")]] = np.arange(len(often))
        ranks = rank[own]
        at, ranks = at[ranks < len(counts)], ranks[ranks < len(counts)]
        beside = np.diff(at) == 1
        same = np.flatnonzero(beside & (ranks[1:] == ranks[:-1])) + 1  # one symbol again and again
        if len(same):
            begins = np.r_[True, np.diff(same) > 1]
            odd = (same - same[begins][np.cumsum(begins) - 1]) % 2 == 0
            ranks[same[odd]] = len(counts)  # every other pair of it
        less = ranks < len(counts)
        less[1:] &= ~beside | (ranks[1:] < ranks[:-1])
        less[:-1] &= ~beside | (ranks[:-1] < ranks[1:])
        taken, chosen = at[less], ranks[less]
        times = np.bincount(chosen, minlength=len(often))
        worth = np.flatnonzero(times >= least)
        number = np.full(len(often), -1)
        number[worth] = symbol + np.arange(len(worth))
        taken, chosen = taken[number[chosen] >= 0], chosen[number[chosen] >= 0]
        by_rank = np.empty(len(often), np.int64)
        by_rank[rank[often]] = often
        rules.append(pairs[by_rank[worth]])
        symbol += len(worth)
        sequence[taken] = number[chosen]
        sequence = np.delete(sequence, taken + 1)
        if enough == least and len(taken) <= WORTH * len(sequence):
            break
    flat = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    return sequence.astype("<u4"), np.stack([flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)], axis=1).astype("<u4"), first


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for."""
    lengths = [1] * first
    for left, right in rules.tolist():
        lengths.append(lengths[left] + lengths[right])
    return np.array(lengths[first:], "<u4")


@dataclass
class Block:
    ids: np.ndarray  # identifiers of the documents that the pieces are of; 0 where there is none
    known: np.ndarray  # whether there is one
    begins: np.ndarray  # of each piece in its document
    sizes: np.ndarray  # ids of each piece
    first: int
    rules: np.ndarray
    lengths: np.ndarray  # ids that each rule stands for
    symbols: np.ndarray

    def to_bytes(self) -> bytes:
        top = self.first + len(self.rules)
        width = 2 if top <= 1 << 16 else 3 if top <= 1 << 24 else 4
        symbols = self.symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
        body = [x.tobytes() for x in (self.ids.astype("<i8"), self.known.astype("u1"), self.begins.astype("<u8"), self.sizes.astype("<u4"), self.rules.astype("<u4"), self.lengths.astype("<u4"), symbols)]
        size = sum(map(len, body))
        return HEADER.pack(MAGIC, size, len(self.ids), int(self.sizes.sum()), self.first, len(self.rules), len(self.symbols), width) + b"".join(body)

    @classmethod
    def read(cls, stream: io.RawIOBase) -> Block | None:
        """The next block of a file; None at its end."""
        head = stream.read(HEADER.size)
        if not head:
            return None
        magic, size, pieces, n, first, rules, symbols, width = HEADER.unpack(head) if len(head) == HEADER.size else (b"",) * 8
        body = stream.read(size) if magic == MAGIC else b""
        if magic != MAGIC or len(body) != size:
            raise ValueError("no whole block where one should be")
        at = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, count, at)
            at += out.nbytes
            return out

        parts = take("<i8", pieces), take("u1", pieces).astype(bool), take("<u8", pieces).astype(np.int64), take("<u4", pieces).astype(np.int64)
        told = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        raw = np.zeros((symbols, 4), np.uint8)
        raw[:, :width] = take("u1", symbols * width).reshape(-1, width)
        block = cls(*parts, first, *told, raw.view("<u4").ravel())
        if int(block.sizes.sum()) != n:
            raise ValueError("a block's pieces don't add up")
        return block

    def _sizes(self) -> np.ndarray:
        return np.concatenate([np.ones(self.first, np.int64), self.lengths.astype(np.int64)])

    def decoded(self) -> np.ndarray:
        """All ids: each rule's are put together once, rules of rules after those, and then those of the sequence."""
        sizes = self._sizes()
        starts = np.arange(len(sizes))
        depth = [0] * self.first
        for left, right in self.rules.tolist():
            depth.append(1 + max(depth[left], depth[right]))
        pool, deep = np.arange(self.first, dtype="<u4"), np.array(depth[self.first :], np.int64)
        for level in range(1, int(deep.max(initial=0)) + 1):
            own = np.flatnonzero(deep == level)
            starts[self.first + own] = len(pool) + np.cumsum(sizes[self.first + own]) - sizes[self.first + own]
            both = self.rules[own].ravel()
            pool = np.concatenate([pool, pool[spans(starts[both], sizes[both])]])
        return pool[spans(starts[self.symbols], sizes[self.symbols])]

    def ids_at(self, begin: int, end: int) -> np.ndarray:
        """The ids from begin to end of the block alone, by the expansion lengths: only the symbols that lie there are
        taken apart, and of their rules only the sides that do."""
        sizes = self._sizes()
        ends = np.cumsum(sizes[self.symbols])
        begin, end = max(begin, 0), min(end, int(ends[-1]) if len(ends) else 0)
        out: list[int] = []
        if begin >= end:
            return np.array(out, "<u4")
        low, high = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left") + 1
        at = int(ends[low] - sizes[self.symbols[low]])
        todo = self.symbols[low:high].tolist()[::-1]
        while todo:
            symbol = todo.pop()
            size = int(sizes[symbol])
            if at >= end or at + size <= begin:
                at += size
            elif symbol < self.first:
                out.append(symbol)
                at += 1
            else:
                left, right = self.rules[symbol - self.first].tolist()
                todo += [right, left]
        return np.array(out, "<u4")


def made_block(pieces: list[tuple[int | None, int, np.ndarray]]) -> Block:
    """A block of pieces (document, where the piece begins in it, ids)."""
    symbols, rules, first = replace_pairs(np.concatenate([p[2] for p in pieces]))
    ids, begins, sizes = [p[0] for p in pieces], [p[1] for p in pieces], [len(p[2]) for p in pieces]
    return Block(np.array([k or 0 for k in ids]), np.array([k is not None for k in ids]), np.array(begins), np.array(sizes), first, rules, expansion_lengths(rules, first), symbols)


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block_ids: int = BLOCK_IDS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes whole texts and writes their ids, end_id after each document, in ascending order of id_col (integers);
    returns a row for each file: folder, file, part (the files' order), n_documents, n_ids, stored_bytes.

    Rows that repeat an identifier are documents of their own, in an order that their texts fix; those without an
    identifier come first. A null or empty text is the one id end_id. Other columns play no part. An empty table writes no
    file. A document is cut over blocks where it doesn't fit, but lies in one file. Files are named by stage, partition and
    attempt, and only those returned count: what a lost executor left is never read.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    small_batches(spark)
    folder = new_folder(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("row")]  # row: many equal rows go to several files

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        context, tokenizer = TaskContext.get(), chunk_tokenizer(path)
        name = f"{base}/{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}.ids"
        documents = n_ids = size = held = 0
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        out = None
        try:
            for batch in gathered(batches, "text"):
                ids, totals = text_ids(batch["text"], tokenizer, end_id)
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                documents, n_ids, at = documents + len(totals), n_ids + len(ids), 0
                for key, total in zip(batch["id"].to_pylist(), totals.tolist(), strict=True):
                    begin = 0
                    while begin < total:
                        piece = ids[at + begin : at + min(total, begin + block_ids - held)]
                        pieces.append((key, begin, piece))
                        begin, held = begin + len(piece), held + len(piece)
                        if held == block_ids:
                            size += out.write(made_block(pieces).to_bytes())
                            pieces, held = [], 0
                    at += total
            if pieces:
                size += out.write(made_block(pieces).to_bytes())
        finally:
            if out is not None:
                out.close()
        if documents:
            yield pa.RecordBatch.from_pylist([{"folder": folder, "file": name, "part": context.partitionId(), "n_documents": documents, "n_ids": n_ids, "stored_bytes": size}])

    parts = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)
    return stored(parts.select("id", "text").mapInArrow(write, FILE), "token-index")


def with_starts(files: DataFrame, together: int = 1024) -> DataFrame:
    """files with start, the ids of all files before: running sums within groups of files, and over the groups."""
    grouped = files.withColumn("__group", F.floor(F.col("part") / together))
    sums = grouped.groupBy("__group").agg(F.sum("n_ids").alias("__ids"))
    before = sums.select("__group", (F.sum("__ids").over(Window.orderBy("__group")) - F.col("__ids")).alias("__before"))
    own = F.sum("n_ids").over(Window.partitionBy("__group").orderBy("part")) - F.col("n_ids")
    return grouped.withColumn("start", own).join(before, "__group").withColumn("start", F.col("start") + F.col("__before")).drop("__group", "__before")


def read_token_files(files: DataFrame) -> DataFrame:
    """The documents of the files that write_token_files() returned -> id, start (ids of all documents before), n_tokens,
    ids (little-endian unsigned 32-bit integers). A file is read block by block by one task."""
    from pyarrow import fs

    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def rows(file: str, start: int) -> Iterator[tuple]:
        """The documents of a file; one that is cut over blocks is held until its last piece."""
        store = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
        held: tuple | None = None
        with store.open_input_stream(file, compression=None) as stream:
            while (block := Block.read(stream)) is not None:
                raw, at = memoryview(block.decoded().astype("<u4").tobytes()), 0
                for key, known, begin, size in zip(block.ids.tolist(), block.known.tolist(), block.begins.tolist(), block.sizes.tolist(), strict=True):
                    piece = raw[4 * at : 4 * (at + size)]
                    at += size
                    if begin:
                        held[1].append(piece)
                    else:
                        if held:
                            yield held
                        held = key if known else None, [piece]
        if held:
            yield held

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                out, size = [], 0
                for key, pieces in rows(file, start):
                    raw = b"".join(pieces)
                    out.append((key, start, len(raw) // 4, raw))
                    start, size = start + len(raw) // 4, size + len(raw)
                    if size > SENT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    folder = (files.select("folder").first() or [""])[0]
    tasks = max(1, files.count())  # a number of its own: the rows are so few bytes that all would become one task
    return with_starts(files).select("file", "start").repartitionByRange(tasks, "file").mapInArrow(read, "id long, start long, n_tokens long, ids binary")
