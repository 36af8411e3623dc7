"""Words of whole batches of texts, split and told apart by Arrow's kernels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at once; a longer text is a part of its own.
PART_BYTES = 1 << 23


@dataclass
class Words:
    """The words between ASCII white space of a part of a batch, in order."""

    index: np.ndarray  # of each word in `distinct`
    counts: np.ndarray  # words of each text
    distinct: pa.StringArray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


def parts_of(texts: pa.Array | pa.ChunkedArray, most: int = PART_BYTES) -> Iterator[pa.Array]:
    """Slices of a batch of about `most` bytes, in order; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        part = texts[first:end]  # a cast of a slice to another string type garbles it
        yield pc.fill_null(part if part.type == pa.string() else pa.array(part.to_pylist(), pa.string()), "")
        first = end


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of about `most` bytes of text in `column`: larger than Spark's where texts are short, smaller where
    they are long. A text that is longer is a batch of its own; null texts are empty."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    for batch in batches:
        at = batch.schema.get_field_index(column)
        first = 0
        for part in parts_of(batch.column(at), most):
            held.append(batch.slice(first, len(part)).set_column(at, pa.field(column, pa.string()), part))
            first, size = first + len(part), size + pc.sum(pc.binary_length(part)).as_py()
            if size >= most:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    """Splits each text at runs of space, tab, line feed, vertical tab, form feed and carriage return. lower: A-Z become
    a-z first."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    counts = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
    distinct = coded.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()  # at the ends of texts
    if empty >= 0:
        kept = index != empty
        texts_of = np.repeat(np.arange(len(counts)), counts)
        index, counts = index[kept], np.bincount(texts_of[kept], minlength=len(counts))
    return Words(index, counts.astype(np.int64), distinct)


def each_bytes(values: pa.Array) -> Iterator[memoryview]:
    """The bytes of the values of a string or binary array, without copies."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].tolist()
    data = memoryview(values.buffers()[2] or b"")
    return (data[a:b] for a, b in zip(ends, ends[1:], strict=False))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other: for each, starts, starts + 1, ..., starts + lengths - 1."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
