"""Once-seen and twice-seen Bloom filters over 64-bit hashes, built by all tasks and merged by segments.

Each task fills two bit arrays over the hashes it meets: `once` holds every hash, `twice` those met again. Arrays
merge as twice = twice | other.twice | (once & other.once), once = once | other.once: a hash met by two tasks has all
its bits in both, so the merged twice-seen filter has no false negatives. A false positive only adds a suspect, which
the exact step behind it settles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = 3
SEGMENT = 1 << 16  # bytes
#: One filter never exceeds 2**MAX_BITS bits (64 MiB): beyond, hashes are parted by range and each range has its own.
MIN_BITS, MAX_BITS = 20, 29
BITS_A_HASH = 24


def ranges_for(n_hashes: int, each: int = BITS_A_HASH) -> int:
    """Ranges of hashes, so that a filter of at most 2**MAX_BITS bits has `each` for each hash of its range."""
    return max(1, -(-n_hashes * each >> MAX_BITS))


def range_of(hashes: Column, ranges: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hashes, 40), F.lit(ranges)).cast("int")


def in_range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """range_of() of an array."""
    return (hashes >> np.uint64(40)) % np.uint64(ranges)


def bits_for(n_hashes: int, each: int = BITS_A_HASH) -> int:
    return int(np.clip(np.ceil(np.log2(max(1, n_hashes) * each)), MIN_BITS, MAX_BITS))


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions, one row a probe."""
    step = (hashes >> np.uint64(31)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64((1 << bits) - 1) for k in range(PROBES)])


def holds(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.all(filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1, axis=0)


def fill(filled: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(filled, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7), dtype=np.uint64).astype(np.uint8))


class SeenTwice:
    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.once, self.twice = np.zeros(1 << bits - 3, np.uint8), np.zeros(1 << bits - 3, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        hashes, times = np.unique(hashes, return_counts=True)
        at = probes(hashes, self.bits)
        again = (times > 1) | holds(self.once, at)
        fill(self.twice, at[:, again])
        fill(self.once, at)

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        for k in range(0, len(self.once), SEGMENT):
            if (once := self.once[k : k + SEGMENT]).any():
                yield k // SEGMENT, zlib.compress(once.tobytes(), 1), zlib.compress(self.twice[k : k + SEGMENT].tobytes(), 1)


def twice_seen(parts: DataFrame, bits: int) -> np.ndarray:
    """Merges the segments (segment, once, twice) that tasks gave out; only the bounded twice-seen filter reaches the driver."""

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for segment, *both in batch.itertuples(index=False):
                once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in both)
                if mine := held.get(segment):
                    held[segment] = [mine[0] | once, mine[1] | twice | mine[0] & once]
                else:
                    held[segment] = [once, twice]
        yield pd.DataFrame([(k, zlib.compress(x[1].tobytes(), 1)) for k, x in held.items() if x[1].any()], columns=["segment", "twice"])

    n = max(1, (1 << bits - 3) // SEGMENT)
    whole = np.zeros(1 << bits - 3, np.uint8)
    for segment, twice in parts.repartition(min(n, 64), F.col("segment")).mapInPandas(merged, "segment long, twice binary").toLocalIterator():
        part = np.frombuffer(zlib.decompress(bytes(twice)), np.uint8)
        whole[segment * SEGMENT : segment * SEGMENT + len(part)] = part
    return whole


def filter_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """A plain filter of a column of 64-bit hashes: the tasks' filters merge by segments."""

    def fill_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = SeenTwice(bits)
        for batch in batches:
            fill(seen.once, probes(batch.iloc[:, 0].to_numpy().view(np.uint64), bits))
        seen.twice = seen.once  # all of it is wanted
        yield pd.DataFrame(seen.segments(), columns=["segment", "once", "twice"])

    return twice_seen(hashes.mapInPandas(fill_all, "segment long, once binary, twice binary"), bits)


def maybe_among(ids: DataFrame, hashed: Column) -> Column:
    """A filter that lets through every row whose `hashed` is the hash of one of `ids` (one column of identifiers), and
    few others, so that only those rows of a large table shuffle. The filters of ranges are kept apart, each bounded."""
    n = ids.count()
    ranges = ranges_for(n)
    bits = bits_for(-(-n // ranges))
    hashes = ids.select(F.xxhash64(ids.columns[0]).alias("h"))
    held = [ids.sparkSession.sparkContext.broadcast(filter_of(hashes.where(range_of(F.col("h"), ranges) == k), bits)) for k in range(ranges)]

    def among(k: int) -> Column:
        @F.pandas_udf("boolean")
        def one(hashes: pd.Series) -> pd.Series:
            return pd.Series(holds(held[k].value, probes(hashes.to_numpy().view(np.uint64), bits)))

        return one(hashed)

    found = among(0)
    for k in range(1, ranges):
        found = F.when(range_of(hashed, ranges) == k, among(k)).otherwise(found)
    return found
