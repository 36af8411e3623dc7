"""Line dedup: lines found in several documents stay only in the first of them.

One pass over the texts writes 16-byte digests of their lines. Once-seen and twice-seen Bloom filters are filled with
them, a pair of filters for each range of hashes, so that no filter grows with the corpus; digests that the twice-seen
filter holds are suspects. Suspects alone shuffle, for exact confirmation and the choice of the first document. Only
texts that lose a line are shuffled and rebuilt.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import bloom
from tilewright.llm.scratch import small_batches, stored
from tilewright.llm.workers import lean

#: The filters are sized for lines of so many bytes; shorter lines only make more suspects.
LINE_BYTES = 100


def key_digests(text: str, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text in UTF-8 and, for each whose key is long enough, the 128-bit digest of the key."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    keys = [x.strip().lower() for x in lines]  # of bytes: ASCII white space and A-Z only
    digest, sure = xxhash.xxh3_128_digest, 4 * min_chars
    return lines, [digest(k) if len(k) >= sure or len(k) >= min_chars and len(k.decode("utf-8", "surrogatepass")) >= min_chars else None for k in keys]


def as_longs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, counts: bool = True) -> DataFrame:
    """docs with text_col rebuilt and columns n_lines (before) and n_dropped added (columns of these names are replaced).
    Without counts these two are not added, and columns of docs that have their names stay.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at least min_chars code
    points that is found under two or more identifiers loses all its lines except under the smallest identifier.
    Null and empty texts are one empty line. Rows that repeat an identifier are one document. Rows without an
    identifier pass unchanged and take no lines from others. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col("id").isNotNull())
    size = texts.agg(F.sum(F.octet_length("text") + LINE_BYTES)).first()[0] or 0
    ranges = bloom.ranges_for(size // LINE_BYTES)
    bits = bloom.bits_for(size // LINE_BYTES // ranges)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in lean(batches):
            owners, found = [], []
            for k, text in zip(batch["id"], batch["text"], strict=True):
                own = {*key_digests(text, min_chars)[1]} - {None}
                owners += [k] * len(own)
                found += own
            keys = as_longs(found).view(np.int64)
            yield pd.DataFrame({"id": pd.Series(owners, dtype=batch["id"].dtype), "k1": keys[:, 0], "k2": keys[:, 1]})

    seen = texts.mapInPandas(digests, f"id {kind}, k1 long, k2 long").withColumn("range", bloom.range_of(F.col("k1"), ranges))
    seen = stored(seen, "line-digests", by="range")
    suspected = [_suspects(seen.where(F.col("range") == k).drop("range"), bits) for k in range(ranges)]
    suspected = functools.reduce(DataFrame.union, suspected)
    repeated = suspected.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    repeated = stored(repeated, "repeated")  # as a table of its own, so that a join on a very common line can be split
    drops = (
        suspected.join(repeated, ["k1", "k2"])
        .where("id > first")
        .groupBy(F.col("id").alias("__drop_id"))
        .agg(F.collect_set(F.struct("k1", "k2")).alias("__drops"))
    )
    drops = stored(drops, "drops")

    @F.pandas_udf("text string, n_dropped long")
    def rebuilt(text: pd.Series, k1: pd.Series, k2: pd.Series) -> pd.DataFrame:
        out = []
        for x, a, b in zip(text, k1, k2, strict=True):
            if a is None:
                out.append((x, 0))
                continue
            gone = {d.tobytes() for d in np.stack([a, b], axis=1)}
            lines, keys = key_digests(x, min_chars)
            kept = [line for line, key in zip(lines, keys, strict=True) if key not in gone]
            out.append((b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_dropped"])

    told = docs.withColumns({"__text": F.coalesce(F.col(text_col), F.lit("")), "__loses": bloom.maybe_among(drops.select("__drop_id"), F.xxhash64(id_col))})
    told = told.withColumn("__n_lines", (F.length("__text") - F.length(F.replace("__text", F.lit("\n"))) + 1).cast("long"))
    joined = told.where("__loses").join(drops, F.col(id_col) == F.col("__drop_id"), "left")
    made = joined.withColumn("__made", rebuilt("__text", F.col("__drops.k1"), F.col("__drops.k2")))
    columns = lambda text, gone: [
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")],
        *[F.col("__n_lines").alias("n_lines"), gone.alias("n_dropped")] * counts,
    ]
    whole = told.where("NOT __loses").select(*columns(F.col("__text"), F.lit(0).cast("long")))
    return whole.union(made.select(*columns(F.col("__made.text"), F.col("__made.n_dropped"))))


def _suspects(seen: DataFrame, bits: int) -> DataFrame:
    """The rows (id, k1, k2) of one range of hashes whose k1 the range's twice-seen filter holds."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = bloom.SeenTwice(bits)
        for batch in batches:
            filters.add(batch["k1"].to_numpy(np.int64).view(np.uint64))
        yield pd.DataFrame(filters.segments(), columns=["segment", "once", "twice"])

    twice = seen.sparkSession.sparkContext.broadcast(bloom.twice_seen(seen.select("k1").mapInPandas(fill, "segment long, once binary, twice binary"), bits))

    @F.pandas_udf("boolean")
    def again(k1: pd.Series) -> pd.Series:
        return pd.Series(bloom.holds(twice.value, bloom.probes(k1.to_numpy(np.int64).view(np.uint64), bits)))

    found = stored(seen.where(again("k1")), "suspects")
    twice.destroy()
    return found
