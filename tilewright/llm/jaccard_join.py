"""N-gram Jaccard join on parity sketches.

A document is the set of its distinct word n-grams. Each n-gram flips one bit of a sketch, so the Hamming distance of
two sketches is at most the symmetric difference of the sets. Sets that reach the similarity differ in at most d
n-grams, d known from their size band: of d + 1 words of the sketch, one at least must be equal. Words are so wide that
n-grams don't fall together, and are kept as the XOR of their set bits' hashes. Documents meet on equal words, and what
meets is verified on the sets themselves. A word without any bit says nothing; sketches of SPARSE words or more leave
these out: linked sets share about a third of so many words, and all of these would have to be empty (at a similarity of 0.8,
a chance under 1e-12).

Sets that are identical are one class with one representative. Where many representatives meet on a word, each is
verified against the smallest of them, if the Hamming distance of their sketches allows a link; after that only pairs in different components are looked at, their sketches
compared within tasks, and verified where the Hamming distance allows a link. So neither a large group of near copies
nor one of documents that are only alike becomes all of its pairs, and no link between components is lost.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm import bloom
from tilewright.llm.byte_bpe import Recent
from tilewright.llm.components import connected_components
from tilewright.llm.scratch import small_batches, stored
from tilewright.llm.workers import lean

WORD = 64
#: Bits of the filters of repeated sketch words for each word: what a false positive costs is a row that shuffles.
KEY_BITS = 8
KEYS = "n long, k1 long, k2 long, keys array<long>, below binary, own binary"
#: Sketches of so many words don't meet on empty ones.
SPARSE = 64
#: Documents of one block of a sketch word: two blocks are compared by one task.
BLOCK = 512


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Shingles:
    """The n-gram sets of texts, as sorted 64-bit hashes."""

    width: int
    words: Recent = field(default_factory=lambda: Recent(xxhash.xxh3_64_intdigest, 250_000))

    def of(self, text: str | None) -> np.ndarray:
        """A text of fewer words than the width is one n-gram, one without words is the empty set."""
        words = text.encode("utf-8", "replace").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        known = self.words
        hashes = np.array([known[w] for w in words], np.uint64)
        n = len(words) - self.width + 1
        total = np.full(n, self.width, np.uint64)
        for k in range(self.width):
            total = mixed(total ^ hashes[k : k + n])
        return np.unique(total)


@dataclass(frozen=True)
class Bands:
    """Size bands: sets that reach the similarity num / den are in the same band or in neighbouring ones."""

    num: int
    den: int
    starts: tuple[int, ...]

    @staticmethod
    def of(num: int, den: int) -> Bands:
        starts = [1, 2]
        while starts[-1] < 1 << 40:
            starts.append(max(starts[-1] + 1, (starts[-1] - 1) * den // num + 1))
        return Bands(num, den, tuple(starts))

    def differ(self, band: int) -> int:
        """The most n-grams in which linked sets of this band and the next can differ."""
        return (self.starts[band + 1] - 1 + self.starts[band + 2] - 1) * (self.den - self.num) // (self.den + self.num)

    def sketch(self, hashes: np.ndarray, words: int) -> np.ndarray:
        """The parity sketch in `words` 64-bit words."""
        bit = (hashes >> np.uint64(32)) % np.uint64(words) * np.uint64(WORD) + (hashes & np.uint64(WORD - 1))
        odd = np.bincount(bit.astype(np.int64), minlength=words * WORD) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.uint64)

    def prints(self, hashes: np.ndarray, words: int) -> np.ndarray:
        """For each of `words` words of a very wide parity sketch the XOR of its set bits' hashes."""
        word = ((hashes >> np.uint64(32)) % np.uint64(words)).astype(np.int64)
        order = np.argsort(word, kind="stable")
        word, bits = word[order], mixed(hashes)[order]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out = np.zeros(words, np.uint64)
        out[word[first]] = np.bitwise_xor.reduceat(bits, first)
        return out

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """The words of a set's sketches, each hashed with its band and its place."""
        band = self.band(len(hashes))
        out = []
        for low in (band - 1, band):
            if low >= 0 and (most := self.differ(low)):
                place, word = np.arange(most + 1, dtype=np.uint64) + np.uint64(low << 40), self.prints(hashes, most + 1)
                if most + 1 >= SPARSE:
                    place, word = place[word != 0], word[word != 0]
                out.append(mixed(mixed(place) ^ word))
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)

    def band(self, n: int) -> int:
        return bisect_right(self.starts, n) - 1

    def filters(self, hashes: np.ndarray) -> list[bytes]:
        """Smaller parity sketches for the bands that a set is joined in, to compare by Hamming distance: of about four bits
        for each n-gram in which linked sets can differ, so that sets that are only alike are mostly twice too far apart."""
        band = self.band(len(hashes))
        return [self.sketch(hashes, self.differ(low) // 16 + 1).tobytes() if low >= 0 else b"" for low in (band - 1, band)]

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if min(len(a), len(b)) * self.den < max(len(a), len(b)) * self.num:
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)


def signatures(text: Column, width: int, bands: Bands) -> Column:
    """KEYS of each text: the size of its set, the set's digest and its keys."""

    @F.pandas_udf(KEYS)
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return signed(texts, width, bands)

    return made(text)


def signed(texts: Iterator[pd.Series], width: int, bands: Bands) -> Iterator[pd.DataFrame]:
    """signatures() of one task's batches."""
    shingles = Shingles(width)
    for batch in lean(texts):
        out = []
        for x in batch:
            own = shingles.of(x)
            digest = xxhash.xxh3_128_digest(own)
            sketches = (bands.keys(own), *bands.filters(own)) if len(own) else ([], b"", b"")
            out.append((len(own), *np.frombuffer(digest, np.int64), *sketches))
        yield pd.DataFrame(out, columns=["n", "k1", "k2", "keys", "below", "own"])


def _repeated_keys(rows: DataFrame) -> DataFrame:
    """(key, id, n) for the keys that the twice-seen filters hold: one filter for each range of keys."""
    total = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    ranges = bloom.ranges_for(total, KEY_BITS)
    bits = bloom.bits_for(-(-total // ranges), KEY_BITS)

    def of(turn: int) -> DataFrame:
        def own(keys: np.ndarray) -> np.ndarray:
            return keys.view(np.uint64) if ranges == 1 else (x := keys.view(np.uint64))[bloom.in_range(x, ranges) == turn]

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen = bloom.SeenTwice(bits)
            for batch in lean(batches):
                found = [x for x in batch["keys"] if len(x)]
                if found:
                    seen.add(own(np.concatenate(found)))
            yield pd.DataFrame(seen.segments(), columns=["segment", "once", "twice"])

        twice = rows.sparkSession.sparkContext.broadcast(bloom.twice_seen(rows.select("keys").mapInPandas(fill, "segment long, once binary, twice binary"), bits))

        @F.pandas_udf("array<long>")
        def suspects(keys: pd.Series) -> pd.Series:
            return keys.map(lambda x: (y := own(x))[bloom.holds(twice.value, bloom.probes(y, bits))].view(np.int64) if len(x) else x)

        return rows.select(F.explode(suspects("keys")).alias("key"), "id", "n")

    return functools.reduce(DataFrame.union, map(of, range(ranges)))


def _near(pairs: DataFrame, rows: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link: linked sets differ in at most (n_a + n_b) * (den - num) /
    (den + num) n-grams. Only sketches shuffle, so that texts are joined to few more pairs than link."""

    @F.pandas_udf("binary")
    def picked(n: pd.Series, other: pd.Series, below: pd.Series, own: pd.Series) -> pd.Series:
        """The sketch of the band in which a set of n meets one of `other`; null where they don't."""
        out = []
        for n_own, n_other, *both in zip(n.tolist(), other.tolist(), below, own, strict=True):
            band, far = bands.band(n_own), bands.band(n_other)
            out.append(both[band <= far] if abs(band - far) < 2 else None)
        return pd.Series(out, dtype=object)

    @F.pandas_udf("boolean")
    def near(n_a: pd.Series, n_b: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        apart = [(int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count() for x, y in zip(a, b, strict=True)]
        return np.array(apart, np.int64) * (bands.den + bands.num) <= (n_a + n_b) * (bands.den - bands.num)

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    held = rows.where("n > 0").where(bloom.maybe_among(ids, F.xxhash64("id")))
    sketches = stored(held.select("id", "n", "below", "own").distinct(), "near-sketches")
    with_n = pairs.join(sketches.select(F.col("id").alias("a"), F.col("n").alias("n_a")).distinct(), "a")
    with_b = with_n.join(sketches.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "below", "own"), "b")
    with_b = with_b.select("a", "n_a", "b", "n_b", picked("n_b", "n_a", "below", "own").alias("of_b")).where("of_b IS NOT NULL")
    both = with_b.join(sketches.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "below", "own"), ["a", "n_a"])
    return both.where(near("n_a", "n_b", picked("n_a", "n_b", "below", "own"), "of_b")).select("a", "b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. docs: id, text."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = stored(docs.where(bloom.maybe_among(ids, F.xxhash64("id"))), "candidates")
    kind = docs.schema["id"].dataType.simpleString()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, last, own = Shingles(width), None, np.zeros(0, np.uint64)
        for batch in lean(batches):
            good = []
            for a, text_a, text_b in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
                if a != last or text != text_a:
                    last, text, own = a, text_a, shingles.of(text_a)
                good.append(bands.linked(own, shingles.of(text_b)))
            yield batch.loc[good, ["a", "b"]]

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return stored(both.select("a", "b", "text_a", "text_b").mapInPandas(verify, f"a {kind}, b {kind}"), "links")


def _near_apart(labelled: DataFrame, keys: DataFrame, rows: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b) that meet on one of the keys, are in different components, and are near enough by size and by the
    Hamming distance of their sketches. The documents of a key are cut into blocks; a group is two blocks of a key, and
    only near pairs leave it."""
    kind = labelled.schema["id"].dataType.simpleString()

    starts = np.array(bands.starts)

    def close(group: dict[str, np.ndarray], band: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs of one group, both blocks of one key."""
        low = int(band.min())
        sketches = [o if own else u for o, u, own in zip(group["own"], group["below"], (band == low).tolist(), strict=True)]
        words = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
        ids, part, n, side = (group[c] for c in ("id", "component", "n", "side"))
        alone = not side.any()
        for k in np.flatnonzero(side == 0):
            others = np.flatnonzero(((ids > ids[k]) if alone else (side == 1)) & (part != part[k]))
            if len(others):
                near = np.bitwise_count(words[others] ^ words[k]).sum(axis=1, dtype=np.int64) * (bands.den + bands.num) <= (n[others] + n[k]) * (bands.den - bands.num)
                near &= np.minimum(n[others], n[k]) * bands.den >= np.maximum(n[others], n[k]) * bands.num
                hit = ids[others[near]]
                if len(hit):
                    yield np.stack([np.minimum(hit, ids[k]), np.maximum(hit, ids[k])])

    def pairs(rows: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        band = np.searchsorted(starts, rows["n"].to_numpy(), "right") - 1
        columns = {c: rows[c].to_numpy() for c in ("id", "component", "n", "side", "own", "below")}
        found = [x for a, b in zip(at[:-1], at[1:], strict=True) for x in close({c: v[a:b] for c, v in columns.items()}, band[a:b])]
        return pd.DataFrame(np.concatenate(found, axis=1).T if found else [], columns=["a", "b"])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows come sorted by group; the last group of a batch waits for the next batch."""
        waits = None
        for batch in batches:
            rows = batch if waits is None else pd.concat([waits, batch], ignore_index=True)
            group = rows[["key", "i", "j"]].to_numpy()
            at = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            waits = rows.iloc[at[-1] :] if len(at) else rows
            if len(at):
                yield pairs(rows, np.concatenate([[0], at]))
        if waits is not None and len(waits):
            yield pairs(waits, np.array([0, len(waits)]))

    at = labelled.join(keys, "key").withColumn("n_blocks", F.ceil(F.col("total") / BLOCK))
    turns = (
        at.withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
        .select("key", "id", "n", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    )
    full = turns.join(rows.select("id", "below", "own"), "id")
    group = ("key", "i", "j")
    return full.repartition(*group).sortWithinPartitions(*group).mapInPandas(near, f"a {kind}, b {kind}").distinct()


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: id_col, n_shingles and component_id, the smallest identifier reachable by links.

    Words are what stands between ASCII white space, A-Z lower-cased. Two documents link when den * intersection >=
    num * union of their sets of `width`-word shingles; a text of fewer words is one shingle, one without words (null
    and empty too) has no set and links with nothing. Rows that repeat an identifier are linked as one document; a row
    without an identifier has the component of the class of texts it belongs to, null if none. Very long texts are
    used whole. Other columns of docs play no part. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    bands = Bands.of(num, den)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stored(texts.select("id", signatures(F.col("text"), width, bands).alias("s")).select("id", "s.*"), "sketches")
    classes = stored(rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep")), "classes")
    met = stored(_repeated_keys(rows).join(classes.select(F.col("rep").alias("id")), "id", "left_semi"), "met")

    may_link = f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}"
    hubs = met.groupBy("key").agg(F.min("id").alias("a"), F.min_by("n", "id").alias("n_a"), F.max("id").alias("top")).where("a < top").drop("top")
    hubs = stored(hubs, "hubs")  # as a table of its own, so that a join on a very common word can be split
    b = met.select("key", F.col("id").alias("b"), F.col("n").alias("n_b"))
    stars = stored(b.join(hubs, "key").where("b > a").where(may_link).select("a", "b").distinct(), "stars")
    links = _verified(stored(_near(stars, rows, bands), "near"), texts, width, bands)

    inside = connected_components(links)
    labelled = stored(met.join(inside, met["id"] == inside["node"], "left").select("key", "id", "n", F.coalesce("component", "id").alias("component")), "labelled")
    apart = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("total")).where("low < high")
    rest = _near_apart(labelled, stored(apart.select("key", "total"), "apart"), rows, bands).join(stars, ["a", "b"], "left_anti")
    links = links.union(_verified(stored(rest, "rest"), texts, width, bands))

    found = connected_components(links)
    of_class = classes.join(found, F.col("rep") == F.col("node"), "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component"))
    return rows.select("id", "n", "k1", "k2").join(stored(of_class, "of-class"), ["n", "k1", "k2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
