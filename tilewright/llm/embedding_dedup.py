"""Near duplicates among embeddings by spherical-cap filters from random product codes.

Filter directions are sums of one code vector from each of BLOCKS parts of the space, so a vector finds all directions
that it exceeds by list decoding, part by part, without trying them all. Vectors that share a direction meet; what
meets is compared by its cosine in double precision. Identical vectors are one class, compared once.

A pair can meet at several directions; it counts at the smallest of them alone. A direction with many vectors is cut
into blocks, and every two blocks are compared by one matrix product: what comes out is each vector's number of links
and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.components import connected_components
from tilewright.llm.scratch import small_batches, stored

PARTS = 3
SEED = 20240101
#: Filters that a vector meets on average, and at least.
MEAN_FILTERS, LEAST_FILTERS = 24, 6
#: Vectors of one block of a direction: two blocks are compared by one task's matrix product.
BLOCK = 1024


def cap_height(size: int, share: float) -> float:
    """The height above which so small a share of random unit vectors of `size` components lies in a given direction."""
    if size < 3:
        return 0.9
    t = np.linspace(0, 1, 400_001)
    density = np.exp((size - 3) / 2 * np.log1p(-np.minimum(t * t, 1 - 1e-15)))
    above = np.cumsum(density[::-1])[::-1] / density.sum() / 2
    return float(t[np.searchsorted(-above, -share)])


@dataclass
class ProductCode:
    """Code vectors of unit length over sqrt(PARTS) in each part, after a random rotation of the whole space."""

    rotation: np.ndarray
    words: list[np.ndarray]
    cuts: list[int]
    threshold: float

    @staticmethod
    def of(size: int, count: int) -> ProductCode:
        """For `count` vectors of `size` components: about one direction for each four vectors, and a threshold
        which a random unit vector exceeds at MEAN_FILTERS of them."""
        random = np.random.default_rng(SEED)
        rotation = np.linalg.qr(random.standard_normal((size, size)))[0]
        cuts = np.linspace(0, size, PARTS + 1).round().astype(int).tolist()
        own = max(8, round((count / 4) ** (1 / PARTS)))
        words = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            w = random.standard_normal((own, max(1, high - low)))[:, : high - low]
            words.append(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12) / np.sqrt(PARTS))
        return ProductCode(rotation, words, cuts, cap_height(size, min(0.5, MEAN_FILTERS / own**PARTS)))

    def parts(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.rotation
        return [turned[:, low:high] @ w.T for low, high, w in zip(self.cuts, self.cuts[1:], self.words, strict=False)]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each vector the directions that it exceeds by the threshold. Vectors with fewer than LEAST_FILTERS of
        these get a lower threshold, step by step."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(unit)
        todo, threshold = np.arange(len(unit)), self.threshold
        everything = self.parts(unit)
        while len(todo):
            parts = [p[todo] for p in everything]
            best = np.cumsum([p.max(axis=1) for p in parts[::-1]], axis=0)[::-1]
            row, code, sofar = np.arange(len(todo)), np.zeros(len(todo), np.int64), np.zeros(len(todo))
            for k, p in enumerate(parts):
                rest = best[k + 1][row] if k + 1 < len(parts) else 0
                a, b = np.nonzero(sofar[:, None] + p[row] >= (threshold - rest)[:, None] if k + 1 < len(parts) else sofar[:, None] + p[row] >= threshold)
                row, code, sofar = row[a], code[a] * p.shape[1] + b, sofar[a] + p[row[a], b]
            found = np.bincount(row, minlength=len(todo))
            enough = (found >= LEAST_FILTERS) | (threshold <= -1)
            for k, own in zip(np.flatnonzero(enough), np.split(code, np.cumsum(found)[:-1]) if enough.all() else [code[row == k] for k in np.flatnonzero(enough)], strict=True):
                out[todo[k]] = np.sort(own)
            todo, threshold = todo[~enough], threshold - 0.02
        return out


def as_matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in vectors])


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def directions(vector: Column, code: object) -> Column:
    @F.pandas_udf("array<long>")
    def decoded(vectors: pd.Series) -> pd.Series:
        return pd.Series(code.value.decode(unit_rows(as_matrix(vectors))), dtype=object)

    return decoded(vector)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """The smallest index linked to each of n vectors by pairs (a, b), within the block."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [top(x) for x in range(n)]


def linked_in_blocks(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """group: the rows (id, copies, vector, filters, side) of two blocks of one direction, or of one block with itself
    (side 0 alone). Gives id, n_links and root."""
    left = group[group["side"] == 0]
    right = group[group["side"] == 1]
    alone = not len(right)
    right = left if alone else right
    if not len(left):
        return pd.DataFrame({"id": [], "n_links": [], "root": []})
    mine = int(group["direction"].iloc[0])
    unit_l, unit_r = unit_rows(as_matrix(left["vector"])), unit_rows(as_matrix(right["vector"]))
    a, b = np.nonzero(unit_l @ unit_r.T >= threshold)
    if alone:
        a, b = a[a < b], b[a < b]
    # the smallest direction that both share is the one where a pair counts
    fl, fr = left["filters"].to_list(), right["filters"].to_list()
    if len(a):
        before_l = [set(x[x < mine].tolist()) for x in fl]
        before_r = [set(x[x < mine].tolist()) for x in fr]
        first = np.fromiter((before_l[x].isdisjoint(before_r[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
        a, b = a[first], b[first]
    ids = pd.concat([left["id"], right["id"]], ignore_index=True) if not alone else left["id"].reset_index(drop=True)
    copies = np.concatenate([left["copies"].to_numpy(), right["copies"].to_numpy()]) if not alone else left["copies"].to_numpy()
    b = b if alone else b + len(left)
    order = np.argsort(ids.to_numpy(), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    root = np.asarray(_forest(len(ids), place[a], place[b]))
    out = pd.DataFrame({"id": ids, "n_links": links.astype(np.int64), "root": ids.to_numpy()[order[root[place]]]})
    return out[out["n_links"] > 0]


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per input row: id_col, n_links (other rows linked directly), component_id (smallest identifier reachable,
    its own included) and kept (whether that is its own).

    Rows link when the cosine of their vectors, in double precision, is at least the threshold. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths with each
    other. Rows that repeat an identifier are counted as other rows. Rows without an identifier count as links of
    others and have a null component. Other columns play no part. An empty table gives an empty result.
    """
    spark = table.sparkSession
    small_batches(spark)
    v = F.col(vector_col)
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = table.select(F.col(id_col).alias("id"), F.when((F.size(v) > 0) & (squares > 0) & (squares < float("inf")), v).alias("vector"))
    good = stored(rows.where("vector IS NOT NULL").withColumn("digest", F.sha2(F.to_json(F.struct("vector")), 256)), "vectors")
    classes = stored(good.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector")).withColumn("key", F.monotonically_increasing_id()), "classes")
    links = None
    sizes = [(r[0], r[1]) for r in classes.groupBy(F.size("vector")).agg(F.count(F.lit(1))).collect()]
    for size, count in sizes:
        code = spark.sparkContext.broadcast(ProductCode.of(size, count))
        met = classes.where(F.size("vector") == size).select(F.col("key").alias("id"), "copies", "vector", directions(F.col("vector"), code).alias("filters"))
        met = stored(met, "directions")
        at = met.select("id", F.explode("filters").alias("direction"))
        counts = at.groupBy("direction").agg(F.count(F.lit(1)).alias("total"), F.min("id").alias("least")).where("total > 1")
        shared = stored(at.join(counts, "direction").withColumn("n_blocks", F.ceil(F.col("total") / BLOCK)), "shared")
        # a block meets itself and every other block of its direction once: as side 0 with later ones, as side 1 with earlier ones
        block = F.pmod(F.xxhash64("id"), F.col("n_blocks"))
        turns = (
            shared.withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
            .select("direction", "id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
        )
        full = turns.join(met, "id")
        found = full.groupBy("direction", "i", "j").applyInPandas(lambda group: linked_in_blocks(group, threshold), "id long, n_links long, root long")
        found = stored(found, "found")
        links = found if links is None else links.union(found)
    if links is None:
        links = spark.createDataFrame([], "id long, n_links long, root long")
    totals = links.groupBy("id").agg(F.sum("n_links").alias("n"))
    inside = stored(connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b"))), "inside")
    least = inside.join(classes.select(F.col("key").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    of_class = stored(
        classes.select("key", "digest", "rep", "copies")
        .join(totals, F.col("key") == F.col("id"), "left")
        .join(inside, F.col("key") == F.col("node"), "left")
        .join(least, "component", "left")
        .select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component")),
        "classes",
    )
    told = good.select("id", "digest").join(of_class, "digest").select("id", "n_links", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
    lone = rows.where("vector IS NULL").select("id", F.lit(0).cast("long"), "id")
    return told.union(lone).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
