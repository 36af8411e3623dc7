"""Tables by key: what collections of layers, tiles and boxes do, as operations on DataFrames that return new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """table with `rows` in place of those of equal keys."""
    return removed(table, rows, *keys).unionByName(rows)


def removed(table: DataFrame, gone: DataFrame, *keys: str, same: Column | None = None) -> DataFrame:
    """table without the rows whose keys are in `gone`. same: a condition of one's own on table and gone in place of
    equal keys; it needs an equality of theirs to be joined by."""
    if same is not None:
        return table.join(gone, same, "left_anti")
    return table.join(gone.select(*keys).distinct(), [*keys], "left_anti")


def held(table: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """wanted with `has`: whether the table holds its keys."""
    there = table.select(*keys).distinct().withColumn("has", F.lit(True))
    return wanted.join(there, [*keys], "left").withColumn("has", F.coalesce("has", F.lit(False)))


def sized(table: DataFrame, *groups: str, size: str | None = None) -> DataFrame:
    """entries (and the sum of `size` as bytes), by group or of all."""
    sums = [F.count(F.lit(1)).alias("entries"), *([F.sum(size).alias("bytes")] if size else [])]
    return table.groupBy(*groups).agg(*sums)


def cleared(table: DataFrame) -> DataFrame:
    return table.where("false")


def tiled(boxes: DataFrame, parts: int) -> DataFrame:
    """boxes (minx, miny, maxx, maxy) laid out for files that prune: strips by the centre's x, each sorted by its y."""
    x, y = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    return boxes.withColumns({"__x": x, "__y": y}).repartitionByRange(parts, "__x").sortWithinPartitions("__y").drop("__x", "__y")


def checked_tiles(tiles: DataFrame, size: int) -> DataFrame:
    """tiles (z, x, y, grid) whose grids have size * size samples at least; a smaller one stops the job."""
    small = F.raise_error(F.concat(F.lit(f"a grid of less than {size} * {size} samples at "), F.concat_ws("/", "z", "x", "y")))
    return tiles.withColumn("grid", F.when(F.size("grid") >= size * size, F.col("grid")).otherwise(small.cast("array<double>")))


def terrain(source: str, exaggeration: float = 1.0) -> dict[str, object]:
    """A terrain's settings, checked: a named source, and an exaggeration that is finite and not below 0."""
    if not source:
        raise ValueError("a terrain needs the name of its source")
    if not 0 <= exaggeration < float("inf"):
        raise ValueError(f"exaggeration {exaggeration} is not finite or below 0")
    return {"source": source, "exaggeration": exaggeration}


def read_through(requests: DataFrame, cache: DataFrame, fetched: DataFrame, now: Column, ttl: float = 0, force: bool = False) -> DataFrame:
    """requests (url, ...) with data, mime and from_cache: a live entry of the cache (url, data, mime, added_at), else what
    was fetched (url, data, mime), else any live entry; data is null where neither has it. force: what was fetched goes
    first."""
    fresh = cache if not ttl else cache.where(now - F.col("added_at") <= ttl)
    kept = fresh.select("url", F.struct("data", "mime").alias("__kept"))
    new = fetched.select("url", F.struct("data", "mime").alias("__new"))
    both = requests.join(kept, "url", "left").join(new, "url", "left")
    first, second = ("__new", "__kept") if force else ("__kept", "__new")
    found = F.coalesce(F.col(first), F.col(second))
    cached = F.col("__kept").isNotNull() & (F.col("__new").isNull() if force else F.lit(True))
    return both.select(*requests.columns, found["data"].alias("data"), found["mime"].alias("mime"), F.when(found.isNotNull(), cached).alias("from_cache"))


def offline_counts(done: DataFrame, *groups: str) -> DataFrame:
    """saved, failed and skipped of read_through() results, by group or of all."""
    return done.groupBy(*groups).agg(F.count_if(~F.col("from_cache")).alias("saved"), F.count_if(F.col("from_cache").isNull()).alias("failed"), F.count_if(F.col("from_cache")).alias("skipped"))
