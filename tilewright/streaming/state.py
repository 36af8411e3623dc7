"""Feature state, cached tiles and event windows, alike on batch and streaming DataFrames where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, width: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of `value` by window and keys. Events later than `late` are left out of a stream."""
    return sliding(events, time, width, width, *keys, late=late)


def sliding(events: DataFrame, time: str, width: str, step: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    made = timed.groupBy(F.window(time, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    made = timed.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def merged_state(changes: DataFrame, keys: list[str], order: list[str], name: str, value: str) -> DataFrame:
    """The state of each feature after all changes: a row of changes sets `name` to `value`, or removes it where value is
    null; a row without a name removes all names set before it. The last change of a name wins. Features all of whose names
    are removed have no row. Two aggregates, the first of which combines on the map side, so that a feature with very many
    changes is no task of its own."""
    at = F.struct(*order)
    last = changes.groupBy(*keys, name).agg(F.max_by(F.struct(value), at).alias("v"), F.max(at).alias("at"))
    entry = F.struct(F.col("at"), F.col(name).alias("name"), F.col(f"v.{value}").alias("value"))
    made = last.groupBy(*keys).agg(F.collect_list(F.when(F.col(name).isNotNull(), entry)).alias("set"), F.max(F.when(F.col(name).isNull(), F.col("at"))).alias("cleared"))
    left = F.filter("set", lambda e: e["value"].isNotNull() & (F.col("cleared").isNull() | (e["at"] > F.col("cleared"))))
    pairs = F.sort_array(F.transform(left, lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"))))
    return made.select(*keys, F.map_from_entries(pairs).alias("state")).where(F.size("state") > 0)


def live(cached: DataFrame, now: Column, ttl: float, added: str = "added_at") -> DataFrame:
    """The entries of a cache whose age is at most ttl (no limit where ttl is 0)."""
    return cached if not ttl else cached.where(now - F.col(added) <= ttl)


def evicted(cached: DataFrame, cache: list[str], key: str, max_entries: int | None = None, max_bytes: int | None = None, added: str = "added_at", size: str = "bytes") -> DataFrame:
    """What stays of each cache when its oldest entries go until both limits hold."""
    newest = Window.partitionBy(*cache).orderBy(F.desc(added), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    counted = cached.withColumns({"__n": F.count(F.lit(1)).over(newest), "__b": F.sum(size).over(newest)})
    fits = F.lit(True)
    if max_entries is not None:
        fits &= F.col("__n") <= max_entries
    if max_bytes is not None:
        fits &= F.col("__b") <= max_bytes
    return counted.where(fits).drop("__n", "__b")
