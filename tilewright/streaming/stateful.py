"""State kept by key over streams: features' state, throttling by the calls' own times, and caches with limits.

All of these need the RocksDB state store (see STORE) and give the same results however the stream is cut into batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tilewright.operators.shared import new_folder
from tilewright.streaming.events import fired

#: The setting that transformWithState needs, and its value.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: A cache of at most so many entries for each new one is read whole, many entries a call; of larger ones each new key is
#: looked up by a call of its own.
WALKED = 8


class _FeatureStates(StatefulProcessor):
    """Names of a feature -> value and the order of its last change, removals too; and the order of the last clearing."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", "name string", "value string, at long", self.ttl)
        self.cleared = handle.getValueState("cleared", "at long", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.names.iterator()}
        before = clear = self.cleared.get()[0] if self.cleared.exists() else None
        changed = {}
        for batch in rows:
            for name, value, at in zip(batch["name"], batch["value"], batch["at"].tolist(), strict=True):
                if name is None:
                    clear = at if clear is None else max(clear, at)
                elif name not in held or at >= held[name][1]:
                    held[name] = changed[name] = (value, at)
        for name, entry in changed.items():
            if clear is None or entry[1] > clear:
                self.names.updateValue((name,), entry)
        if clear != before:
            self.cleared.update((clear,))
            for name, entry in [*held.items()]:
                if entry[1] <= clear:
                    del held[name]
                    if self.names.containsKey((name,)):
                        self.names.removeKey((name,))
        now = {n: v for n, (v, at) in held.items() if v is not None and (clear is None or at > clear)}
        yield pd.DataFrame({"feature": [key[0]], "names": [sorted(now)], "held": [[now[n] for n in sorted(now)]]})

    def close(self) -> None:
        pass


def feature_states(changes: DataFrame, feature: str, name: str, value: str, order: str, ttl_ms: int | None = None) -> DataFrame:
    """The state of each feature over a stream of changes (feature string, name string, value string, order long): each
    change sets `name`, or removes it where value is null; a change without a name removes all. The change of the largest
    order wins, in whatever batch it comes. Gives feature and its state, a map, after each batch that changes it. ttl_ms:
    names that haven't changed for so long (of processing time) are forgotten, and such a query runs until it is stopped;
    without it removed names leave a mark each until the next clearing."""
    rows = changes.select(F.col(feature).alias("feature"), F.col(name).alias("name"), F.col(value).cast("string").alias("value"), F.col(order).cast("long").alias("at"))
    mode = "None" if ttl_ms is None else "ProcessingTime"
    made = rows.groupBy("feature").transformWithStateInPandas(_FeatureStates(ttl_ms), "feature string, names array<string>, held array<string>", "Update", mode)
    return made.select("feature", F.map_from_arrays("names", "held").alias("state"))


class _Throttle(StatefulProcessor):
    """Calls that the watermark hasn't reached yet; until when none may go through, and the one that waits for it. Times
    are microseconds; those of timers and of the watermark are milliseconds."""

    def __init__(self, span_ms: int, trailing: bool) -> None:
        self.span, self.trailing = span_ms * 1000.0, trailing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, value string")
        self.gate = handle.getValueState("gate", "until double, waiting_at long, waiting string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(at), v) for batch in rows for at, v in zip(batch["at"], batch["value"], strict=True)]
        self.pending.appendList(new)
        self.handle.registerTimer(-(-min(at for at, _ in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        horizon = timerValues.getCurrentWatermarkInMs() * 1000
        pending = sorted((tuple(x) for x in self.pending.get()), key=lambda x: x[0]) if self.pending.exists() else []
        due, later = [x for x in pending if x[0] <= horizon], [x for x in pending if x[0] > horizon]
        until, waiting = -np.inf, None
        if self.gate.exists():
            until, waiting_at, text = self.gate.get()
            waiting = None if waiting_at is None else (waiting_at, text)
        calls = [waiting, *due] if waiting else due  # what waits came before `until`, so it waits again or gives way
        places, at, until, left = fired(np.array([x[0] for x in calls], float), until, self.span, self.trailing)
        if left is not None and until <= horizon:  # nothing before its time can still come
            places, at, until, left = [*places, left], [*at, until], until + self.span, None
        if due:
            self.pending.put(later) if later else self.pending.clear()
        held = (None, None) if left is None else calls[left]
        self.gate.update((float(until), *held))
        timers = [later[0][0]] if later else []
        if left is not None:
            timers.append(int(until))
        if timers:
            self.handle.registerTimer(max(-(-min(timers) // 1000), horizon // 1000 + 1))
        if places:
            yield pd.DataFrame({"key": [key[0]] * len(places), "value": [calls[k][1] for k in places], "at": [calls[k][0] for k in places], "fired_at": at})

    def close(self) -> None:
        pass


def throttled_by_time(calls: DataFrame, key: str, time: str, value: str, span_ms: int, late: str = "1 minute", trailing: bool = True) -> DataFrame:
    """What events.throttled() lets through of a stream (key string, time timestamp, value string), by the calls' own times:
    key, value, at and fired_at (both timestamps). A call is judged when the watermark passes it, so calls may come up to
    `late` out of order; later ones are dropped. Timers are set for the end of the span and not moved by later calls."""
    rows = calls.select(F.col(key).alias("key"), F.col(time).alias("__time"), F.col(value).cast("string").alias("value")).withWatermark("__time", late)
    made = rows.select("key", F.unix_micros("__time").alias("at"), "value", "__time").groupBy("key")
    out = made.transformWithStateInPandas(_Throttle(span_ms, trailing), "key string, value string, at long, fired_at double", "Append", "EventTime")
    return out.select("key", "value", F.timestamp_micros("at").alias("at"), F.timestamp_micros(F.col("fired_at").cast("long")).alias("fired_at"))


def asked_once_stream(requests: DataFrame, url: str, time: str, span_ms: int = 60_000, late: str = "1 minute") -> DataFrame:
    """events.asked_once() over a stream (url string, time timestamp): url and at of the requests that are let through."""
    return throttled_by_time(requests, url, time, url, span_ms, late, trailing=False).select(F.col("key").alias(url), F.col("at").alias(time))


class _Cache(StatefulProcessor):
    """Keys of a cache -> when added and bytes, and the sums of both limits."""

    def __init__(self, max_entries: int | None, max_bytes: int | None, ttl: int | None) -> None:
        self.max_entries, self.max_bytes, self.ttl = max_entries, max_bytes, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "added long, bytes long")
        self.sums = handle.getValueState("sums", "entries long, bytes long, newest long, oldest long")

    def _held(self) -> dict[str, tuple[int, int]]:
        return {k[0]: tuple(v) for k, v in self.entries.iterator()}

    def _over(self, n: int, size: int) -> bool:
        return (self.max_entries is not None and n > self.max_entries) or (self.max_bytes is not None and size > self.max_bytes)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, size, newest, oldest = self.sums.get() if self.sums.exists() else (0, 0, None, None)
        new = {}
        for batch in rows:
            for k, added, own in zip(batch["key"], batch["added"].tolist(), batch["bytes"].tolist(), strict=True):
                if k not in new or added >= new[k][0]:
                    new[k] = (added, own)
        held = self._held() if 0 < n <= WALKED * len(new) else None if n else {}
        for k, (added, own) in [*new.items()]:
            old = held.get(k) if held is not None else self.entries.getValue((k,)) if self.entries.containsKey((k,)) else None
            if old is not None and old[0] > added:
                del new[k]
                continue
            n, size = n + (old is None), size + own - (0 if old is None else old[1])
            newest, oldest = (added, added) if newest is None else (max(newest, added), min(oldest, added))
        gone = {}
        if self._over(n, size) or (self.ttl is not None and newest is not None and newest - oldest > self.ttl):
            held = self._held() if held is None else held
            oldest = newest
            for added, k, own in sorted((added, k, own) for k, (added, own) in (held | new).items()):
                if self.ttl is not None and newest - added > self.ttl:
                    gone[k] = ("expired", added, own)
                elif self._over(n, size):
                    gone[k] = ("evicted", added, own)
                else:
                    oldest = added
                    break
                n, size = n - 1, size - own
            lost = [k for k in gone if k in held]
            if lost and len(lost) == len(held):
                self.entries.clear()
            else:
                for k in lost:
                    self.entries.removeKey((k,))
        for k, entry in new.items():
            if k not in gone:
                self.entries.updateValue((k,), entry)
        self.sums.update((n, size, newest, oldest))
        out = [(k, "put", *v) for k, v in new.items() if k not in gone] + [(k, *v) for k, v in gone.items()]
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["cache", "key", "change", "added", "bytes"])

    def close(self) -> None:
        pass


def cache_changes(puts: DataFrame, cache: str, key: str, added: str, size: str, max_entries: int | None = None, max_bytes: int | None = None, ttl: int | None = None) -> DataFrame:
    """A stream of entries put into caches (cache string, key string, added long, size long) -> cache, key, change, added,
    bytes after each batch: put, evicted (the oldest, while a limit is passed) or expired (older than ttl before the newest
    of its cache). An entry that goes in the batch it came in is told as gone alone. A cache whose limits hold isn't walked
    through; one that passes them is walked oldest first."""
    rows = puts.select(F.col(cache).alias("cache"), F.col(key).alias("key"), F.col(added).cast("long").alias("added"), F.col(size).cast("long").alias("bytes"))
    return rows.groupBy("cache").transformWithStateInPandas(_Cache(max_entries, max_bytes, ttl), "cache string, key string, change string, added long, bytes long", "Append", "None")


def replayed(table: DataFrame, by: str, parts: int) -> DataFrame:
    """A table as a stream that comes in about `parts` batches, in ascending order of `by`: written to the shared folder as
    files, and read one file a batch."""
    spark = table.sparkSession
    folder = new_folder(spark, "replayed")
    for k, rows in enumerate(_ranges(table, by, parts)):  # one after the other: a stream reads files by their age
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/{k:05d}")
    stream = spark.newSession()
    stream.conf.set(*STORE)
    return stream.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*")


def _ranges(table: DataFrame, by: str, parts: int) -> Iterator[DataFrame]:
    cuts = sorted(set(table.select(F.percentile_approx(by, [k / parts for k in range(1, parts)])).first()[0] or [])) if parts > 1 else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        own = F.lit(True)
        if low is not None:
            own &= F.col(by) > F.lit(low)
        if high is not None:
            own &= F.col(by) <= F.lit(high)
        yield table.where(own)


def drained(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, into: str | None = None, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it gave, with `batch`, the number of the batch. A run with the
    same checkpoint and folder goes on where the last one ended. each: what is kept of a batch, which is a table, in its
    stead."""
    spark = stream.sparkSession
    checkpoint, into = checkpoint or new_folder(spark, "checkpoint"), into or new_folder(spark, "drained")

    def put(batch: DataFrame, number: int) -> None:
        made = each(batch) if each else batch
        made.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{into}/{number:06d}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    files = spark.read.option("recursiveFileLookup", True)
    return (files if each else files.schema(stream.select("*", F.lit(0).alias("batch")).schema)).parquet(into)


def watched(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that this module needs."""
    own = spark.newSession()
    own.conf.set(*STORE)
    return own
