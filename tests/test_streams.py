"""State over streams equals what batches give, however the stream is cut."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tilewright.streaming import events, state, stateful

CHANGES = "feature string, name string, value string, at long, arrival long"


def changes_of(rng, n):
    kinds = [("size", "1"), ("size", "2"), ("size", None), ("hover", "t"), ("hover", None), (None, None), ("label", "é")]
    weights = [5, 5, 3, 4, 3, 1, 4]
    rows = [(f"f{rng.randrange(6)}", *rng.choices(kinds, weights)[0], k) for k in range(n)]
    arrivals = rng.sample(range(n), n)
    return [(*r, a) for r, a in zip(rows, arrivals, strict=True)]


def last_states(found):
    got = found.groupBy("feature").agg(F.max_by("state", "batch").alias("state")).collect()
    return {r.feature: r.state for r in got if r.state}


@pytest.mark.parametrize(("seed", "parts", "by"), [(1, 1, "at"), (2, 4, "at"), (3, 5, "arrival")])
def test_states_equal_those_of_one_batch(spark, seed, parts, by):
    changes = spark.createDataFrame(changes_of(random.Random(seed), 120), CHANGES)
    want = {r.feature: r.state for r in state.merged_state(changes, ["feature"], ["at"], "name", "value").collect()}
    stream = stateful.feature_states(stateful.replayed(changes, by, parts), "feature", "name", "value", "at")
    found = stateful.drained(stream, "update")
    assert last_states(found) == want
    assert found.select("batch").distinct().count() >= min(parts, 2)


def test_states_go_on_from_a_checkpoint(spark, tmp_path):
    changes = spark.createDataFrame(changes_of(random.Random(9), 80), CHANGES)
    session = stateful.watched(spark)
    for k, part in enumerate(("arrival < 30", "arrival >= 30 AND arrival < 55", "arrival >= 55")):
        changes.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = session.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        found = stateful.drained(stateful.feature_states(stream, "feature", "name", "value", "at"), "update", f"{tmp_path}/checkpoint", f"{tmp_path}/out")
        so_far = changes.where(f"arrival < {[30, 55, 999][k]}")
        assert last_states(found) == {r.feature: r.state for r in state.merged_state(so_far, ["feature"], ["at"], "name", "value").collect()}


def test_states_with_a_lifetime_run(spark):
    changes = spark.createDataFrame([("a", "n", "1", 1, 1), ("a", "m", "2", 2, 2)], CHANGES)
    stream = stateful.feature_states(stateful.replayed(changes, "at", 1), "feature", "name", "value", "at", ttl_ms=3_600_000)
    query = stream.writeStream.format("memory").queryName("lifetimes").outputMode("update").start()  # by the clock: never done
    query.awaitTermination(12)
    query.stop()
    assert {r.feature: r.state for r in stream.sparkSession.table("lifetimes").collect() if r.state} == {"a": {"n": "1", "m": "2"}}


@pytest.mark.parametrize("trailing", [True, False])
def test_throttling_by_time_equals_the_batch(spark, trailing):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(4)}", 1_700_000_000 + t / 10, str(t)) for t in sorted(rng.sample(range(4000), 300))]
    calls = spark.createDataFrame([*rows, ("end", 1_700_100_000.0, "end")], "key string, at double, value string")
    batch = events.throttled(calls, "key", "at", 20.0, trailing).where("key <> 'end'")
    want = {(r.key, r.value, round(r.fired_at, 3)) for r in batch.collect()}
    timed = calls.select("key", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("time"), "value")
    for parts in (1, 4):
        made = stateful.throttled_by_time(stateful.replayed(timed, "time", parts), "key", "time", "value", 20_000, "1 second", trailing)
        got = stateful.drained(made).where("key <> 'end'").select("key", "value", (F.unix_micros("fired_at") / 1e6).alias("at")).collect()
        assert {(r.key, r.value, round(r["at"], 3)) for r in got} == want and len(got) == len(want)


def in_order(calls, span, trailing=True):
    out, until, queued = [], float("-inf"), None
    for at, v in [*calls, (float("inf"), None)]:
        while queued is not None and at >= until:
            out.append((queued, until))
            queued, until = None, until + span
        if v is None:
            return out
        if at >= until:
            out.append((v, at))
            until = at + span
        elif trailing:
            queued = v


@pytest.mark.parametrize("trailing", [True, False])
def test_throttling_in_arrow_batches(spark, trailing):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3, 4]), float(rng.randrange(600)), k) for k in range(500)]
    rows = [*{(r[0], r[1]): r for r in rows}.values()]  # times of their own
    calls = spark.createDataFrame(rows, "key int, at double, v int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.key, r.v, r.fired_at) for r in events.throttled(calls, "key", "at", 25.0, trailing).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(key, v, at) for key in {r[0] for r in rows} for v, at in in_order(sorted((r[1], r[2]) for r in rows if r[0] == key), 25.0, trailing)}
    assert got == want
    assert events.throttled(calls.where("false"), "key", "at", 5.0).count() == 0


def test_later_calls_dont_move_the_deadline(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("key string, time timestamp, value string").parquet(f"{tmp_path}/in")
    query = events.throttled_stream(stream, "key", "time", "value", 2000).writeStream.format("memory").queryName("deadlines").outputMode("append").trigger(processingTime="200 milliseconds").start()

    def call(k):
        one = spark.createDataFrame([("a", k, str(k))], "key string, at int, value string").select("key", F.timestamp_seconds("at").alias("time"), "value")
        one.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    began, k = time.time(), 0
    stop = threading.Event()
    while time.time() - began < 11 and not stop.wait(0.3):
        call(k)
        k += 1
    time.sleep(3)
    query.stop()
    got = [int(r.value) for r in spark.table("deadlines").collect()]
    assert got == sorted(got) and got[0] == 0 and 3 <= len(got) <= 7


@pytest.mark.parametrize("limits", [{"max_entries": 4}, {"max_bytes": 60}, {"max_entries": 5, "max_bytes": 80, "ttl": 40}])
def test_caches_equal_evicted_after_each_batch(spark, limits):
    rng = random.Random(6)
    rows = [(f"c{rng.randrange(3)}", f"t{k}", k, rng.randrange(30)) for k in range(90)]
    puts = spark.createDataFrame(rows, "cache string, key string, added long, size long")
    changes = stateful.drained(stateful.cache_changes(stateful.replayed(puts, "added", 5), "cache", "key", "added", "size", **limits)).collect()
    held, last = {}, -1
    per_batch = {}
    for r in sorted(changes, key=lambda r: (r.batch, r.change != "put")):
        per_batch.setdefault(r.batch, []).append(r)
    for batch in sorted(per_batch):
        for r in per_batch[batch]:
            last = max(last, r.added)
            held.pop((r.cache, r.key), None)
            if r.change == "put":
                held[r.cache, r.key] = r.added
        so_far = puts.where(F.col("added") <= last)
        if "ttl" in limits:
            newest = so_far.groupBy("cache").agg(F.max("added").alias("newest"))
            so_far = so_far.join(newest, "cache").where(F.col("newest") - F.col("added") <= limits["ttl"])
        want = state.evicted(so_far, ["cache"], "key", limits.get("max_entries"), limits.get("max_bytes"), size="size", added="added")
        assert set(held) == {(r.cache, r.key) for r in want.collect()}
    assert len(per_batch) >= 4 and any(r.change != "put" for r in changes)


def test_a_replaced_entry_counts_once(spark):
    rows = [("c", "a", 1, 10, 1), ("c", "b", 2, 10, 2), ("c", "a", 3, 5, 3), ("c", "b", 1, 99, 4), ("c", "z", 4, 16, 5)]  # an older b comes late
    puts = spark.createDataFrame(rows, "cache string, key string, added long, size long, turn int")
    changes = stateful.drained(stateful.cache_changes(stateful.replayed(puts, "turn", 5), "cache", "key", "added", "size", max_bytes=30)).collect()
    assert {(r.key, r.added) for r in changes if r.change == "evicted"} == {("b", 2)}


def test_asked_again_after_the_span(spark):
    rows = [("u", 0), ("u", 30), ("u", 59), ("u", 61), ("u", 110), ("u", 18_000), ("v", 5), (None, 1)]
    asked = spark.createDataFrame(rows, "url string, at int").select("url", F.timestamp_seconds("at").alias("time"))
    got = {(r.url, r.at) for r in events.asked_once(asked, "url", "time", 60.0).select("url", F.unix_seconds("time").alias("at")).collect()}
    assert got == {("u", 0), ("u", 61), ("u", 18_000), ("v", 5), (None, 1)}


def test_events_reach_parents_at_any_depth(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (40, 40), (7, None)]
    parents = spark.createDataFrame(chain, "target long, parent long")
    listeners = spark.createDataFrame([(k, "click", k, False) for k in [*range(41), 100, 101, 102]] + [(500, "click", 30, True), (501, "other", 30, False)], "listener int, type string, target long, once boolean")
    fired = spark.createDataFrame([(1, "click", 0), (2, "click", 35), (3, "click", 101), (4, "click", 29)], "event_id int, type string, target long")
    got = {}
    for r in events.dispatched(fired, listeners, parents).collect():
        got.setdefault(r.event_id, []).append(r.listener)
    assert sorted(got[1]) == [*range(41), 500] and sorted(got[2]) == [*range(35, 41)]
    assert sorted(got[3]) == [100, 101, 102] and sorted(got[4]) == [*range(29, 41)]
    alone = events.dispatched(fired, listeners).collect()
    assert {(r.event_id, r.listener) for r in alone} == {(1, 0), (2, 35), (3, 101), (4, 29)}
    assert events.dispatched(fired, listeners, parents.where("false")).count() == 4


def test_hits_equal_all_comparisons(spark):
    rng = random.Random(12)
    point = lambda x, y: (float(x), float(y))
    features, want = [], set()
    places = [(k, rng.uniform(0, 300), rng.uniform(0, 300)) for k in range(150)]
    for k in range(60):
        x, y, w, h = rng.randrange(280), rng.randrange(280), rng.randrange(5, 90), rng.randrange(5, 90)
        kind = k % 3 + 1
        ring = {1: [point(x, y)], 2: [point(x, y), point(x + w, y + h)], 3: [point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h), point(x, y)]}[kind]
        features.append((k, kind, [ring], 6.0 if k % 2 else None, 9.0 if k % 4 else None))
        wide, round_ = features[-1][3] or 1.0, features[-1][4] or 4.0
        for p, px, py in places:
            if kind == 1:
                met = ((px - x) ** 2 + (py - y) ** 2) ** 0.5 <= round_ + 2
            elif kind == 2:
                t = max(0, min(1, ((px - x) * w + (py - y) * h) / (w * w + h * h)))
                met = ((px - x - t * w) ** 2 + (py - y - t * h) ** 2) ** 0.5 <= wide / 2 + 4
            else:
                met = x < px < x + w and y < py < y + h
            if met:
                want.add((p, k))
    shapes = spark.createDataFrame(features, "id int, kind int, parts array<array<struct<x:double,y:double>>>, width double, radius double")
    spots = spark.createDataFrame(places, "event_id int, x double, y double")
    rows = events.hit_features(spots, shapes, 32.0).collect()
    assert {(r.event_id, r.id) for r in rows} == want and len(rows) == len(want) > 50
    told = {r.event_id: (r.n_hits, r.features) for r in events.with_hits(spots, shapes, most=2).collect()}
    for p in {p for p, _ in want}:
        own = sorted(k for q, k in want if q == p)
        assert told[p] == (len(own), own[:2])
    stream = stateful.replayed(spots, "event_id", 3)
    again = stateful.drained(events.hit_features(stream, stateful_copy(stream, shapes), 64.0))
    assert {(r.event_id, r.id) for r in again.collect()} == want


def stateful_copy(stream, table):
    """The table in the stream's session."""
    return stream.sparkSession.createDataFrame(table.collect(), table.schema)
