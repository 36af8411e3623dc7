"""Events over tables and streams: listeners, hits, throttling, positions, and what is only to be asked for once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from tilewright.functions import geo, geometry
from tilewright.operators.shared import dealt, done_with, written


def ancestors(parents: DataFrame) -> DataFrame:
    """(target, parent) -> (target, ancestor): all that can be reached upwards, however far, each pair once; those of a
    cycle reach themselves too. Each round doubles the steps that are taken, so a chain of n costs log2(n) rounds; the
    rounds end when none finds a pair."""
    step = parents.select("target", F.col("parent").alias("ancestor")).where("target IS NOT NULL AND ancestor IS NOT NULL").distinct()
    known = written(step, "ancestors")
    n = known.count()
    while True:
        further = known.alias("a").join(known.alias("b"), F.expr("a.ancestor = b.target")).select("a.target", "b.ancestor")
        more = written(known.union(further).distinct(), "ancestors")
        found = more.count()
        done_with(known)
        known = more
        if found == n:
            return known
        n = found


def dispatched(events: DataFrame, listeners: DataFrame, parents: DataFrame | None = None, order: str = "event_id") -> DataFrame:
    """events (order, type, target, ...) with each listener (listener, type, target, once) that hears them: one of the
    event's target, or of what the target's parents (target, parent) lead to, at any depth and once each, in cycles too.
    A listener that is `once` hears its first event alone. Events are read once for what they reach and once more for the
    first events."""
    at = listeners.select("listener", "type", F.col("target").alias("heard_at"), "once")
    heard = events.join(at.withColumn("target", F.col("heard_at")), ["type", "target"])
    if parents is not None:  # what is listened to from below: listeners, not events, go up and down the tree
        below = at.join(ancestors(parents).where("target <> ancestor").withColumnRenamed("ancestor", "heard_at"), "heard_at")
        heard = heard.unionByName(events.join(below, ["type", "target"]))
    first = heard.where("once").groupBy("listener").agg(F.min(order).alias("__first"))
    kept = heard.join(first, "listener", "left").where(F.col("__first").isNull() | (F.col(order) == F.col("__first")))
    return kept.drop("__first")


def _measures(p: Column) -> dict[str, Column]:
    """What a piece (ax, ay, bx, by) is measured by: its beginning, where it leads to from there, and its length squared, 1
    where it has none."""
    dx, dy = p.bx - p.ax, p.by - p.ay
    return {"ax": p.ax, "ay": p.ay, "dx": dx, "dy": dy, "size": F.when((dx != 0) | (dy != 0), dx * dx + dy * dy).otherwise(1.0)}


def _near(x: Column, y: Column, p: dict[str, Column], reach: Column) -> Column:
    """Whether a piece is within reach, step by step as in the queries' SQL: the last bit decides at the edge. Plain columns
    and no branches keep the compiled condition small, which must stay so to be fast."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - p["ax"]) * p["dx"] + (y - p["ay"]) * p["dy"]) / p["size"]))
    u, v = x - p["ax"] - t * p["dx"], y - p["ay"] - t * p["dy"]
    return F.sqrt(u * u + v * v) <= reach


#: What rounding may take off a piece's box.
SLACK = 1e-6


def _pieces(features: DataFrame, cell: float, keep: list[str]) -> DataFrame:
    """A row for each cell (__i, __j) and each piece of a feature that reaches into it: a segment of a line from __ax, __ay
    on by __dx, __dy, a point as a segment without length, a polygon whole, with its box. __size: the segment's length
    squared, 1 where there is none. __before: the feature's pieces that come first."""
    width, radius = (F.coalesce(F.col(c), F.lit(v)) if c in features.columns else F.lit(v) for c, v in (("width", 1.0), ("radius", 4.0)))
    reach = F.when(F.col("kind") == 1, radius + 2).when(F.col("kind") == 2, width / 2 + 4).otherwise(0.0)
    own = lambda v, name: v.cast("double").alias(name)
    piece = lambda a, b: F.struct(own(a.x, "ax"), own(a.y, "ay"), own(b.x, "bx"), own(b.y, "by"))
    box = geometry.bounds(F.flatten("parts"))
    edges = F.flatten(F.transform("parts", lambda v: F.when(F.size(v) > 1, F.transform(geometry.edges(v), lambda e: piece(e.a, e.b))).otherwise(F.array())))
    corners = F.array(F.struct(own(box.minx, "ax"), own(box.miny, "ay"), own(box.maxx, "bx"), own(box.maxy, "by")))
    ends = F.when(F.col("kind") == 1, F.transform(F.flatten("parts"), lambda p: piece(p, p))).when(F.col("kind") == 2, edges).when(F.col("kind") == 3, corners)
    tasks = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small file is a single task's
    drawn = features.repartition(tasks, *keep).select(*keep, F.col("kind").alias("__kind"), F.when(F.col("kind") == 3, F.col("parts")).alias("__parts"), reach.alias("__reach"), ends.alias("__pieces"))
    each = drawn.select("*", F.posexplode_outer("__pieces").alias("__k", "__p"))  # inner ones look at their arrays twice
    before = F.when(F.col("__k") > 0, F.slice("__pieces", F.lit(1), F.col("__k"))).otherwise(F.array())
    own = [v.alias(f"__{c}") for c, v in _measures(F.col("__p")).items()]
    each = each.select(*[c for c in drawn.columns if c != "__pieces"], *own, before.alias("__before"))
    each = each.where("__ax IS NOT NULL AND __ay IS NOT NULL AND __dx IS NOT NULL AND __dy IS NOT NULL")
    at = lambda v: F.floor(v / cell).cast("long")
    r, ax, ay, dx, dy = (F.col(f"__{c}") for c in ("reach", "ax", "ay", "dx", "dy"))
    columns, rows = (F.sequence(at(F.least(a, a + d) - r - SLACK), at(F.greatest(a, a + d) + r + SLACK)) for a, d in ((ax, dx), (ay, dy)))
    celled = each.withColumn("__i", F.explode_outer(columns)).withColumn("__j", F.explode_outer(rows))
    aside = ((F.col("__i") + 0.5) * cell - ax) * dy - ((F.col("__j") + 0.5) * cell - ay) * dx  # the cell's middle from the line, times its length
    wide = r + cell * 0.7072  # half a cell's diagonal and a little
    return celled.where((F.col("__kind") == 3) | (aside * aside <= wide * wide * F.col("__size")))


def hit_features(places: DataFrame, features: DataFrame, cell: float = 64.0, keep: list[str] | None = None) -> DataFrame:
    """places (x, y, ...), a table or a stream, with each feature that they hit: `keep` of the features' columns (id).
    features: id, kind (1 point, 2 line, 3 polygon), parts (arrays of points), width and radius where they have them. A
    polygon is hit inside, a line within half its width and 4 units, a point within its radius and 2 units. Both sides
    meet on cells of a grid: a place in its own, a feature's pieces in all that they reach into. A piece is measured by
    plain arithmetic; only what it meets looks at the feature's pieces before, so that a pair counts once."""
    keep = keep or ["id"]
    at = lambda v: F.floor(v / cell).cast("long")
    placed = places.withColumns({"__i": at(F.col("x")), "__j": at(F.col("y"))})
    x, y, reach = F.col("x"), F.col("y"), F.col("__reach")
    u, v = x - F.col("__ax"), y - F.col("__ay")
    inside = u.between(-SLACK, F.col("__dx") + SLACK) & v.between(-SLACK, F.col("__dy") + SLACK)
    polygon, own = F.col("__kind") == 3, {c: F.col(f"__{c}") for c in ("ax", "ay", "dx", "dy", "size")}
    met = (polygon & inside) | (~polygon & _near(x, y, own, reach))
    first = (F.size("__before") == 0) | ~F.exists("__before", lambda p: F.coalesce(_near(x, y, _measures(p), reach), F.lit(False)))
    whole = (polygon & geometry.in_polygon(x, y, F.col("__parts"))) | (~polygon & first)
    return placed.join(_pieces(features, cell, keep).hint("merge"), ["__i", "__j"]).where(met & whole).select(*places.columns, *keep)


#: Of so many places and hits at most is a block: what one row stands for stays small.
BLOCK = 100, 1000
#: So many distinct places at most are sent to all tasks; more of them meet features by a shuffle of both.
FEW = 100_000


def hit_places(places: DataFrame, features: DataFrame, cell: float = 64.0, keep: list[str] | None = None) -> DataFrame:
    """x and y of a table's places with each feature that they hit: hit_features() of the distinct places alone, so that
    a crowded place is measured once."""
    spots = written(places.select("x", "y").distinct(), "spots")
    return hit_features(spots.hint("broadcast") if spots.count() <= FEW else spots, features, cell, keep)


def hit_blocks(places: DataFrame, features: DataFrame, cell: float = 64.0, keep: list[str] | None = None) -> DataFrame:
    """What hit_features() gives of a table, in blocks: `places`, rows that lie in one place, up to 100 of them, and
    `features`, up to 1,000 that each of them hits, so that a crowded place is written once. pairs() takes them apart."""

    def blocks(rows: DataFrame, columns: list[str], most: int, name: str) -> DataFrame:
        own = F.row_number().over(Window.partitionBy("x", "y").orderBy("x"))
        cut = rows.select("x", "y", F.struct(*columns).alias("__row"), F.floor((own - 1) / most).alias("__block"))
        return cut.groupBy("x", "y", "__block").agg(F.collect_list("__row").alias(name)).drop("__block")

    met = hit_places(places, features, cell, keep)
    here = blocks(places.where("x IS NOT NULL AND y IS NOT NULL"), places.columns, BLOCK[0], "places")
    return here.join(blocks(met, keep or ["id"], BLOCK[1], "features"), ["x", "y"]).select("places", "features")


def pairs(blocks: DataFrame) -> DataFrame:
    """Each place of a block with each of its features. Blocks, not pairs, are dealt over tasks."""
    each = dealt(blocks.select("places", "features")).select(F.explode("places").alias("__place"), "features")
    return each.select("__place", F.explode("features").alias("__feature")).select("__place.*", "__feature.*")


def with_hits(events: DataFrame, features: DataFrame, *, most: int | None = None, cell: float = 64.0) -> DataFrame:
    """The events (x, y, ...) of a table that hit features, with n_hits, first and last, the smallest and the largest id of
    those that they hit, and `features`, all their ids in order, or the `most` smallest. Whoever doesn't select `features`
    gathers no ids: the others take no more room for many hits than for one."""
    met = hit_places(events, features, cell)
    listed = F.col("id")
    if most is not None:
        met = met.withColumn("__k", F.row_number().over(Window.partitionBy("x", "y").orderBy("id")))
        listed = F.when(F.col("__k") <= most, listed)
    own = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_hits"), F.min("id").alias("first"), F.max("id").alias("last"), F.sort_array(F.collect_list(listed)).alias("features"))
    return events.join(own, ["x", "y"]).select(*events.columns, "n_hits", "first", "last", "features")


def fired(times: np.ndarray, until: float, span: float, trailing: bool) -> tuple[list[int], list[float], float, int | None]:
    """What goes through of calls at ascending times, where none may before `until`: their places, when they fire, until
    when no further one may, and the place of the one that waits for that. Each step is a search, not a call."""
    places, at, waiting, k, n = [], [], None, 0, len(times)
    while True:
        if waiting is None and k < n and times[k] >= until:
            places.append(k)
            at.append(float(times[k]))
            until, k = float(times[k]) + span, k + 1
        last = int(np.searchsorted(times[k:], until)) + k  # calls before `until`: the last of them waits
        if last > k:
            waiting, k = last - 1, last
        if k == n:
            return places, at, until, waiting if trailing else None
        if waiting is not None and trailing:
            places.append(waiting)
            at.append(until)
            until += span
        waiting = None


def throttled(calls: DataFrame, key: str, time: str, span: float, trailing: bool = True) -> DataFrame:
    """The calls (key, time in seconds, ...) that go through, with fired_at: the first at once; of those that come within
    `span` seconds after one that went through the last alone, when the span ends (none of them if not trailing). Calls are
    read in order of time, key by key, in Arrow batches with one call held; the calls of one key are one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the row that waits, of the last key read
        own, until = None, -np.inf
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            codes = table[key].combine_chunks().dictionary_encode(null_encoding="encode")
            edges = np.r_[0, np.flatnonzero(np.diff(codes.indices.to_numpy())) + 1, table.num_rows].tolist()
            times = table[time].to_numpy().astype(float)
            places, at = [], []
            for begin, end in zip(edges, edges[1:], strict=False):
                this = codes.dictionary[codes.indices[begin].as_py()]
                if begin or own is None or own != (this.as_py(),):
                    own, until = (this.as_py(),), -np.inf
                found, fired_at, until, waiting = fired(times[begin:end], until, span, trailing)
                places += [begin + k for k in found]
                at += fired_at
                held = None if waiting is None else table.slice(begin + waiting, 1)
                if held is not None and end < table.num_rows:  # the key ends here
                    places.append(begin + waiting)
                    at.append(until)
                    held = None
            yield from table.take(pa.array(places, pa.int64())).append_column("fired_at", pa.array(at, pa.float64())).combine_chunks().to_batches()
        if held is not None:
            yield from held.append_column("fired_at", pa.array([until], pa.float64())).combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema)
    return calls.repartition(key).sortWithinPartitions(key, time).mapInArrow(run, f"{schema}, fired_at double")


def throttled_stream(calls: DataFrame, key: str, time: str, value: str, span_ms: int) -> DataFrame:
    """The same over a stream (key string, time timestamp, value string), by processing time: key, value, the first at once,
    then at most one in each span, the last that came. The state of a key is the value that waits and the end of its span,
    which later calls don't move. stateful.throttled_by_time() follows the calls' own times."""

    def step(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held, until = state.get if state.exists else (None, now)
        rows = [] if state.hasTimedOut else pd.concat([*batches]).sort_values(time, kind="stable")[value].tolist()
        out = []
        if now >= until and (held is not None or rows):
            out, until = [held if held is not None else rows.pop(0)], now + span_ms
            held = None
        if rows:
            held = rows[-1]
        if state.hasTimedOut and not out:
            state.remove()
        else:
            state.update((held, until))
            state.setTimeoutDuration(max(1, until - now))
        yield pd.DataFrame({"key": [of[0]] * len(out), "value": out}, dtype=object)

    return calls.groupBy(key).applyInPandasWithState(step, "key string, value string", "held string, until long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def with_state(features: DataFrame, states: DataFrame, *keys: str, column: str = "state") -> DataFrame:
    """Each feature with its state, an empty map where it has none."""
    kind = dict(states.dtypes)[column]
    return features.join(states.select(*keys, column), [*keys], "left").withColumn(column, F.coalesce(column, F.create_map().cast(kind)))


def asked_once(requests: DataFrame, url: str, time: str, span: float = 60.0) -> DataFrame:
    """A table's requests without those of an address that was asked for, and let through, less than `span` seconds
    before. stateful.asked_once_stream() does the same over a stream."""
    timed = requests.withColumn("__at", F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1e6))
    return throttled(timed, url, "__at", span, trailing=False).select(*requests.columns)


def located(positions: DataFrame, lat: str = "lat", lng: str = "lng", accuracy: str = "accuracy") -> DataFrame:
    """Positions with bounds, the box of a square of twice the accuracy around each."""
    return positions.withColumn("bounds", geo.square_around(F.col(lat), F.col(lng), F.col(accuracy) * 2))


def progress(done: DataFrame, job: str, order: str) -> DataFrame:
    """done (job, order, ...) with completed, how many of its job are done by then, and total."""
    at = Window.partitionBy(job).orderBy(order)
    total = done.groupBy(job).agg(F.count(F.lit(1)).alias("total"))
    return done.withColumn("completed", F.row_number().over(at)).join(total, job)


def latest(updates: DataFrame, *keys: str, order: Column) -> DataFrame:
    """The last update of each key: an earlier one is superseded."""
    own = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*own), order).alias("__last")).select(*keys, "__last.*")
