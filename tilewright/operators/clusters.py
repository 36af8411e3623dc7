"""Hierarchical clustering of points, level by level, in joins and aggregates.

At each zoom points are taken in the order of their index; one that is still free becomes an origin and takes all free
points within the radius. Whether a point is free depends on its smaller neighbours alone. Pairs of neighbours are dealt
over tasks by place, and a task settles every point whose smaller neighbours are its own or already settled; what hangs
on points of other tasks waits for the next round. A track of points costs a round for each task that it passes, and
pairs that one task holds cost a single round. A taken point belongs to its smallest origin. The indexes stay those of
the origins, so no global numbering is needed between levels.

Where places are so crowded that pairs would be many, the order is taken in ranges, each twice as long as all before: the
origins found so far, which lie farther apart than the radius, take most of a range, and only the rest makes pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tilewright.functions import geo
from tilewright.operators.shared import done_with, written
from tilewright.operators.spatial import radius_join

RADIUS, EXTENT, MIN_POINTS, MIN_ZOOM, MAX_ZOOM = 40, 512, 2, 0, 16
LEVEL = ["idx", "x", "y", "n", "cluster_id"]
#: Pairs of neighbours that one task settles.
TASK_PAIRS = 400_000
#: Pairs that share a cell within one range of the order: so many, or so many for each point where that is more. Points
#: with more are taken in several ranges.
RANGE_PAIRS, POINT_PAIRS = 100_000, 2
FREE, ORIGIN, TAKEN = 0, 1, 2


def unit_mercator(lng: Column, lat: Column) -> tuple[Column, Column]:
    """The world as the unit square, y down; latitudes beyond the square are clamped."""
    s = F.sin(F.radians(lat))
    y = 0.5 - 0.25 * F.ln((1 + s) / (1 - s)) / F.pi()
    return lng / 360 + 0.5, F.when(lat >= 90, 0.0).when(lat <= -90, 1.0).otherwise(geo.clamp(y, F.lit(0.0), F.lit(1.0)))


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, told) in the order of b, then a: b's smaller neighbours with what is told of them, and one row without
    a for each b. Gives idx, status and, where no smaller neighbour is unsettled, the owner."""
    status: dict[int, int] = {}
    b, taken, waits, owner = None, False, False, None
    kinds = [pa.int64(), pa.int8(), pa.int64()]

    def settled() -> tuple[int, int, int | None]:
        found = TAKEN if taken else FREE if waits else ORIGIN
        if found:
            status[b] = found
        return b, found, b if found == ORIGIN else owner

    for batch in batches:
        out = []
        for a, point, told in zip(*[batch[c].to_pylist() for c in ("a", "b", "told")], strict=True):
            if point != b:
                if b is not None:
                    out.append(settled())
                b, taken, waits, owner = point, False, False, None
            if a is None or taken:
                continue
            before = status.get(a, told)
            taken, waits = before == ORIGIN, waits or before == FREE
            if taken and not waits:
                owner = a
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)], ["idx", "status", "owner"])
    if b is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(settled(), kinds, strict=True)], ["idx", "status", "owner"])


def greedy_owners(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """points (idx, x), pairs (a, b, bx) with a < b -> (idx, owner): the origin that takes each point, its own for origins."""
    pairs = written(pairs.select("a", "b", F.col("bx").alias("x")), "pairs")
    alone = points.select(F.lit(None).cast("long").alias("a"), F.col("idx").alias("b"), "x")
    left = pairs.union(alone).withColumn("told", F.lit(FREE).cast("byte"))
    tasks = -(-pairs.count() // TASK_PAIRS) or 1
    rounds, spent = [], []
    while True:
        dealt = left.repartitionByRange(tasks, "x", "b").sortWithinPartitions("b", F.col("a").asc_nulls_first())
        now = written(dealt.mapInArrow(settle, "idx long, status byte, owner long"), "settled")
        rounds.append(now.where(F.col("status") != FREE))
        if tasks == 1 or now.where(F.col("status") == FREE).isEmpty():
            break
        known = rounds[-1].select("idx", "status")
        waiting = left.join(known.select(F.col("idx").alias("b")), "b", "left_anti")
        told = waiting.join(known.withColumnRenamed("idx", "a"), "a", "left").withColumn("told", F.coalesce("status", "told"))
        left = written(told.select("a", "b", "x", "told"), "pairs")
        spent.append(left)
    every = rounds[0]
    for one in rounds[1:]:
        every = every.union(one)
    if len(rounds) == 1:
        return every.select("idx", "owner")
    origins = every.where(F.col("status") == ORIGIN).select(F.col("idx").alias("a"))
    late = every.where("owner IS NULL").select(F.col("idx").alias("b"))
    owners = pairs.join(late, "b", "left_semi").join(origins, "a").groupBy(F.col("b").alias("idx")).agg(F.min("a").alias("owner"))
    found = written(every.where("owner IS NOT NULL").select("idx", "owner").union(owners), "owners")
    done_with(pairs, *spent)
    return found


def owners_within(points: DataFrame, radius: float, most: int | None = None) -> DataFrame:
    """points (idx, x, y) -> (idx, owner), as greedy_owners gives them for all pairs within the radius."""
    points = points.select("idx", "x", "y")

    def crowd(df: DataFrame) -> tuple:
        cells = df.groupBy(*[F.floor(F.col(c) / radius).alias(c) for c in "xy"]).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high"))
        return cells.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2), F.min("low"), F.max("high")).first()

    def settled(df: DataFrame) -> DataFrame:
        return greedy_owners(df.select("idx", "x"), radius_join(df, df, "idx", "idx", radius, self_join=True, keep=["bx"]))

    n, pairs, low, high = crowd(points)
    most = most or max(RANGE_PAIRS, POINT_PAIRS * (n or 0))
    if not n or pairs <= most:
        return settled(points)
    first = max(1, int(n * math.sqrt(most / pairs)))
    shares = [first * 2**k / n for k in range(64) if first * 2**k < n]
    cuts = points.agg(F.percentile_approx("idx", shares, int(min(10_000_000, 16 * n / first + 100)))).first()[0] if shares else []
    edges = [low - 1, *sorted({*cuts} - {high}), high]
    todo = [*zip(edges, edges[1:], strict=False)][::-1]
    owned, origins = [], None
    while todo:
        begin, end = todo.pop()
        left, taken = points.where((F.col("idx") > begin) & (F.col("idx") <= end)), None
        if origins is not None:
            met = radius_join(left, origins, "idx", "idx", radius)
            taken = written(met.groupBy(F.col("a").alias("idx")).agg(F.min("b").alias("owner")), "taken")
            left = written(left.join(taken, "idx", "left_anti"), "left")
        if (crowd(left)[1] or 0) > most:
            middle = left.agg(F.percentile_approx("idx", 0.5)).first()[0]
            if begin < middle < end:
                todo += [(middle, end), (begin, middle)]
                continue
        own = written(settled(left), "owners")
        new = written(left.join(own.where("idx = owner").select("idx"), "idx", "left_semi"), "origins")
        origins = new if origins is None else origins.union(new)
        owned += [own] if taken is None else [taken, own]
    every = owned[0]
    for one in owned[1:]:
        every = every.unionByName(one)
    return every


Reduced = dict[str, tuple[Column, Callable[[str], Column]]]
#: A column of the points, and a function of two of its values (Python ones) that puts them together.
Folded = dict[str, tuple[Column, Callable[[object, object], object]]]


def reduced_in_order(rows: DataFrame, group: str, order: list[str], value: str, put: Callable[[object, object], object]) -> DataFrame:
    """group and value: each group's values put together from the first in order to the last. put must be associative but
    may mind the order. Rows are dealt by ranges of (group, order), so a large group lies in several tasks; each puts its
    stretch together, and these few are put together once more."""
    kind = rows.schema[value].dataType

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, own = TaskContext.get().partitionId(), None, None
        for batch in batches:
            out = []
            for g, v in zip(batch[group].to_pylist(), batch[value].to_pylist(), strict=True):
                if own == (g,):
                    held = put(held, v)
                    continue
                if own is not None:
                    out.append((own[0], part, held))
                own, held = (g,), v
            yield made(out)
        if own is not None:
            yield made([(own[0], part, held)])

    types = [to_arrow_type(rows.schema[group].dataType), pa.int64(), to_arrow_type(kind)]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, types, strict=True)], [group, "__part", value])

    schema = f"`{group}` {rows.schema[group].dataType.simpleString()}, __part long, `{value}` {kind.simpleString()}"
    ranged = rows.select(group, *order, value).repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    parts = ranged.select(group, value).mapInArrow(fold, schema)
    whole = parts.repartition(group).sortWithinPartitions(group, "__part").select(group, value)
    return whole.mapInArrow(fold, schema).select(group, value)


def cluster_level(level: DataFrame, zoom: int, radius: float, extent: float, min_points: int, reduced: Reduced, folded: Folded) -> DataFrame:
    """The points of `level` (that of zoom + 1), each with what is made of it at `zoom`: `made`, `owner`, and the new
    cluster's columns as struct `c`, null where the point goes on alone."""
    owned = level.join(owners_within(level, radius / (extent * 2**zoom)), "idx")
    merged = owned.groupBy("owner").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("x") * F.col("n")).alias("wx"), F.sum(F.col("y") * F.col("n")).alias("wy"), *[put(k).alias(k) for k, (_, put) in reduced.items()]
    )
    for k, (_, put) in folded.items():  # the origin first, the others as they come
        merged = merged.join(reduced_in_order(owned.select("owner", (F.col("idx") != F.col("owner")).alias("__later"), "idx", k), "owner", ["__later", "idx"], k, put), "owner")
    cluster_id = (F.col("owner") * 32 + zoom + 1).cast("long")
    values = [(F.col("wx") / F.col("total")).alias("x"), (F.col("wy") / F.col("total")).alias("y"), F.col("total").alias("n"), cluster_id.alias("cluster_id"), *reduced, *folded]
    made = merged.where((F.col("rows") > 1) & (F.col("total") >= min_points)).select("owner", F.struct(*values).alias("c"))
    return written(owned.join(made, "owner", "left"), "level")


def cluster(
    points: DataFrame, key: str, lng: str = "lng", lat: str = "lat", radius: float = RADIUS, extent: float = EXTENT, min_points: int = MIN_POINTS, min_zoom: int = MIN_ZOOM, max_zoom: int = MAX_ZOOM,
    sums: dict[str, Column] | None = None, reduced: Reduced | None = None, folded: Folded | None = None,
) -> DataFrame:
    """All levels: zoom, idx, x, y, n (points in it), cluster_id (null for a lone point), parent (null at the top), and one
    column for each of `sums` (added up over the members) and of `reduced` (a column of the points and the aggregate, by
    the column's name, that puts members together; it must not mind in which groups and order they come), and of `folded`
    (a column and a Python function of two values, which come in order: the cluster's origin first). key: an
    integer that gives the order of the points. Level max_zoom + 1 holds the points. Points without key or place are
    left out; an empty table gives an empty result."""
    reduced, folded = {k: (v, F.sum) for k, v in (sums or {}).items()} | (reduced or {}), folded or {}
    x, y = unit_mercator(F.col(lng), F.col(lat))
    start = points.where(F.col(key).isNotNull() & F.col(lng).isNotNull() & F.col(lat).isNotNull())
    none = F.lit(None).cast("long")
    level = written(start.select(F.col(key).cast("long").alias("idx"), x.alias("x"), y.alias("y"), F.lit(1).cast("long").alias("n"), none.alias("cluster_id"), *[v.alias(k) for k, (v, _) in (reduced | folded).items()]), "level")
    columns = [*LEVEL, *reduced, *folded]
    whole = []
    for zoom in range(max_zoom, min_zoom - 1, -1):
        told = cluster_level(level, zoom, radius, extent, min_points, reduced, folded)
        whole.append(told.select(F.lit(zoom + 1).alias("zoom"), *columns, F.col("c.cluster_id").alias("parent")))
        new = told.where("c IS NOT NULL AND idx = owner").select("idx", *[F.col("c")[k].alias(k) for k in columns[1:]])
        level = new.unionByName(told.where("c IS NULL").select(*columns))
    whole.append(level.select(F.lit(min_zoom).alias("zoom"), *columns, none.alias("parent")))
    levels = whole[0]
    for one in whole[1:]:
        levels = levels.unionByName(one)
    return levels.select("zoom", *LEVEL, "parent", *reduced, *folded)


def abbreviated(n: Column) -> Column:
    """A count as people read it: 950, 1.2k, 15k."""
    return F.when(n >= 10000, F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("k"))).when(n >= 1000, F.concat(F.format_number(n / 1000, 1), F.lit("k"))).otherwise(n.cast("string"))


def in_box(levels: DataFrame, zoom: int, west: float, south: float, east: float, north: float) -> DataFrame:
    """The clusters and lone points of a zoom in a box; a box across the antimeridian is its two parts."""
    wrap = lambda v: ((v + 180) % 360 + 360) % 360 - 180
    w, e = (-180.0, 180.0) if east - west >= 360 else (wrap(west), 180.0 if east == 180 else wrap(east))
    x0, x1 = w / 360 + 0.5, e / 360 + 0.5
    inside = F.col("x").between(x0, x1) if w <= e else (F.col("x") >= x0) | (F.col("x") <= x1)
    _, top = unit_mercator(F.lit(0.0), F.lit(float(north)))
    _, bottom = unit_mercator(F.lit(0.0), F.lit(float(south)))
    return levels.where((F.col("zoom") == zoom) & inside & F.col("y").between(top, bottom))


def children(levels: DataFrame, cluster_id: int) -> DataFrame:
    return levels.where((F.col("parent") == cluster_id) & (F.col("zoom") == cluster_id % 32))


def all_leaves(levels: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (cluster_id) -> of_cluster and the columns of levels: the points of each cluster, at whatever depth; its
    members and theirs, until none is a cluster. A recursive query, whose steps are joins with the members alone."""
    spark = levels.sparkSession
    members = levels.where("cluster_id IS NOT NULL OR parent IS NOT NULL").where(F.col("parent").isNotNull() & (F.col("zoom") == F.col("parent") % 32))
    walked = spark.sql(
        "WITH RECURSIVE down(of_cluster, cluster_id, idx, zoom) AS (SELECT cluster_id, cluster_id, CAST(NULL AS BIGINT), CAST(NULL AS INT) FROM {wanted} "
        "UNION ALL SELECT down.of_cluster, m.cluster_id, m.idx, m.zoom FROM down JOIN {members} m ON m.parent = down.cluster_id) "
        "SELECT of_cluster, idx, zoom FROM (SELECT * FROM down LIMIT ALL) WHERE cluster_id IS NULL",  # as large as the clusters are
        wanted=wanted.select("cluster_id").where("cluster_id IS NOT NULL").distinct(),
        members=members.select("parent", "cluster_id", "idx", "zoom"),
    )
    return walked.join(levels, ["idx", "zoom"]).select("of_cluster", *levels.columns)


def leaves(levels: DataFrame, cluster_id: int, limit: int | None = 10, offset: int = 0) -> DataFrame:
    """The points of a cluster in the order of their index; no limit where that is None."""
    one = levels.sparkSession.range(1).select(F.lit(cluster_id).cast("long").alias("cluster_id"))
    ordered = all_leaves(levels, one).drop("of_cluster").orderBy("idx").offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def expansion_zoom(cluster_id: Column) -> Column:
    """The first zoom at which a cluster falls apart: that of its members, for a cluster is only made of two or more."""
    return (cluster_id % 32).cast("int")


def tile(levels: DataFrame, z: int, x: int, y: int, radius: float = RADIUS, extent: float = EXTENT) -> DataFrame:
    """The clusters and points of a tile and of a margin around it, with px and py in the tile's units. At the world's
    edges the margin is that of the other side."""
    n, pad = 2**z, radius / extent
    level = levels.where((F.col("zoom") == z) & F.col("y").between((y - pad) / n, (y + 1 + pad) / n))

    def part(low: float, high: float, column: int) -> DataFrame:
        inside = level.where(F.col("x").between(low, high))
        return inside.withColumns({"px": (F.col("x") * n - column) * extent, "py": (F.col("y") * n - y) * extent})

    parts = [part((x - pad) / n, (x + 1 + pad) / n, x)]
    parts += [part(1 - pad / n, 1, n)] if x == 0 else []
    parts += [part(0, pad / n, -1)] if x == n - 1 else []
    whole = parts[0]
    for one in parts[1:]:
        whole = whole.unionByName(one)
    return whole


def described(levels: DataFrame, *reduced: str) -> DataFrame:
    """levels with the properties that a client sees: cluster, cluster_id, point_count and its short form, and those that
    were reduced; all null for a lone point."""
    of_cluster = [F.lit(True).alias("cluster"), F.col("cluster_id"), F.col("n").alias("point_count"), abbreviated(F.col("n")).alias("point_count_abbreviated"), *reduced]
    return levels.withColumn("cluster_properties", F.when(F.col("cluster_id").isNotNull(), F.struct(*of_cluster)))
