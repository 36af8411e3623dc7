"""Queries over pictures of tiles, streams and stored layouts, all made from the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import elevation, geo
from tilewright.operators import clusters
from tilewright.operators.box_store import BoxStore
from tilewright.operators.shared import new_folder
from tilewright.sources import answer_cache, rasters
from tilewright.sources.views import BOXES, EV, event_points, part_boxes, table
from tilewright.streaming import events, stateful

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


SIZE, DEM_ZOOM = 16, 3
#: The place of a point in the unit square, its tile of zoom 3, and its place in the tile's samples.
UNIT = "(lng+180)/360 AS ux, 0.5e0-0.25e0*ln((1+sin(radians(lat)))/(1-sin(radians(lat))))/pi() AS uy"
IN_TILE = f"SELECT *, CAST(floor(ux*8) AS INT) AS x, CAST(floor(uy*8) AS INT) AS y, greatest(0, least({SIZE - 1}, (ux*8-floor(ux*8))*{SIZE})) AS px, greatest(0, least({SIZE - 1}, (uy*8-floor(uy*8))*{SIZE})) AS py FROM (SELECT *, {UNIT} FROM ({EV}))"


def height_pictures(spark, sf_dir):
    """A folder of pictures of zoom 3, a slope in each tile with events whose foot is the tile's number of them."""
    ev = event_points(spark, sf_dir)
    counts = ev.groupBy(geo.tile_x(F.col("lng"), DEM_ZOOM).cast("int").alias("x"), geo.tile_y(F.col("lat"), DEM_ZOOM).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    cells = F.sequence(F.lit(0), F.lit(SIZE * SIZE - 1))
    grid = F.transform(cells, lambda k: (F.col("n") + 10 * (k % SIZE) + 5 * F.floor(k / SIZE)).cast("double"))
    folder = new_folder(spark, "pictures")
    tiles = counts.select(F.lit(DEM_ZOOM).alias("z"), "x", "y", rasters.encode_heights(grid).alias("pixels"))
    made = rasters.write_pictures(tiles, folder, SIZE).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return folder, made


@query(f"WITH t AS ({IN_TILE}) SELECT event_id, round(count(*) OVER (PARTITION BY x, y) + 10*px + 5*py, 3) AS elevation FROM t")
def raster_elevation(spark, sf_dir):
    """Pictures of heights written from the events, read back and looked up for each event."""
    folder, _ = height_pictures(spark, sf_dir)
    heights = rasters.picture_heights(rasters.read_pictures(spark, folder, [DEM_ZOOM]))
    found = elevation.query_elevation(event_points(spark, sf_dir).select("event_id", "lng", "lat"), heights, SIZE, 5)
    return found.select("event_id", F.round("elevation", 3).alias("elevation"))


@query(f"WITH t AS ({IN_TILE}), n AS (SELECT x, y, count(*) AS n FROM t GROUP BY ALL) SELECT 3 AS z, x, y, {SIZE} AS size, n * 1e0 AS lowest, n + {15 * (SIZE - 1)}e0 AS highest FROM n WHERE x < 4")
def raster_heights(spark, sf_dir):
    """Heights of the pictures of the west; the folders of the east aren't read."""
    folder, _ = height_pictures(spark, sf_dir)
    west = rasters.picture_heights(rasters.read_pictures(spark, folder).where("x < 4"))
    return west.select("z", "x", "y", "size", F.round(F.array_min("grid"), 1).alias("lowest"), F.round(F.array_max("grid"), 1).alias("highest"))


@query(
    f"WITH t AS ({IN_TILE}), have AS (SELECT DISTINCT x, y FROM t WHERE (x + y) % 2 = 0), w AS (SELECT DISTINCT CAST(floor(ux*64) AS INT) AS x, CAST(floor(uy*64) AS INT) AS y FROM t) "
    "SELECT 6 AS z, w.x, w.y, CASE WHEN have.x IS NOT NULL THEN 3 END AS of_z, CASE WHEN have.x IS NOT NULL THEN (w.x % 8) / 8e0 END AS part_left, CASE WHEN have.x IS NOT NULL THEN (w.y % 8) / 8e0 END AS part_top "
    "FROM w LEFT JOIN have ON have.x = w.x // 8 AND have.y = w.y // 8"
)
def raster_covering(spark, sf_dir):
    """The picture, and the part of it, that stands for each tile of zoom 6 with events; every other picture is missing."""
    folder, _ = height_pictures(spark, sf_dir)
    wanted = event_points(spark, sf_dir).select(F.lit(6).alias("z"), geo.tile_x(F.col("lng"), 6).cast("int").alias("x"), geo.tile_y(F.col("lat"), 6).cast("int").alias("y")).distinct()
    have = rasters.read_pictures(spark, folder).where("(x + y) % 2 = 0")
    made = rasters.covering(wanted, have, DEM_ZOOM)
    return made.select("z", "x", "y", F.col("of_z").cast("int").alias("of_z"), F.col("left").alias("part_left"), F.col("top").alias("part_top"))


ASKED = "SELECT user_id, ts FROM events"


@query(
    f"WITH RECURSIVE let AS (SELECT user_id, min(ts) AS ts FROM ({ASKED}) GROUP BY user_id "
    f"UNION ALL SELECT e.user_id, min(e.ts) FROM ({ASKED}) e JOIN let ON e.user_id = let.user_id AND e.ts >= let.ts + INTERVAL 6 HOUR GROUP BY e.user_id) SELECT user_id, epoch_us(ts) AS at FROM let"
)
def asked_once(spark, sf_dir):
    """A user's requests, none within six hours of one that was let through."""
    made = events.asked_once(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", 6 * 3600)
    return made.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


CLICKS = "SELECT event_id, event_id * 7919 % 4096 + 0.5e0 AS x, event_id * 104729 % 4096 + 0.5e0 AS y FROM events WHERE event_type = 'click'"
#: Parts as polygons, customers as lines of two segments, suppliers as points.
LINE_POINTS = "SELECT c_custkey AS id, c_custkey * 7919 % 3800 * 1e0 AS x0, c_custkey * 104729 % 3800 * 1e0 AS y0, c_custkey % 290 * 1e0 AS dx, c_custkey * 31 % 280 * 1e0 AS dy FROM customer"


def spots(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", (e * 7919 % 4096 + 0.5).cast("double").alias("x"), (e * 104729 % 4096 + 0.5).cast("double").alias("y"))


def shapes(spark, sf_dir):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    b = part_boxes(spark, sf_dir)
    ring = F.array(*[point(F.col(x), F.col(y)) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))])
    polygons = b.select(F.concat(F.lit("p"), "id").alias("id"), F.lit(3).alias("kind"), F.array(ring).alias("parts"))
    k = F.col("c_custkey")
    x, y, dx, dy = k * 7919 % 3800, k * 104729 % 3800, k % 290, k * 31 % 280
    lines = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k).alias("id"), F.lit(2).alias("kind"), F.array(F.array(point(x, y), point(x + dx, y + dy), point(x + dx, y))).alias("parts"))
    s = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), s).alias("id"), F.lit(1).alias("kind"), F.array(F.array(point(s * 7919 % 4096, s * 104729 % 4096))).alias("parts"))
    return polygons.union(lines).union(points)


def distance_sql(x0, y0, x1, y1):
    t = f"greatest(0, least(1, CASE WHEN {x1} = {x0} AND {y1} = {y0} THEN 0e0 ELSE ((e.x-{x0})*({x1}-{x0}) + (e.y-{y0})*({y1}-{y0})) / (pow({x1}-{x0}, 2) + pow({y1}-{y0}, 2)) END))"
    return f"sqrt(pow(e.x - {x0} - {t} * ({x1}-{x0}), 2) + pow(e.y - {y0} - {t} * ({y1}-{y0}), 2))"


HITS = (
    f"SELECT event_id, 'p' || id AS id FROM ({CLICKS}) e JOIN ({BOXES}) b ON e.x > minx AND e.x < maxx AND e.y > miny AND e.y < maxy "
    f"UNION ALL SELECT event_id, 'c' || id FROM ({CLICKS}) e JOIN ({LINE_POINTS}) l ON e.x BETWEEN x0 - 5 AND x0 + dx + 5 AND least({distance_sql('x0', 'y0', 'x0+dx', 'y0+dy')}, {distance_sql('(x0+dx)', '(y0+dy)', '(x0+dx)', 'y0')}) <= 4.5 "
    f"UNION ALL SELECT event_id, 's' || s_suppkey FROM ({CLICKS}) e JOIN supplier ON sqrt(pow(s_suppkey * 7919 % 4096 - e.x, 2) + pow(s_suppkey * 104729 % 4096 - e.y, 2)) <= 6"
)


@query(f"SELECT event_id, count(*) AS n, min(id) AS first, max(id) AS last FROM ({HITS}) GROUP BY event_id")
def layer_events(spark, sf_dir):
    """Clicks with the polygons, lines and points that they hit."""
    met = events.with_hits(spots(spark, sf_dir), shapes(spark, sf_dir))
    return met.groupBy("event_id").agg(F.sum("n_hits").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


@query(HITS)
def stream_layer_events(spark, sf_dir):
    """The same over a stream of clicks in four batches, joined with the features as they stand."""
    stream = stateful.replayed(spots(spark, sf_dir), "event_id", 4)
    blocks = stateful.drained(stream, each=lambda batch: events.hit_blocks(batch, shapes(batch.sparkSession, sf_dir)))
    return events.pairs(blocks).select("event_id", "id")


@query("SELECT user_id, event_type AS name, round(arg_max(value, event_id), 4) AS value FROM events WHERE event_type <> 'error' OR event_id % 2 = 0 GROUP BY ALL HAVING arg_max(event_type, event_id) <> 'error' ORDER BY 1")
def stream_feature_state(spark, sf_dir):
    """Each user's last value of each type, errors taken back, over a stream whose batches come in no order of their own."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error' OR event_id % 2 = 0")
    changes = e.select(F.col("user_id").cast("string").alias("feature"), F.col("event_type").alias("name"), F.when(F.col("event_type") != "error", F.col("value")).cast("string").alias("value"), "event_id", (F.col("event_id") * 7919 % 10_007).alias("arrival"))
    states = stateful.drained(stateful.feature_states(stateful.replayed(changes, "arrival", 3), "feature", "name", "value", "event_id"), "update")
    last = states.groupBy("feature").agg(F.max_by("state", "batch").alias("state"))
    return last.select(F.col("feature").cast("long").alias("user_id"), F.explode("state").alias("name", "value")).select("user_id", "name", F.round(F.col("value").cast("double"), 4).alias("value"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, count(*) OVER w AS n, sum(event_id % 50) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING)) WHERE n <= 20 AND b <= 400")
def stream_cache(spark, sf_dir):
    """What is left in each user's cache after a stream of entries: the changes of all batches, folded."""
    puts = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("cache"), F.col("event_id").cast("string").alias("key"), F.col("event_id").alias("added"), (F.col("event_id") % 50).alias("bytes"))
    changes = stateful.drained(stateful.cache_changes(stateful.replayed(puts, "added", 3), "cache", "key", "added", "bytes", 20, 400))
    left = changes.groupBy("cache", "key").agg(F.max_by("change", "batch").alias("change")).where("change = 'put'")
    return left.select(F.col("cache").cast("long").alias("user_id"), F.col("key").cast("long").alias("event_id"))


@query(
    f"WITH RECURSIVE let AS (SELECT user_id, min(ts) AS ts FROM ({ASKED}) GROUP BY user_id "
    f"UNION ALL SELECT e.user_id, min(e.ts) FROM ({ASKED}) e JOIN let ON e.user_id = let.user_id AND e.ts >= let.ts + INTERVAL 6 HOUR GROUP BY e.user_id) SELECT user_id, epoch_us(ts) AS at FROM let"
)
def stream_asked_once(spark, sf_dir):
    """asked_once over a stream that closes with a far later request."""
    asked = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.col("ts").cast("timestamp").alias("ts"))
    last = asked.agg(F.lit("end").alias("url"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    stream = stateful.replayed(asked.union(last), "ts", 3)
    made = stateful.drained(stateful.asked_once_stream(stream, "url", "ts", 6 * 3_600_000)).where("url <> 'end'")
    return made.select(F.col("url").cast("long").alias("user_id"), F.unix_micros("ts").alias("at"))


@query(f"SELECT s_suppkey AS a, id AS b FROM (SELECT s_suppkey, s_suppkey * 7919 % 3900 AS qx, s_suppkey * 104729 % 3900 AS qy FROM supplier) JOIN ({BOXES}) ON minx <= qx + 150 AND maxx >= qx AND miny <= qy + 150 AND maxy >= qy WHERE id % 5 <> 2")
def boxes_stored(spark, sf_dir):
    """A store of boxes filled in two parts, some taken out again, asked for a box of each supplier."""
    boxes = part_boxes(spark, sf_dir).select("id", "minx", "miny", "maxx", "maxy")
    store = BoxStore(spark, new_folder(spark, "boxes"), per_file=250)
    store.insert(boxes.where("id % 3 = 0"))
    store.insert(boxes.where("id % 3 <> 0"))
    store.remove(boxes.where("id % 5 = 2"))
    s = F.col("s_suppkey")
    asked = table(spark, sf_dir, "supplier").select(s.alias("id"), (s * 7919 % 3900).alias("minx"), (s * 104729 % 3900).alias("miny"))
    asked = asked.withColumns({"maxx": F.col("minx") + 150, "maxy": F.col("miny") + 150})
    return store.search_many(asked, 64.0)


@query("SELECT 'u' || user_id AS url, max(event_id) AS event_id, count(*) FILTER (event_type = 'click') > 0 AS clicked FROM events GROUP BY user_id")
def cached_answers(spark, sf_dir):
    """Answers captured for each user, each written over by later ones, through the cache's data source."""
    answer_cache.register(spark)
    path = new_folder(spark, "answers")
    e = table(spark, sf_dir, "events")
    for part in ("event_type <> 'click'", "event_type = 'click'"):
        told = e.where(part).select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("event_id").cast("string").cast("binary").alias("data"), F.col("event_type").alias("mime"), F.timestamp_seconds("event_id").alias("added_at"))
        told.write.format("answer_cache").option("path", path).option("parts", 8).mode("append").save()
    kept = spark.read.format("answer_cache").option("path", path).load()
    clicked = e.groupBy(F.concat(F.lit("u"), "user_id").alias("url")).agg((F.count_if(F.col("event_type") == "click") > 0).alias("clicked"))
    return kept.join(clicked, "url").select("url", F.col("data").cast("string").cast("long").alias("event_id"), "clicked")


@query("SELECT user_id, string_agg(event_type[1:1], '' ORDER BY event_id) AS path FROM events GROUP BY user_id")
def reduced_in_order(spark, sf_dir):
    """Each user's events as one word, put together by a function that minds the order."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.left("event_type", F.lit(1)).alias("path"))
    return clusters.reduced_in_order(e, "user_id", ["event_id"], "path", lambda a, b: a + b)
