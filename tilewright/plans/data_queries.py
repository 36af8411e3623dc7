"""Queries over tiles' bytes, GeoJSON, clusters, rasters, state and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import elevation, geometry
from tilewright.operators import clusters
from tilewright.sources import geojson, vector_tiles
from tilewright.sources.views import CLUMP, EV, LINES, event_clumps, event_points, order_lines, table
from tilewright.streaming import state

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query(
    f"SELECT id, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, id AS whole, -id AS less, id / 4e0 AS quarter, id / 1e1 AS tenth, id % 2 = 0 AS even, 'o' || id AS name FROM ({LINES}) GROUP BY id"
)
def mvt_roundtrip(spark, sf_dir):
    """Lines written as tiles with properties of every kind, and read back."""
    line = F.transform("vertices", lambda p: F.struct(p.x.cast("int").alias("x"), p.y.cast("int").alias("y")))
    k = F.col("id")
    told = F.to_json(F.struct(k.alias("whole"), (-k).alias("less"), (k / 4).alias("quarter"), (k / 10).alias("tenth"), (k % 2 == 0).alias("even"), F.concat(F.lit("o"), k).alias("name")))
    made = order_lines(spark, sf_dir).select(
        F.lit(6).alias("z"), (k % 64).cast("int").alias("x"), (k % 61).cast("int").alias("y"), F.lit("orders").alias("layer"), "id", F.lit(vector_tiles.LINE).alias("kind"), told.alias("typed"), F.array(line).alias("parts")
    )
    back = vector_tiles.read_tiles(vector_tiles.write_tiles(made))
    flat = F.flatten("parts")
    own = F.from_json("typed", "whole long, less long, quarter double, tenth double, even boolean, name string")
    sums = [geometry.total(flat, lambda p, c=c: p[c].cast("double")).cast("long").alias(f"s{c}") for c in "xy"]
    return back.select("id", F.size(flat).cast("long").alias("n"), *sums, own.alias("p")).select("id", "n", "sx", "sy", "p.*")


@query(f"SELECT event_id, event_type, round(lng, 6) AS lng, round(lat, 6) AS lat FROM ({EV})")
def geojson_roundtrip(spark, sf_dir):
    ev = event_points(spark, sf_dir)
    text = geojson.point_feature(F.col("lng"), F.col("lat"), F.struct("event_type"), F.col("event_id"))
    back = geojson.read_features(ev.select(text.alias("doc")), "doc").where("kind = 1")
    spot = F.from_json("coordinates", "array<double>")
    return back.select(F.col("id").cast("long").alias("event_id"), F.col("properties")["event_type"].alias("event_type"), spot[0].alias("lng"), spot[1].alias("lat"))


@query(f"SELECT CAST(z AS INT) AS zoom, n FROM (SELECT count(*) AS n FROM ({CLUMP})), range(18) AS r(z)")
def cluster_conservation(spark, sf_dir):
    levels = clusters.cluster(event_clumps(spark, sf_dir), "event_id")
    return levels.groupBy("zoom").agg(F.sum("n").alias("n"))


@query()
def cluster_levels(spark, sf_dir):
    """Tested against a greedy pass in order."""
    return clusters.cluster(event_clumps(spark, sf_dir), "event_id", sums={"value": F.col("value")}).withColumn("label", clusters.abbreviated(F.col("n")))


RGB = "event_id % 256 AS r, event_id * 31 % 256 AS g, event_id * 17 % 256 AS b"


@query(f"SELECT event_id, round((r*65536+g*256+b)*0.1e0-10000, 4) AS height FROM (SELECT event_id, {RGB} FROM events)")
def dem_decode_tenths(spark, sf_dir):
    px = table(spark, sf_dir, "events").selectExpr("event_id", *RGB.split(", "))
    return px.select("event_id", F.round(elevation.rgb_tenths(F.col("r"), F.col("g"), F.col("b")), 4).alias("height"))


@query(f"SELECT event_id, r*256+g+b/256e0-32768 AS height FROM (SELECT event_id, {RGB} FROM events)")
def dem_decode_fractions(spark, sf_dir):
    px = table(spark, sf_dir, "events").selectExpr("event_id", *RGB.split(", "))
    return px.select("event_id", elevation.rgb_fractions(F.col("r"), F.col("g"), F.col("b")).alias("height"))


@query(
    "WITH e AS (SELECT event_id, (event_id % 40) / 10e0 - 0.5 AS qx, (event_id % 36) / 10e0 - 0.3 AS qy FROM events), c AS (SELECT event_id, greatest(0, least(3, qx)) AS x, greatest(0, least(3, qy)) AS y FROM e) "
    "SELECT event_id, round(x*x0 + y*10, 6) AS height FROM (SELECT *, 1 AS x0 FROM c)"
)
def dem_bilinear(spark, sf_dir):
    grid = F.array(*[F.lit(float(x + 10 * y)) for y in range(4) for x in range(4)])
    e = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 40) / F.lit(10.0) - 0.5).alias("qx"), ((F.col("event_id") % 36) / F.lit(10.0) - 0.3).alias("qy"))
    return e.select("event_id", F.round(elevation.bilinear(grid, 4, F.col("qx"), F.col("qy")), 6).alias("height"))


@query(f"SELECT event_id, CASE WHEN floor((lng+180)/360*4) = 1 AND floor((1-ln(tan(lat*pi()/180)+1/cos(lat*pi()/180))/pi())/2*4) = 1 THEN 2e0 ELSE 0e0 END AS elevation FROM ({EV})")
def dem_pyramid_lookup(spark, sf_dir):
    flat = lambda z, x, y: spark.range(1).select(F.lit(z).alias("z"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.array_repeat(F.lit(float(z)), 16).alias("grid"))
    ev = event_points(spark, sf_dir).select("event_id", "lng", "lat")
    return elevation.query_elevation(ev, flat(0, 0, 0).union(flat(2, 1, 1)), 4, 5).select("event_id", "elevation")


@query(
    "WITH p AS (SELECT event_id // 64 AS tile, event_id % 8 AS px, event_id // 8 % 8 AS py, event_id * 31 % 97 * 1e0 AS height FROM events), "
    "w AS (SELECT p.*, coalesce(e.height, CASE WHEN p.px = 7 THEN p.height END) AS e, coalesce(w.height, CASE WHEN p.px = 0 THEN p.height END) AS w, coalesce(n.height, CASE WHEN p.py = 0 THEN p.height END) AS n, coalesce(s.height, CASE WHEN p.py = 7 THEN p.height END) AS s "
    "FROM p LEFT JOIN p e ON e.tile = p.tile AND e.px = p.px + 1 AND e.py = p.py LEFT JOIN p w ON w.tile = p.tile AND w.px = p.px - 1 AND w.py = p.py LEFT JOIN p n ON n.tile = p.tile AND n.px = p.px AND n.py = p.py - 1 LEFT JOIN p s ON s.tile = p.tile AND s.px = p.px AND s.py = p.py + 1), "
    "d AS (SELECT *, (e - w) * 0.25e0 AS dx, (s - n) * 0.25e0 AS dy FROM w) "
    "SELECT tile, px, py, round(greatest(0e0, (-dx*sin(radians(335))*cos(radians(45)) + dy*cos(radians(335))*cos(radians(45)) + sin(radians(45))) / sqrt(dx*dx+dy*dy+1)), 5) AS light FROM d WHERE dx IS NOT NULL AND dy IS NOT NULL"
)
def hillshade(spark, sf_dir):
    e = F.col("event_id")
    px = table(spark, sf_dir, "events").select(F.floor(e / 64).alias("tile"), (e % 8).alias("px"), (F.floor(e / 8) % 8).alias("py"), (e * 31 % 97).cast("double").alias("height"))
    return elevation.hillshade(px, 8).where("light IS NOT NULL").select("tile", "px", "py", F.round("light", 5).alias("light"))


@query(
    "WITH p AS (SELECT event_id * 37 % 256 AS px, event_id * 53 % 256 AS py, greatest(0.05e0, least(1e0, value / 400)) AS w FROM events), "
    "a AS (SELECT px + dx AS px, py + dy AS py, w * (1 - sqrt(dx*dx + dy*dy) / 4e0) AS alpha FROM p, range(-4, 5) AS r(dx), range(-4, 5) AS s(dy) WHERE dx*dx + dy*dy < 16) "
    "SELECT px, py, round(CASE WHEN max(alpha) >= 1 THEN 1 ELSE 1 - exp(sum(CASE WHEN alpha < 1 THEN ln(1 - alpha) END)) END, 5) AS density FROM a GROUP BY px, py"
)
def heat_density(spark, sf_dir):
    p = table(spark, sf_dir, "events").select((F.col("event_id") * 37 % 256).alias("px"), (F.col("event_id") * 53 % 256).alias("py"), (F.col("value") / 400).alias("weight"))
    return elevation.heat(p, 4).select("px", "py", F.round("density", 5).alias("density"))


@query("SELECT user_id, count(*) AS names, round(sum(v), 4) AS total FROM (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY ALL) WHERE event_type <> 'error' GROUP BY user_id")
def feature_state_merge(spark, sf_dir):
    changes = table(spark, sf_dir, "events").withColumn("set", F.when(F.col("event_type") != "error", F.col("value")))
    s = state.merged_state(changes, ["user_id"], ["event_id"], "event_type", "set")
    values = F.map_values("state")
    return s.select("user_id", F.size(values).cast("long").alias("names"), F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("SELECT event_id FROM events WHERE 10000 - event_id <= 5000")
def tile_cache_ttl(spark, sf_dir):
    return state.live(table(spark, sf_dir, "events").withColumn("added_at", F.col("event_id")), F.lit(10000), 5000).select("event_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, count(*) OVER w AS n, sum(event_id % 50) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING)) WHERE n <= 20 AND b <= 400")
def tile_cache_evict(spark, sf_dir):
    cached = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("added_at"), (F.col("event_id") % 50).alias("bytes"))
    return state.evicted(cached, ["user_id"], "event_id", 20, 400).select("user_id", "event_id")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark, sf_dir):
    made = state.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", "event_type")
    return made.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 - 3600 * k AS start, event_type, count(*) AS n FROM events, range(3) AS r(k) GROUP BY ALL")
def window_sliding(spark, sf_dir):
    made = state.sliding(table(spark, sf_dir, "events"), "ts", "3 hours", "1 hour", "event_type")
    return made.select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query(
    "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k"
)
def window_session(spark, sf_dir):
    made = state.sessions(table(spark, sf_dir, "events"), "ts", "2 hours", "user_id")
    return made.select("user_id", F.unix_micros("start").alias("start"), "n")
