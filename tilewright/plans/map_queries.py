"""Queries over tiles in view, regions, symbols, collections, terrain meshes, caches and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import elevation, geo, geometry
from tilewright.functions.expressions import Scope
from tilewright.operators import clusters, spatial, symbols, tables
from tilewright.sources import geojson, vector_tiles
from tilewright.sources.views import BOXES, EV, LINES, event_clumps, event_points, order_lines, part_boxes, table
from tilewright.streaming import events

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


RANGE = f"SELECT id, CAST(floor(minx/256e0) AS INT) AS x0, CAST(floor(miny/256e0) AS INT) AS y0, CAST(ceil((maxx+600)/256e0)-1 AS INT) AS x1, CAST(ceil((maxy+600)/256e0)-1 AS INT) AS y1 FROM ({BOXES})"


@query(f"SELECT id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, row_number() OVER (PARTITION BY id ORDER BY sqrt(pow(x-(x0+x1)/2e0,2)+pow(y-(y0+y1)/2e0,2)), y, x) AS turn FROM (SELECT *, unnest(range(x0, x1+1)) AS x FROM ({RANGE})) AS a, unnest(range(y0, y1+1)) AS u(y)")
def tiles_in_view(spark, sf_dir):
    from pyspark.sql.window import Window

    r = geo.tile_range(F.col("minx"), F.col("miny"), F.col("maxx") + 600, F.col("maxy") + 600)
    made = geo.visible_tiles(part_boxes(spark, sf_dir).select("id", r.alias("r")).select("id", "r.*"))
    return made.select("id", "x", "y", F.row_number().over(Window.partitionBy("id").orderBy("from_centre", "y", "x")).cast("long").alias("turn"))


@query("SELECT id, ((minx-2000)%16+16)%16 AS x, (miny-2000) >= 0 AND (miny-2000) < 16 AS valid, greatest(3, least(9, p_size%15)) AS zoom, minx || ':' || miny || ':4' AS key, CAST(miny AS INT) AS back FROM (SELECT b.*, p_size FROM ({}) b JOIN part ON p_partkey = id)".format(BOXES))
def tile_places(spark, sf_dir):
    b = part_boxes(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id")
    x, y = F.col("minx") - 2000, F.col("miny") - 2000
    key = geo.tile_key(F.col("minx"), F.col("miny"), 4)
    return b.select("id", geo.wrap_tile(x, 4).cast("long").alias("x"), geo.is_valid_tile(x, y, 4).alias("valid"), geo.native_zoom(F.col("p_size") % 15, 3, 9).alias("zoom"), key.alias("key"), geo.key_tile(key).y.alias("back"))


@query()
def tiles_retained(spark, sf_dir):
    """Tested by walking up and down from each tile."""
    ev = event_points(spark, sf_dir)
    at = lambda z: ev.select(F.lit(z).alias("z"), geo.tile_x(F.col("lng"), z).alias("x"), geo.tile_y(F.col("lat"), z).alias("y")).distinct()
    some = lambda z, keep, active: at(z).where(keep).withColumns({"active": F.lit(active), "loaded": F.lit(True)})
    loaded = some(2, "x % 3 = 0", True).union(some(4, "(x + y) % 2 = 0", False)).union(some(6, "x % 2 = 1", True)).union(some(7, "y % 2 = 1", True))
    return geo.retained(at(5), loaded)


IN_BOX = "x BETWEEN (5200-(id%64)*512)*8 AND (5900-(id%64)*512)*8 AND y BETWEEN (5300-(id%61)*512)*8 AND (6000-(id%61)*512)*8"


@query(f"SELECT DISTINCT id, 'lines' AS layer FROM ({LINES}) WHERE {IN_BOX}")
def query_region_box(spark, sf_dir):
    lines = order_lines(spark, sf_dir)
    tiles = lines.select("id", (F.col("id") % 64).alias("x"), (F.col("id") % 61).alias("y"), F.lit(4096).alias("extent"), F.lit(2).alias("kind"), F.array("vertices").alias("parts"), geometry.bounds(F.col("vertices")).alias("box"), F.lit("orders").alias("source"))
    layers = [{"id": "lines", "type": "line", "source-layer": "orders"}]
    found = spatial.query_region(tiles, lambda df: Scope.of(df, ["id"]), "source", layers, box=(5200, 5300, 5900, 6000))
    return found.select("id", "layer")


SPOT = "(lng+180)/360*512 AS wx, (85-lat)/170*512 AS wy"


@query(f"SELECT event_id, 'spots' AS layer FROM (SELECT event_id, {SPOT} FROM ({EV})) WHERE sqrt(pow(wx-250,2)+pow(wy-260,2)) <= 6")
def query_region_point(spark, sf_dir):
    p = F.struct(((F.col("lng") + 180) / 360 * 4096).alias("x"), ((85 - F.col("lat")) / 170 * 4096).alias("y"))
    rows = event_points(spark, sf_dir).select("event_id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(4096).alias("extent"), F.lit(1).alias("kind"), F.array(F.array(p)).alias("parts"), F.lit("all").alias("source"))
    rows = rows.withColumn("box", geometry.bounds(F.flatten("parts")))
    found = spatial.query_region(rows, lambda df: Scope.of(df, ["event_id"]), "source", [{"id": "spots", "type": "circle", "source-layer": "all"}], point=(250, 260))
    return found.select("event_id", "layer")


@query(
    f"WITH RECURSIVE b AS (SELECT row_number() OVER (ORDER BY id) AS k, id, minx, miny, maxx + 300 AS maxx, maxy + 300 AS maxy, CASE WHEN id % 3 > 0 THEN id % 5 END AS p FROM ({BOXES})), "
    "r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT, p BIGINT)[]) AS kept UNION ALL "
    "SELECT b.k, CASE WHEN len(list_filter(r.kept, lambda o: o.x0 <= b.maxx AND o.x1 >= b.minx AND o.y0 <= b.maxy AND o.y1 >= b.miny AND (o.p IS NULL OR b.p IS NULL OR o.p >= b.p))) = 0 "
    "THEN list_append(r.kept, {'id': b.id, 'x0': b.minx, 'y0': b.miny, 'x1': b.maxx, 'y1': b.maxy, 'p': b.p}) ELSE r.kept END FROM r JOIN b ON b.k = r.k + 1) "
    "SELECT unnest(kept).id AS seq FROM r WHERE k = (SELECT max(k) FROM b)"
)
def symbols_placed(spark, sf_dir):
    b = part_boxes(spark, sf_dir).select(F.col("id").alias("seq"), "minx", "miny", (F.col("maxx") + 300).alias("maxx"), (F.col("maxy") + 300).alias("maxy"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).cast("double").alias("priority"))
    return symbols.placed(b).select("seq")


@query("SELECT event_id, event_id % 100 - length(event_type)*10*16/24e0/2 AS minx, event_id % 50 - 20*16/24e0 AS miny, event_id % 100 + greatest(length(event_type)*10*16/24e0/2, 12) AS right_side, event_id % 50 + 12e0 AS maxy FROM events WHERE length(event_type)*10*16/24e0/2 >= 12")
def symbol_boxes(spark, sf_dir):
    x, y, t = (F.col("event_id") % 100).cast("double"), (F.col("event_id") % 50).cast("double"), F.col("event_type")
    box = symbols.symbol_box(x, y, t, symbols.text_size(t, {}, 20.0, 10.0), F.lit(16.0), F.lit(24.0))
    rows = table(spark, sf_dir, "events").where(F.length("event_type") * 10 * 16 / 24 / 2 >= 12)
    return rows.select("event_id", box.minx.alias("minx"), box.miny.alias("miny"), box.maxx.alias("right_side"), box.maxy.alias("maxy"))


@query()
def icon_shelves(spark, sf_dir):
    """Tested against one pass in order."""
    sprites = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("k"), F.col("p_partkey").alias("id"), (F.col("p_size") % 30 + 5).alias("w"), (F.col("p_size") % 17 + 3).alias("h"))
    return symbols.shelves(sprites, "p_brand", "k", 256)


@query(f"SELECT id, CAST(CASE WHEN id % 4 = 1 THEN -1 ELSE minx END AS BIGINT) AS minx FROM ({BOXES}) WHERE id % 3 <> 0 OR id % 4 = 1")
def boxes_upserted(spark, sf_dir):
    b = part_boxes(spark, sf_dir).select("id", "minx")
    kept = tables.removed(b, b.where("id % 3 = 0"), "id")
    return tables.upserted(kept, b.where("id % 4 = 1").withColumn("minx", F.lit(-1).cast("long")), "id")


@query(f"SELECT id, id % 7 = 0 AS has FROM ({BOXES})")
def boxes_held(spark, sf_dir):
    b = part_boxes(spark, sf_dir).select("id")
    return tables.held(b.where("id % 7 = 0"), b, "id")


@query(f"SELECT id, minx, maxy FROM ({BOXES})")
def boxes_tiled(spark, sf_dir):
    return tables.tiled(part_boxes(spark, sf_dir), 8).select("id", "minx", "maxy")


@query("SELECT user_id, count(*) AS entries, sum(event_id % 50) AS bytes FROM events GROUP BY user_id")
def cache_size(spark, sf_dir):
    return tables.sized(table(spark, sf_dir, "events").withColumn("size", F.col("event_id") % 50), "user_id", size="size")


@query("SELECT event_type, count(*) FILTER (event_id % 2 <> 0 AND event_id % 3 <> 0) AS saved, count(*) FILTER (event_id % 2 <> 0 AND event_id % 3 = 0) AS failed, count(*) FILTER (event_id % 2 = 0) AS skipped FROM events GROUP BY event_type")
def offline_region(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("url"), "event_id", "event_type")
    entry = lambda df: df.select("url", F.lit("d").alias("data"), F.lit("image/png").alias("mime"), F.col("event_id").alias("added_at"))
    done = tables.read_through(rows, entry(rows.where("event_id % 2 = 0")), entry(rows.where("event_id % 3 <> 0")), F.lit(0))
    return tables.offline_counts(done, "event_type")


@query(
    "WITH v AS (SELECT s_suppkey, i, j, i*1.5e0 AS du, j*1.5e0 AS dv FROM supplier, range(3) AS a(i), range(3) AS b(j)) "
    "SELECT s_suppkey, CAST(j*3+i AS INT) AS vertex, i*2e0 AS x, j*2e0 AS y, round((s_suppkey+du+10*dv)*2, 6) AS z, round(-1.5e0/sqrt(1.5*1.5+15*15+1), 6) AS nx, round(-15e0/sqrt(1.5*1.5+15*15+1), 6) AS ny FROM v"
)
def terrain_mesh(spark, sf_dir):
    grid = F.array(*[F.col("s_suppkey") + float(x + 10 * y) for y in range(4) for x in range(4)])
    tiles = table(spark, sf_dir, "supplier").select("s_suppkey", grid.alias("grid"))
    made = elevation.mesh_vertices(tiles, 4, 4.0, 2, 2.0)
    return made.select("s_suppkey", "vertex", "x", "y", *[F.round(c, 6).alias(c) for c in ("z", "nx", "ny")])


@query(
    "WITH t AS (SELECT s_suppkey, (j*2+i)*2+k AS triangle, j*3+i+k AS a, j*3+i+3 AS b, j*3+i+1+k*3 AS c FROM supplier, range(2) AS x(i), range(2) AS y(j), range(2) AS z(k)) "
    "SELECT s_suppkey, triangle, a, b, c, round(2*s_suppkey + (1.5e0*(a%3+b%3+c%3) + 15e0*(a//3+b//3+c//3))*2/3, 6) AS height FROM t"
)
def terrain_triangles(spark, sf_dir):
    """The triangles of each supplier's tile with the mean height of their corners."""
    grid = F.array(*[F.col("s_suppkey") + float(x + 10 * y) for y in range(4) for x in range(4)])
    made = elevation.mesh_vertices(table(spark, sf_dir, "supplier").select("s_suppkey", grid.alias("grid")), 4, 4.0, 2, 2.0)
    heights = made.groupBy("s_suppkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("vertex").cast("long").alias("vertex"), "z"))).alias("z"))  # nine a tile
    each = heights.withColumn("triangle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    each = each.withColumn("t", elevation.triangle_corners(F.col("triangle"), 2)).select("s_suppkey", "z", "triangle", "t.*")
    corner = lambda c: F.element_at("z", F.col(c))
    return each.select("s_suppkey", "triangle", "a", "b", "c", F.round((corner("a") + corner("b") + corner("c")) / 3, 6).alias("height"))


HEAT = [(0.4, (0, 0, 255)), (0.6, (0, 255, 255)), (0.7, (0, 255, 0)), (0.8, (255, 255, 0)), (1.0, (255, 0, 0))]


def ramp_sql(k):
    cases = [f"WHEN t <= 0.4 THEN {HEAT[0][1][k]}"]
    cases += [f"WHEN t < {b} THEN {p[k]} + ({q[k] - p[k]})*(t-{a}e0)/({b}e0-{a}e0)" for (a, p), (b, q) in zip(HEAT, HEAT[1:], strict=False)]
    return f"CAST(floor(CASE {' '.join(cases)} ELSE {HEAT[-1][1][k]} END + 0.5) AS INT)"


@query(f"SELECT event_id, {ramp_sql(0)} AS r, {ramp_sql(1)} AS g, {ramp_sql(2)} AS b, CAST(event_id % 256 AS INT) AS a FROM (SELECT event_id, event_id % 256 / 255e0 AS t FROM events)")
def heat_ramp(spark, sf_dir):
    made = elevation.heat_color((F.col("event_id") % 256) / F.lit(255.0))
    return table(spark, sf_dir, "events").select("event_id", *[made[c].alias(c) for c in "rgba"])


@query("SELECT event_id, CAST(round(l*200+(1-l)*40) AS INT) AS r, CAST(round(l*100+(1-l)*20) AS INT) AS g, CAST(128 AS INT) AS a FROM (SELECT event_id, event_id % 101 / 100e0 AS l FROM events)")
def hillshade_blend(spark, sf_dir):
    made = elevation.shaded((F.col("event_id") % 101) / F.lit(100.0), (200, 100, 0), (40, 20, 0), 0.5)
    return table(spark, sf_dir, "events").select("event_id", made.r.alias("r"), made.g.alias("g"), made.a.alias("a"))


@query(
    "SELECT e.event_id, l.n_nationkey AS listener FROM events e JOIN nation l ON l.n_nationkey % 5 = e.user_id % 5 OR l.n_regionkey = 100 WHERE e.event_type = 'click' AND l.n_nationkey % 2 = 0 "
    "UNION ALL SELECT event_id, 1 FROM events WHERE event_type = 'click' UNION ALL SELECT min(event_id), 3 FROM events WHERE event_type = 'click'"
)
def event_dispatch(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), (F.col("user_id") % 5).alias("target"))
    n = table(spark, sf_dir, "nation")
    own = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("listener"), F.lit("click").alias("type"), (F.col("n_nationkey") % 5).cast("long").alias("target"), F.lit(False).alias("once"))
    of_map = spark.range(2).select((F.col("id") * 2 + 1).cast("int").alias("listener"), F.lit("click").alias("type"), F.lit(99).cast("long").alias("target"), (F.col("id") == 1).alias("once"))
    parents = spark.range(5).select(F.col("id").alias("target"), F.lit(99).cast("long").alias("parent"))
    return events.dispatched(ev, own.union(of_map), parents).select("event_id", "listener")


@query()
def throttled_calls(spark, sf_dir):
    """Tested against one pass in order."""
    ev = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 37 % 100_003 / F.lit(10.0)).alias("at"), "event_id")
    return events.throttled(ev, "user_id", "at", 60.0)


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS completed, count(*) OVER (PARTITION BY event_type) AS total FROM events")
def job_progress(spark, sf_dir):
    done = events.progress(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id")
    return done.select("event_id", F.col("completed").cast("long").alias("completed"), "total")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_update(spark, sf_dir):
    return events.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", order=F.col("event_id"))


@query(f"SELECT event_id, round(lng - 180*2*value/40075017e0/cos(lat*pi()/180), 6) AS west, round(lat + 180*2*value/40075017e0, 6) AS north FROM ({EV})")
def location_bounds(spark, sf_dir):
    made = events.located(event_points(spark, sf_dir), accuracy="value")
    return made.select("event_id", F.round("bounds.west", 6).alias("west"), F.round("bounds.north", 6).alias("north"))


@query("SELECT event_id, coalesce(n, 0) AS n FROM events LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) USING (user_id)")
def feature_with_state(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    states = ev.where("event_type = 'click'").groupBy("user_id").agg(F.map_from_arrays(F.array(F.lit("n")), F.array(F.count(F.lit(1)))).alias("state"))
    return events.with_state(ev.select("event_id", "user_id"), states, "user_id").select("event_id", F.coalesce(F.element_at("state", "n"), F.lit(0)).alias("n"))


@query(f"SELECT id, count(*) AS n, round(sum(x), 3) AS sx, round(sum(y), 3) AS sy FROM ({LINES}) GROUP BY id")
def geojson_lines(spark, sf_dir):
    made = geojson.line_feature(F.col("vertices"), F.create_map(F.lit("a"), F.lit("b")), F.col("id"))
    back = geojson.read_features(order_lines(spark, sf_dir).select(made.alias("doc")), "doc", strict=True)
    flat = F.flatten(geojson.typed_parts(F.col("geometry_type"), F.col("coordinates")))
    sums = back.select(F.col("id").cast("long").alias("id"), flat.alias("p"))
    return sums.select("id", F.size("p").cast("long").alias("n"), F.round(geometry.total(F.col("p"), lambda p: p.x), 3).alias("sx"), F.round(geometry.total(F.col("p"), lambda p: p.y), 3).alias("sy"))


@query("SELECT id, 'Polygon' AS kind, 3 AS k, 4 AS points, round((id % 90) * 1e0, 6) AS x FROM (SELECT p_partkey AS id FROM part)")
def geojson_polygons(spark, sf_dir):
    x = (F.col("p_partkey") % 90).cast("double")
    ring = F.array(*[F.struct((x + a).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1))])
    docs = table(spark, sf_dir, "part").select(geojson.polygon_feature(F.array(ring), F.create_map(F.lit("a"), F.lit("b")), F.col("p_partkey")).alias("doc"))
    listed = docs.withColumn("doc", F.concat(F.lit("["), "doc", F.lit("]")))
    back = geojson.read_features(listed, "doc")
    parts = geojson.typed_parts(F.col("geometry_type"), F.col("coordinates"))
    ring = F.get(parts, F.lit(0))
    return back.select(F.col("id").cast("long").alias("id"), F.col("geometry_type").alias("kind"), F.col("kind").alias("k"), F.size(ring).alias("points"), F.round(F.get(ring, F.lit(0)).x, 6).alias("x"))


@query(f"WITH f AS (SELECT id, min(struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, x := x, y := y)) AS v FROM ({LINES}) GROUP BY id HAVING count(*) > 1) SELECT id, 'LineString' AS kind, round((v.x+(id%64)*4096)*360/(4096*64)-180, 6) AS lng, round(degrees(atan(sinh(pi()*(1-2*(v.y+(id%61)*4096)/(4096*64))))), 6) AS lat, id AS n FROM f")
def mvt_geojson(spark, sf_dir):
    line = F.transform("vertices", lambda p: F.struct(p.x.cast("int").alias("x"), p.y.cast("int").alias("y")))
    rows = order_lines(spark, sf_dir).where(F.size("vertices") > 1).select(
        F.lit(6).alias("z"), (F.col("id") % 64).cast("int").alias("x"), (F.col("id") % 61).cast("int").alias("y"), F.lit(4096).alias("extent"), "id", F.lit(vector_tiles.LINE).alias("kind"),
        F.to_json(F.struct(F.col("id").alias("n"))).alias("typed"), F.array(line).alias("parts"),
    )
    made = vector_tiles.to_geojson(rows)
    at = lambda k: F.round(F.get_json_object("geojson", f"$.geometry.coordinates[0][{k}]").cast("double"), 6)
    return made.select("id", F.get_json_object("geojson", "$.geometry.type").alias("kind"), at(0).alias("lng"), at(1).alias("lat"), F.get_json_object("geojson", "$.properties.n").cast("long").alias("n"))


@query(f"SELECT id, min(x) AS minx, max(y) AS maxy FROM ({LINES}) GROUP BY id")
def feature_boxes(spark, sf_dir):
    b = vector_tiles.feature_box(F.array("vertices"))
    return order_lines(spark, sf_dir).select("id", b.minx.alias("minx"), b.maxy.alias("maxy"))


@query(f"SELECT id, floor((min(x)/4096*90/360+0.5)*1024+0.5) - 3 AS minx, floor((max(x)/4096*90/360+0.5)*1024+0.5) + 3 AS maxx FROM ({LINES}) GROUP BY id")
def rings_projected(spark, sf_dir):
    rings = F.array(F.transform("vertices", lambda p: F.struct((p.x / 4096 * 90).alias("x"), (p.y / 4096 * 60).alias("y"))))
    made = geometry.projected_rings(rings, geo.EPSG3857, 2, 3.0)
    return order_lines(spark, sf_dir).select("id", made.box.minx.alias("minx"), made.box.maxx.alias("maxx"))


@query()
def lines_drawn(spark, sf_dir):
    """Tested segment by segment."""
    return order_lines(spark, sf_dir).select("id", geometry.drawn_line(F.col("vertices"), 500.0, 500.0, 3500.0, 3000.0).alias("parts"))


ALONG = "WINDOW w AS (PARTITION BY id ORDER BY l_linenumber, l_partkey, l_suppkey, x, y)"


@query(
    f"WITH p AS (SELECT *, row_number() OVER w AS k, x - lag(x) OVER w AS cx, y - lag(y) OVER w AS cy, lead(x) OVER w - x AS gx, lead(y) OVER w - y AS gy FROM ({LINES}) {ALONG}), "
    "u AS (SELECT id, k, coalesce(cx / nullif(hypot, 0), 0) + coalesce(gx / nullif(hypot2, 0), 0) AS ax, coalesce(cy / nullif(hypot, 0), 0) + coalesce(gy / nullif(hypot2, 0), 0) AS ay FROM (SELECT *, sqrt(cx*cx+cy*cy) AS hypot, sqrt(gx*gx+gy*gy) AS hypot2 FROM p)), "
    "n AS (SELECT id, k, coalesce(ax / nullif(sqrt(ax*ax+ay*ay), 0), 0) AS ax, coalesce(ay / nullif(sqrt(ax*ax+ay*ay), 0), 0) AS ay FROM u) "
    "SELECT id, 2*count(*) AS n, round(sum(-k*ay), 4) + 0 AS left_x, round(sum(k*ax), 4) + 0 AS left_y FROM n GROUP BY id HAVING count(*) > 1"
)
def lines_tessellated(spark, sf_dir):
    """Lines as strips: the number of vertices, and the normals of their left sides, each times its place."""
    made = order_lines(spark, sf_dir).where(F.size("vertices") > 1).select("id", geometry.tessellated(F.col("vertices")).alias("v"))
    left = F.filter("v", lambda p: p.side == 1)
    weighted = F.transform(left, lambda p, k: F.struct((p.nx * (k + 1)).alias("x"), (p.ny * (k + 1)).alias("y")))
    told = made.select("id", F.size("v").cast("long").alias("n"), weighted.alias("w"))
    return told.select("id", "n", *[(F.round(geometry.total(F.col("w"), lambda p, c=c: p[c]), 4) + 0).alias(f"left_{c}") for c in "xy"])


@query()
def cluster_tile(spark, sf_dir):
    """Tested against the levels themselves."""
    return clusters.tile(clusters.cluster(event_clumps(spark, sf_dir), "event_id", max_zoom=4, reduced={"top": (F.col("value"), F.max)}), 3, 2, 3)


@query("SELECT z, x, y FROM (SELECT 3 AS z, CAST(floor((s_suppkey*7%360)/45e0) AS INT) AS x, CAST(s_suppkey % 8 AS INT) AS y FROM supplier) GROUP BY ALL")
def terrain_tiles(spark, sf_dir):
    s = F.col("s_suppkey")
    tiles = table(spark, sf_dir, "supplier").select(F.lit(3).alias("z"), F.floor(s * 7 % 360 / 45).cast("int").alias("x"), (s % 8).cast("int").alias("y"), F.array_repeat(F.lit(1.0), 16).alias("grid"))
    return tables.checked_tiles(tiles, 4).where(F.size("grid") == 16).select("z", "x", "y").distinct()
