"""Queries over features: selection, hit tests, spatial joins and planar geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import geo, geometry
from tilewright.functions.expressions import Scope
from tilewright.operators import spatial
from tilewright.sources.views import BOXES, CLUMP, EV, LINES, event_clumps, event_points, order_lines, part_boxes

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


LAYERS = [
    {"id": "clicks", "type": "circle", "source-layer": "click", "filter": [">", ["get", "value"], 50], "paint": {"circle-radius": ["interpolate", ["linear"], ["get", "value"], 0, 2, 100, 12]}},
    {"id": "views", "type": "circle", "source-layer": "view", "filter": ["<", ["get", "k"], 20], "paint": {"circle-color": "red"}},
    {"id": "views-all", "type": "circle", "source-layer": "view"},
    {"id": "hidden", "type": "circle", "source-layer": "view", "layout": {"visibility": "none"}},
]


def scope_of(df):
    return Scope.of(df, ["event_type", "value", "user_id", "k"], geometry_type=F.lit(1), id="event_id")


@query(f"SELECT event_id, value FROM ({EV}) WHERE event_type = 'click' AND value > 20")
def query_source(spark, sf_dir):
    ev = event_points(spark, sf_dir)
    return spatial.query_source(ev, scope_of(ev), "event_type", "click", [">", ["get", "value"], 20]).select("event_id", "value")


@query(f"SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS r FROM ({EV})) WHERE r = 1")
def query_source_dedup(spark, sf_dir):
    return spatial.first_of_each(event_points(spark, sf_dir).select("event_type", "user_id", "event_id"), "event_type", "user_id", ["event_id"])


@query(
    f"SELECT event_id, 'clicks' AS layer FROM ({EV}) WHERE event_type = 'click' AND value > 50 UNION ALL SELECT event_id, 'views' FROM ({EV}) WHERE event_type = 'view' AND k < 20 "
    f"UNION ALL SELECT event_id, 'views-all' FROM ({EV}) WHERE event_type = 'view'"
)
def query_rendered_all(spark, sf_dir):
    ev = event_points(spark, sf_dir)
    return spatial.query_layers(ev, scope_of(ev), "event_type", LAYERS).select("event_id", "layer")


@query(f"SELECT event_id, 'views-all' AS layer FROM ({EV}) WHERE event_type = 'view' AND (lng-10)*(lng-10)+(lat-20)*(lat-20) <= 900")
def query_rendered_point(spark, sf_dir):
    ev = event_points(spark, sf_dir).where(F.col("lng").between(-20, 40) & F.col("lat").between(-10, 50))
    ev = ev.where(spatial.hits(F.lit(1), 10, 20, F.array(geometry.point(F.col("lng"), F.col("lat"))), F.lit(30.0)))
    return spatial.query_layers(ev, scope_of(ev), "event_type", LAYERS, ["views-all"]).select("event_id", "layer")


@query(f"SELECT event_id, 'clicks' AS layer FROM ({EV}) WHERE event_type = 'click' AND value > 50 AND lng BETWEEN -30 AND 60 AND lat BETWEEN 0 AND 45")
def query_rendered_bbox(spark, sf_dir):
    ev = event_points(spark, sf_dir).where(F.col("lng").between(-30, 60) & F.col("lat").between(0, 45))
    return spatial.query_layers(ev, scope_of(ev), "event_type", LAYERS, ["clicks"]).select("event_id", "layer")


@query(f"SELECT event_id, round(CASE WHEN value <= 0 THEN 2 WHEN value >= 100 THEN 12 ELSE 2+value/10 END, 6) AS radius, '#000' AS color FROM ({EV}) WHERE event_type = 'click' AND value > 50")
def style_layer_projection(spark, sf_dir):
    ev = event_points(spark, sf_dir)
    made = spatial.style_columns(LAYERS[0], scope_of(ev), spatial.PAINT_DEFAULTS["circle"])
    kept = spatial.query_source(ev, scope_of(ev), "event_type", "click", LAYERS[0]["filter"])
    return kept.select("event_id", F.round(made["circle-radius"], 6).alias("radius"), made["circle-color"].alias("color"))


@query(f"SELECT event_id, 3 AS n, 'rgba(' || repeat(CAST(CAST(floor(0.5*255+0.5) AS INT) AS VARCHAR) || ',', 3) || '1)' AS middle FROM ({EV})")
def line_gradient(spark, sf_dir):
    ev = event_points(spark, sf_dir)
    ramp = ["interpolate", ["linear"], ["line-progress"], 0, "black", 1, "white"]
    made = spatial.line_gradient(ramp, ev, lambda df, p: Scope.of(df, ["value"], line_progress=p), "event_id", (0.0, 0.5, 1.0))
    return made.select("event_id", F.size("stops").alias("n"), F.get("stops", F.lit(1)).color.alias("middle"))


RING = [(-60.0, -40.0), (80.0, -30.0), (100.0, 50.0), (10.0, 10.0), (-70.0, 60.0)]
HOLE = [(-10.0, -20.0), (20.0, -20.0), (20.0, 0.0), (-10.0, 0.0)]


def even_odd_sql(rings):
    parts = []
    for ring in rings:
        for (ax, ay), (bx, by) in zip([ring[-1], *ring[:-1]], ring, strict=True):
            parts.append(f"CASE WHEN ({ay}>lat)<>({by}>lat) AND lng<({bx}-({ax}))*(lat-({ay}))/({by - ay if by != ay else 1})+({ax}) THEN 1 ELSE 0 END")
    return f"({'+'.join(parts)})%2=1"


def rings_column(*rings):
    return F.array(*[F.array(*[geometry.point(x, y) for x, y in ring]) for ring in rings])


@query(f"SELECT event_id FROM ({EV}) WHERE {even_odd_sql([RING, HOLE])}")
def point_in_polygon(spark, sf_dir):
    inside = geometry.in_polygon(F.col("lng"), F.col("lat"), rings_column(RING, HOLE))
    return event_points(spark, sf_dir).where(F.col("lng").between(-70, 100) & F.col("lat").between(-40, 60)).where(inside).select("event_id")


@query(
    f"WITH t AS (SELECT event_id, lng, lat, greatest(0, least(1, ((lng+100)*180+(lat+50)*90)/(180*180+90*90))) AS t FROM ({EV})) "
    "SELECT event_id, round(sqrt(pow(lng+100-180*t,2)+pow(lat+50-90*t,2)), 4) AS distance FROM t"
)
def segment_distance(spark, sf_dir):
    d = geometry.distance_to_segment(F.col("lng"), F.col("lat"), geometry.point(-100, -50), geometry.point(80, 40))
    return event_points(spark, sf_dir).select("event_id", F.round(d, 4).alias("distance"))


@query(f"SELECT id FROM ({BOXES}) WHERE minx <= 3000 AND maxx >= 500 AND miny <= 2500 AND maxy >= 700")
def bbox_search(spark, sf_dir):
    b = part_boxes(spark, sf_dir)
    return b.where("minx <= 3000 AND maxx >= 500 AND miny <= 2500 AND maxy >= 700").select("id")


@query(f"SELECT id, (maxx-minx)*(maxy-miny) AS area, greatest(0, least(maxx,3000)-greatest(minx,500))*greatest(0, least(maxy,2500)-greatest(miny,700)) AS common, minx > 500 AND maxx < 3000 AND miny > 700 AND maxy < 2500 AS inside FROM ({BOXES})")
def bbox_measures(spark, sf_dir):
    b, view = F.struct("minx", "miny", "maxx", "maxy"), geo.box(500, 700, 3000, 2500)
    inside = geo.box_contains(view, b) & (F.col("minx") > 500) & (F.col("maxx") < 3000) & (F.col("miny") > 700) & (F.col("maxy") < 2500)
    return part_boxes(spark, sf_dir).select("id", geo.box_area(b).alias("area"), geo.box_common_area(b, view).alias("common"), inside.alias("inside"))


@query(f"SELECT id FROM ({BOXES}) WHERE 2000 BETWEEN minx-200 AND maxx+200 AND 1500 BETWEEN miny-200 AND maxy+200")
def point_search(spark, sf_dir):
    held = geo.box_holds(F.struct((F.col("minx") - 200).alias("minx"), (F.col("miny") - 200).alias("miny"), (F.col("maxx") + 200).alias("maxx"), (F.col("maxy") + 200).alias("maxy")), F.lit(2000), F.lit(1500))
    return part_boxes(spark, sf_dir).where(held).select("id")


@query(f"SELECT a.id AS a, b.id AS b FROM ({BOXES}) a, ({BOXES}) b WHERE a.id < b.id AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy")
def bbox_join(spark, sf_dir):
    b = part_boxes(spark, sf_dir)
    return spatial.box_join(b, b, 64.0, self_join=True)


def planar(df):
    return df.withColumns({"x": F.col("lng"), "y": F.col("lat")})


@query(f"SELECT event_id FROM ({EV}) WHERE (lng-5)*(lng-5)+(lat-5)*(lat-5) <= 900")
def radius_within(spark, sf_dir):
    near = (F.col("lng") - 5) * (F.col("lng") - 5) + (F.col("lat") - 5) * (F.col("lat") - 5) <= 900
    return event_points(spark, sf_dir).where(F.col("lng").between(-25, 35) & F.col("lat").between(-25, 35)).where(near).select("event_id")


@query(f"WITH p AS (SELECT * FROM ({CLUMP})) SELECT a.event_id AS a, b.event_id AS b, round(sqrt((a.lng-b.lng)*(a.lng-b.lng)+(a.lat-b.lat)*(a.lat-b.lat)), 4) AS distance FROM p a, p b WHERE a.event_id < b.event_id AND (a.lng-b.lng)*(a.lng-b.lng)+(a.lat-b.lat)*(a.lat-b.lat) <= 0.0025")
def radius_join(spark, sf_dir):
    p = planar(event_clumps(spark, sf_dir))
    return spatial.radius_join(p, p, "event_id", "event_id", 0.05, self_join=True).withColumn("distance", F.round("distance", 4))


@query(
    f"WITH p AS (SELECT * FROM ({CLUMP})), s AS (SELECT a.event_id, b.event_id AS other, sqrt((a.lng-b.lng)*(a.lng-b.lng)+(a.lat-b.lat)*(a.lat-b.lat)) AS d FROM p a, p b WHERE a.event_type = 'error' AND b.event_type = 'signup' AND (a.lng-b.lng)*(a.lng-b.lng)+(a.lat-b.lat)*(a.lat-b.lat) <= 0.01) "
    "SELECT event_id, round(min(d), 4) AS distance FROM s GROUP BY event_id"
)
def nearest_point(spark, sf_dir):
    p = planar(event_clumps(spark, sf_dir))
    found = spatial.nearest(p.where("event_type = 'error'"), "event_id", p.where("event_type = 'signup'").withColumnRenamed("event_id", "other"), "other", 0.1)
    return found.select("event_id", F.round("distance", 4).alias("distance"))


@query(f"SELECT event_type, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north FROM ({EV}) GROUP BY event_type")
def bounds_agg(spark, sf_dir):
    return spatial.bounds_of(event_points(spark, sf_dir), "event_type")


STEPS = f"SELECT id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM ({LINES}) WINDOW w AS (PARTITION BY id ORDER BY l_linenumber, l_partkey, l_suppkey)"


@query(f"SELECT id, round(coalesce(sum(sqrt((x-px)*(x-px)+(y-py)*(y-py))), 0), 4) AS length FROM ({STEPS}) GROUP BY id")
def line_length(spark, sf_dir):
    return order_lines(spark, sf_dir).select("id", F.round(geometry.line_length(F.col("vertices")), 4).alias("length"))


@query(
    f"WITH s AS (SELECT id, x, y, px, py, sqrt((x-px)*(x-px)+(y-py)*(y-py)) AS d, row_number() OVER w AS k FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM ({LINES}) WINDOW w AS (PARTITION BY id ORDER BY l_linenumber, l_partkey, l_suppkey)) WINDOW w AS (PARTITION BY id ORDER BY l_linenumber, l_partkey, l_suppkey)), "
    "c AS (SELECT *, sum(d) OVER (PARTITION BY id ORDER BY k) AS gone, sum(d) OVER (PARTITION BY id) / 2 AS half FROM s), "
    "m AS (SELECT id, px+(x-px)*(half-(gone-d))/d AS mx, py+(y-py)*(half-(gone-d))/d AS my FROM c WHERE d > 0 AND gone > half AND gone - d <= half) "
    "SELECT id, round(mx, 3) AS mx, round(my, 3) AS my FROM m"
)
def line_midpoint(spark, sf_dir):
    m = geometry.line_middle(F.col("vertices"))
    lines = order_lines(spark, sf_dir).where(geometry.line_length(F.col("vertices")) > 0)
    return lines.select("id", F.round(m.x, 3).alias("mx"), F.round(m.y, 3).alias("my"))


@query(f"SELECT id, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy FROM ({LINES}) GROUP BY id")
def line_mean_point(spark, sf_dir):
    c = geometry.mean_point(F.col("vertices"))
    return order_lines(spark, sf_dir).select("id", F.round(c.x, 4).alias("cx"), F.round(c.y, 4).alias("cy"))


@query(f"SELECT id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM ({LINES}) GROUP BY id")
def line_bounds(spark, sf_dir):
    return order_lines(spark, sf_dir).select("id", geometry.bounds(F.col("vertices")).alias("b")).select("id", "b.*")


RINGS = f"SELECT id, x, y, coalesce(lag(x) OVER w, last_value(x) OVER (PARTITION BY id ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS px, coalesce(lag(y) OVER w, last_value(y) OVER (PARTITION BY id ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS py FROM ({LINES}) WINDOW w AS (PARTITION BY id ORDER BY l_linenumber, l_partkey, l_suppkey)"


@query(f"SELECT id, round(sum((px-x)*(y+py)), 2) AS area FROM ({RINGS}) GROUP BY id")
def polygon_area(spark, sf_dir):
    return order_lines(spark, sf_dir).select("id", F.round(geometry.signed_area(F.col("vertices")), 2).alias("area"))


@query(f"SELECT id, round(sum((px+x)*(y*px-py*x))/sum(3*(y*px-py*x)), 3) AS cx, round(sum((py+y)*(y*px-py*x))/sum(3*(y*px-py*x)), 3) AS cy FROM ({RINGS}) GROUP BY id HAVING count(*) > 2 AND abs(sum(y*px-py*x)) > 1000")
def polygon_centroid(spark, sf_dir):
    v = F.col("vertices")
    c = geometry.centroid(v)
    kept = order_lines(spark, sf_dir).where((F.size(v) > 2) & (F.abs(geometry.total(geometry.sides(v), lambda e: e.b.y * e.a.x - e.a.y * e.b.x)) > 1000))
    return kept.select("id", F.round(c.x, 3).alias("cx"), F.round(c.y, 3).alias("cy"))


@query(f"SELECT id, 2*(x*0.5+10) AS ax, 2*(y*(-1)+4096) AS ay FROM ({LINES})")
def affine(spark, sf_dir):
    each = order_lines(spark, sf_dir).select("id", F.explode("vertices").alias("p"))
    p = geometry.affine(F.col("p"), 0.5, 10.0, -1.0, 4096.0, 2.0)
    return each.select("id", p.x.alias("ax"), p.y.alias("ay"))


@query()
def simplify_lines(spark, sf_dir):
    """Tested against known lines and for the distance of what was left out."""
    return order_lines(spark, sf_dir).select("id", geometry.simplify(F.col("vertices"), 200.0).alias("v")).select("id", F.size("v").alias("n"))


@query()
def clip_polygons(spark, sf_dir):
    """Tested against known polygons."""
    return order_lines(spark, sf_dir).select("id", geometry.clip_ring(F.col("vertices"), 500.0, 500.0, 3500.0, 3500.0).alias("v")).select("id", F.size("v").alias("n"))


@query(
    f"WITH s AS (SELECT *, x-px AS dx, y-py AS dy FROM ({STEPS}) WHERE px IS NOT NULL), "
    "t AS (SELECT *, greatest(0, CASE WHEN dx<>0 THEN least((500-px)/dx,(3500-px)/dx) ELSE 0 END, CASE WHEN dy<>0 THEN least((500-py)/dy,(3500-py)/dy) ELSE 0 END) AS t0, "
    "least(1, CASE WHEN dx<>0 THEN greatest((500-px)/dx,(3500-px)/dx) ELSE 1 END, CASE WHEN dy<>0 THEN greatest((500-py)/dy,(3500-py)/dy) ELSE 1 END) AS t1 FROM s) "
    "SELECT id, round(px+dx*t0, 3) AS ax, round(py+dy*t0, 3) AS ay, round(px+dx*t1, 3) AS bx, round(py+dy*t1, 3) AS by FROM t WHERE t0 <= t1 AND (dx <> 0 OR px BETWEEN 500 AND 3500) AND (dy <> 0 OR py BETWEEN 500 AND 3500)"
)
def clip_segments(spark, sf_dir):
    v = F.col("vertices")
    each = order_lines(spark, sf_dir).where(F.size(v) > 1).select("id", F.explode(geometry.edges(v)).alias("e"))
    cut = each.select("id", geometry.clip_segment(F.col("e.a"), F.col("e.b"), 500.0, 500.0, 3500.0, 3500.0).alias("c")).where("c IS NOT NULL")
    return cut.select("id", *[F.round(F.col(f"c.{a}.{b}"), 3).alias(f"{a}{b}") for a in "ab" for b in "xy"])
