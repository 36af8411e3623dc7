"""Queries over boxes, points, text and the view's geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import camera, geo, geometry, text, view
from tilewright.sources.views import BOXES, EV, LINES, event_points, order_lines, part_boxes, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def boxes(spark, sf_dir):
    return part_boxes(spark, sf_dir).select("id", F.struct(*[F.col(c).cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy")]).alias("b"))


@query(
    "SELECT id, (maxx-minx)+(maxy-miny)*1e0 AS margin, (greatest(maxx,2000)-least(minx,1000))*(greatest(maxy,2000)-least(miny,1000))*1e0 AS enlarged, (minx+maxx)/2e0 AS cx, (miny+maxy)/2e0 AS cy, "
    f"(maxx-minx)*1e0 AS width, abs(minx-1000) <= 500 AND abs(miny-1000) <= 500 AND abs(maxx-2000) <= 500 AND abs(maxy-2000) <= 500 AS alike FROM ({BOXES})"
)
def box_measures(spark, sf_dir):
    b, other = F.col("b"), geo.box(1000, 1000, 2000, 2000)
    centre = geo.box_centre(b)
    return boxes(spark, sf_dir).select("id", geo.box_margin(b).alias("margin"), geo.box_enlarged_area(b, other).alias("enlarged"), centre.x.alias("cx"), centre.y.alias("cy"), geo.box_size(b).x.alias("width"), geo.box_equals(b, other, 500.0).alias("alike"))


@query(f"SELECT id, k, CASE WHEN k % 2 = 0 THEN minx ELSE maxx END * 1e0 AS x, CASE WHEN k < 2 THEN miny ELSE maxy END * 1e0 AS y FROM ({BOXES}), range(4) AS r(k)")
def box_corners(spark, sf_dir):
    return boxes(spark, sf_dir).where(geo.box_valid(F.col("b"))).select("id", F.posexplode(geo.box_corners(F.col("b"))).alias("k", "p")).select("id", F.col("k").cast("long").alias("k"), "p.x", "p.y")


@query(f"SELECT id, k, CASE WHEN k < 2 THEN minx ELSE maxx END * 1e0 AS x, CASE WHEN k IN (0, 3) THEN miny ELSE maxy END * 1e0 AS y FROM ({BOXES}), range(4) AS r(k)")
def box_ring(spark, sf_dir):
    return boxes(spark, sf_dir).select("id", F.posexplode(geo.box_ring(F.col("b"))).alias("k", "p")).select("id", F.col("k").cast("long").alias("k"), "p.x", "p.y")


@query(
    "WITH b AS (SELECT event_id, lng+400-1 AS west, lat-1 AS south, lng+400+1 AS east, lat+1 AS north, lng+400 AS c, lng, lat FROM ({})), s AS (SELECT *, (c+180)-360*floor((c+180)/360)-180-c AS shift FROM b) "
    "SELECT event_id, round(west+shift, 6) AS west, round(east+shift, 6) AS east, abs(lat-10) <= 5 AND abs(lng-20) <= 5 AS near, round(west+shift-1, 6) AS padded FROM s".format(EV)
)
def latlng_bounds(spark, sf_dir):
    ev = event_points(spark, sf_dir)
    wide = F.struct((F.col("lng") + 399).alias("west"), (F.col("lat") - 1).alias("south"), (F.col("lng") + 401).alias("east"), (F.col("lat") + 1).alias("north"))
    ev, b = ev.withColumn("b", geo.bounds_shifted(wide)), F.col("b")
    near = geo.latlng_equals(F.col("lat"), F.col("lng"), F.lit(10.0), F.lit(20.0), 5.0)
    padded = geo.geographic(geo.box_padded(geo.planar(b), 0.5))
    return ev.select("event_id", F.round(b.west, 6).alias("west"), F.round(b.east, 6).alias("east"), near.alias("near"), F.round(padded.west, 6).alias("padded"))


@query(
    "SELECT id, (minx+maxx)*1e0 AS ax, (miny-maxy)*1e0 AS sy, minx*3e0 AS mx, maxy/4e0 AS dy, minx*maxx*1e0 AS px, CAST(floor(miny/7e0+0.5) AS BIGINT) AS ry, CAST(floor(minx/7e0) AS BIGINT) AS fx, CAST(ceil(miny/7e0) AS BIGINT) AS cy, "
    f"CAST(trunc((minx-2000)/7e0) AS BIGINT) AS tx, round(sqrt(pow(maxx-minx,2)+pow(maxy-miny,2)), 6) AS d, maxx <= 2*minx AND maxy <= 2*miny AS covers FROM ({BOXES})"
)
def point_algebra(spark, sf_dir):
    a = F.struct(F.col("minx").cast("double").alias("x"), F.col("miny").cast("double").alias("y"))
    b = F.struct(F.col("maxx").cast("double").alias("x"), F.col("maxy").cast("double").alias("y"))
    seventh = geo.point_over(a, 7.0)
    moved = geo.point_over(F.struct((a.x - 2000).alias("x"), a.y.alias("y")), 7.0)
    return part_boxes(spark, sf_dir).select(
        "id", geo.point_add(a, b).x.alias("ax"), geo.point_subtract(a, b).y.alias("sy"), geo.point_times(a, 3).x.alias("mx"), geo.point_over(b, 4).y.alias("dy"), geo.point_scaled(a, b).x.alias("px"), geo.point_rounded(seventh).y.alias("ry"),
        geo.point_floor(seventh).x.alias("fx"), geo.point_ceil(seventh).y.alias("cy"), geo.point_cut(moved).x.alias("tx"), F.round(geo.point_distance(a, b), 6).alias("d"), geo.point_covers(geo.point_times(a, 2), b).alias("covers"),
    )


@query(r"SELECT p_partkey, len(string_split_regex(trim(p_name || '  x '), '\s+')) AS words, string_split_regex(trim(p_name || '  x '), '\s+')[1] AS first FROM part")
def split_words(spark, sf_dir):
    words = text.split_words(F.concat("p_name", F.lit("  x ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(words).cast("long").alias("words"), F.get(words, F.lit(0)).alias("first"))


@query("SELECT page_id, md5(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g')) AS plain FROM pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("plain"))


@query("SELECT event_id, true AS same, false AS other FROM events")
def json_equality(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    turned = F.concat(F.lit('{ "b": [1, {"c": null}], "a": '), k, F.lit("}"))
    straight = F.concat(F.lit('{"a":'), k, F.lit(',"b":[1,{"c":null}]}'))
    return table(spark, sf_dir, "events").select("event_id", text.json_equal(turned, straight).alias("same"), text.json_equal(F.col("props"), straight).alias("other"))


@query(f"SELECT id, 4 * count(*) AS n, [count(*)] AS holes FROM ({LINES}) GROUP BY id")
def flatten_rings(spark, sf_dir):
    flat = text.flattened_rings(F.array("vertices", "vertices"))
    return order_lines(spark, sf_dir).select("id", F.size(flat.vertices).cast("long").alias("n"), flat.holes.cast("array<long>").alias("holes"))


@query("SELECT n_nationkey, k, lat, lng FROM nation, (VALUES (0, 38.5e0, -120.2e0), (1, 40.7e0, -120.95e0), (2, 43.252e0, -126.453e0)) AS v(k, lat, lng)")
def polyline_decode(spark, sf_dir):
    points = text.decoded_polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(points).alias("k", "p")).select("n_nationkey", "k", F.col("p.y").alias("lat"), F.col("p.x").alias("lng"))


@query(
    "WITH r AS (SELECT id, 100+(minx-100)*cos(radians(30))-(miny-50)*sin(radians(30)) AS x, 50+(minx-100)*sin(radians(30))+(miny-50)*cos(radians(30)) AS y FROM ({})), h AS (SELECT 300/tan(radians(36.87)/2) AS h) "
    "SELECT id, round(x, 4) AS x, round(y, 4) AS y, round(h*x/(h-y*sin(radians(40))), 4) AS sx, round(h*y*cos(radians(40))/(h-y*sin(radians(40))), 4) AS sy, round(x, 4) AS back FROM r, h".format(BOXES)
)
def camera_tilt(spark, sf_dir):
    p = camera.rotated(F.struct(F.col("minx").cast("double").alias("x"), F.col("miny").cast("double").alias("y")), F.lit(30.0), geometry.point(100, 50))
    rows = part_boxes(spark, sf_dir).select("id", p.alias("p")).withColumn("s", camera.pitched(F.col("p"), F.lit(40.0), 600.0))
    back = camera.unpitched(F.col("s"), F.lit(40.0), 600.0)
    return rows.select("id", *[F.round(c, 4).alias(n) for c, n in ((F.col("p.x"), "x"), (F.col("p.y"), "y"), (F.col("s.x"), "sx"), (F.col("s.y"), "sy"), (back.x, "back"))])


@query("WITH a AS (SELECT event_id, event_id % 360 AS a, event_id * 7 % 360 AS b FROM events), d AS (SELECT *, (b - a + 540) % 360 - 180 AS d FROM a) SELECT event_id, round(((a + d * 0.25e0) + 360) % 360, 6) AS bearing FROM d")
def bearing_between(spark, sf_dir):
    made = camera.bearing_between(F.col("event_id") % 360, F.col("event_id") * 7 % 360, F.lit(0.25))
    return table(spark, sf_dir, "events").select("event_id", F.round(made, 6).alias("bearing"))


EASED = {
    "linear": "t", "inQuad": "t*t", "outQuad": "1-(1-t)*(1-t)", "inOutQuad": "CASE WHEN t<0.5 THEN 2*t*t ELSE 1-pow(-2*t+2,2)/2 END", "inCubic": "t*t*t", "outCubic": "1-pow(1-t,3)",
    "inOutCubic": "CASE WHEN t<0.5 THEN 4*t*t*t ELSE 1-pow(-2*t+2,3)/2 END", "inQuart": "t*t*t*t", "outQuart": "1-pow(1-t,4)", "inOutQuart": "CASE WHEN t<0.5 THEN 8*t*t*t*t ELSE 1-pow(-2*t+2,4)/2 END",
    "outBack": "1+2.70158e0*pow(t-1,3)+1.70158e0*pow(t-1,2)",
}


@query("SELECT event_id, " + ", ".join(f"round({sql}, 6) AS {name}" for name, sql in EASED.items()) + " FROM (SELECT event_id, (event_id % 101) / 100e0 AS t FROM events)")
def easing(spark, sf_dir):
    t = (F.col("event_id") % 101) / F.lit(100.0)
    return table(spark, sf_dir, "events").select("event_id", *[F.round(camera.eased(name, t), 6).alias(name) for name in EASED])


@query("SELECT event_id, 800e0 AS w0, round(800 * pow(2, event_id % 5 - 2), 4) AS w1, 0e0 AS u0, (event_id % 997 + 1) * 1e0 AS u1 FROM events")
def flight_ends(spark, sf_dir):
    w1, far = F.pow(F.lit(2.0), F.col("event_id") % 5 - 2) * 800, (F.col("event_id") % 997 + 1).cast("double")
    start, end = camera.flight(F.lit(800.0), w1, far, F.lit(0.0)), camera.flight(F.lit(800.0), w1, far, F.lit(1.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(start.w, 4).alias("w0"), F.round(end.w, 4).alias("w1"), F.round(start.u, 4).alias("u0"), F.round(end.u, 4).alias("u1"))


FLIGHT = camera.FLIGHT_CURVE
RISE = f"(w1*w1 - w0*w0 {{sign}} {FLIGHT**4!r}*u1*u1) / ({{own}} * {2 * FLIGHT**2!r} * u1)"


@query(
    "WITH e AS (SELECT event_id, 800e0 AS w0, 800 * pow(2e0, event_id % 5 - 2) AS w1, (event_id % 997 + 1) * 1e0 AS u1, (event_id % 99 + 1) / 100e0 AS share FROM events), "
    f"b AS (SELECT *, {RISE.format(sign='+', own='w0')} AS b0, {RISE.format(sign='-', own='w1')} AS b1 FROM e), r AS (SELECT *, ln(sqrt(b0*b0+1)-b0) AS r0, ln(sqrt(b1*b1+1)-b1) AS r1 FROM b), h AS (SELECT *, r0 + (r1-r0)*share AS h FROM r) "
    f"SELECT event_id, round((r1-r0)/{FLIGHT!r}, 5) AS length, round(w0*(exp(r0)+exp(-r0))/(exp(h)+exp(-h)), 3) AS w, round(w0*((exp(r0)+exp(-r0))/2*(exp(h)-exp(-h))/(exp(h)+exp(-h)) - (exp(r0)-exp(-r0))/2)/{FLIGHT**2!r}, 3) AS u FROM h"
)
def flight_midpoints(spark, sf_dir):
    """Views on the way of a flight, each event at a share of its own."""
    w1, far = F.pow(F.lit(2.0), F.col("event_id") % 5 - 2) * 800, (F.col("event_id") % 997 + 1).cast("double")
    made = camera.flight(F.lit(800.0), w1, far, (F.col("event_id") % 99 + 1) / F.lit(100.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(made.S, 5).alias("length"), F.round(made.w, 3).alias("w"), F.round(made.u, 3).alias("u"))


@query(
    "WITH m AS (SELECT event_id, (event_id % 5000 + 1) * 3e0 AS m FROM events), p AS (SELECT *, pow(10, length(CAST(floor(m) AS BIGINT)::VARCHAR)-1) AS p FROM m), "
    "n AS (SELECT *, p * CASE WHEN m/p >= 10 THEN 10 WHEN m/p >= 5 THEN 5 WHEN m/p >= 3 THEN 3 WHEN m/p >= 2 THEN 2 ELSE 1 END AS n FROM p) "
    "SELECT event_id, CASE WHEN n < 1000 THEN CAST(n AS BIGINT) || ' m' ELSE CAST(n/1000 AS BIGINT) || ' km' END AS label, CAST(floor(100*n/m+0.5) AS INT) AS pixels FROM n"
)
def scale_bar(spark, sf_dir):
    made = camera.metric_scale((F.col("event_id") % 5000 + 1) * F.lit(3.0))
    return table(spark, sf_dir, "events").select("event_id", made.label.alias("label"), made.pixels.alias("pixels"))


@query(
    "WITH e AS (SELECT event_id, lat, lng, 1000/6371000e0*180/pi() AS r FROM ({})), y AS (SELECT *, sin(radians(greatest(-85.0511287798e0, least(85.0511287798e0, lat+r)))) AS t, sin(radians(greatest(-85.0511287798e0, least(85.0511287798e0, lat-r)))) AS b FROM e), "
    "p AS (SELECT *, 4096*(0.5-ln((1+t)/(1-t))/(4*pi())) AS top, 4096*(0.5-ln((1+b)/(1-b))/(4*pi())) AS bottom FROM y), q AS (SELECT *, (top+bottom)/2 AS py FROM p), "
    "z AS (SELECT *, degrees(2*atan(exp((0.5-py/4096)*2*pi()))-pi()/2) AS lat2 FROM q), w AS (SELECT *, degrees(acos((cos(radians(r))-sin(radians(lat))*sin(radians(lat2)))/(cos(radians(lat))*cos(radians(lat2))))) AS wide FROM z) "
    "SELECT event_id, round(py, 4) AS py, round(4096*wide/360, 4) AS rx, round(py-top, 4) AS ry FROM w".format(EV)
)
def circle_pixels(spark, sf_dir):
    made = camera.circle_pixels(F.col("lat"), F.col("lng"), F.lit(1000.0), 4)
    return event_points(spark, sf_dir).select("event_id", F.round(made.y, 4).alias("py"), F.round(made.rx, 4).alias("rx"), F.round(made.ry, 4).alias("ry"))


REBOUND = "CASE WHEN {l} + {r} > 0 THEN floor({l} - ({r}) + 0.5) / 2 ELSE greatest(0, ceil({l})) - greatest(0, floor({r})) END"


@query(
    "WITH o AS (SELECT id, minx, miny, 500-(minx-200) AS lx, -(3500-(minx+200)) AS rx, 500-(miny-150) AS ly, -(3500-(miny+150)) AS ry FROM ({})), d AS (SELECT *, {} AS dx, {} AS dy FROM o) "
    "SELECT id, CASE WHEN abs(dx)<=1 AND abs(dy)<=1 THEN minx ELSE minx+dx END * 1e0 AS x, CASE WHEN abs(dx)<=1 AND abs(dy)<=1 THEN miny ELSE miny+dy END * 1e0 AS y FROM d".format(BOXES, REBOUND.format(l="lx", r="rx"), REBOUND.format(l="ly", r="ry"))
)
def limited_centre(spark, sf_dir):
    made = camera.limited_centre(F.struct(F.col("minx").cast("double").alias("x"), F.col("miny").cast("double").alias("y")), 400.0, 300.0, geo.box(500, 500, 3500, 3500))
    return part_boxes(spark, sf_dir).select("id", made.x.alias("x"), made.y.alias("y"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM events GROUP BY event_type")
def quantile_statistics(spark, sf_dir):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    made = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), p.alias("p"), F.count(F.lit(1)).alias("n"))
    return made.select("event_type", F.round("mean", 6).alias("mean"), *[F.round(F.col("p")[k], 6).alias(n) for k, n in enumerate(("p50", "p95", "p99"))], "n")


#: World pixels of zoom 4 in SQL: of a place, and of the view's centre at 10 north, 20 east.
PIXEL = "({lng}/360e0+0.5)*4096 AS {x}, (0.5-ln((1+sin(radians({lat})))/(1-sin(radians({lat}))))/(4*pi()))*4096 AS {y}"
CONTAINER = (
    f"WITH p AS (SELECT event_id, {PIXEL.format(lng='lng', lat='lat', x='px', y='py')}, {PIXEL.format(lng='20e0', lat='10e0', x='cx', y='cy')}, event_id % 7 - 3 AS dx, event_id % 5 - 2 AS dy FROM ({EV})), "
    "o AS (SELECT *, floor(cx-400+dx+0.5) AS ox, floor(cy-300+dy+0.5) AS oy FROM p), l AS (SELECT *, floor(px+0.5)-ox AS lx, floor(py+0.5)-oy AS ly FROM o) "
)


@query(CONTAINER + "SELECT event_id, lx AS layer_x, ly AS layer_y, lx+dx AS x, ly+dy AS y, ox-dx AS west_edge, oy-dy+600 AS south_edge FROM l")
def container_points(spark, sf_dir):
    """Events on the layers' plane and in the container of a view whose pane each has dragged."""
    e = F.col("event_id")
    pane = F.struct((e % 7 - 3).cast("double").alias("x"), (e % 5 - 2).cast("double").alias("y"))
    v = view.View(F.lit(10.0), F.lit(20.0), F.lit(4), 800, 600, pane)
    at, seen, box = v.to_layer(F.col("lat"), F.col("lng")), v.to_container(F.col("lat"), F.col("lng")), v.pixel_bounds()
    return event_points(spark, sf_dir).select("event_id", *[c.cast("double").alias(n) for c, n in ((at.x, "layer_x"), (at.y, "layer_y"), (seen.x, "x"), (seen.y, "y"), (box.minx, "west_edge"), (box.maxy, "south_edge"))])


@query(
    f"WITH p AS (SELECT event_id, event_id % 800 * 1e0 AS x, event_id % 600 * 1e0 AS y, event_id % 360 * 1e0 AS turn, {PIXEL.format(lng='20e0', lat='10e0', x='cx', y='cy')} FROM events), "
    "o AS (SELECT *, floor(cx-400+0.5) AS ox, floor(cy-300+0.5) AS oy, x-400 AS dx, y-300 AS dy FROM p), "
    "w AS (SELECT event_id, 400+dx*cos(radians(turn))+dy*sin(radians(turn))+ox AS wx, 300-dx*sin(radians(turn))+dy*cos(radians(turn))+oy AS wy FROM o) "
    "SELECT event_id, round((wx/4096-0.5)*360, 5) AS lng, round(degrees(2*atan(exp((0.5-wy/4096)*2*pi()))-pi()/2), 5) AS lat FROM w"
)
def container_places(spark, sf_dir):
    """What is seen at a point of the container of a view that each event has turned."""
    e = F.col("event_id")
    v = view.View(F.lit(10.0), F.lit(20.0), F.lit(4), 800, 600, bearing=(e % 360).cast("double"))
    lat, lng = v.from_container(F.struct((e % 800).cast("double").alias("x"), (e % 600).cast("double").alias("y")))
    return table(spark, sf_dir, "events").select("event_id", F.round(lng, 5).alias("lng"), F.round(lat, 5).alias("lat"))


@query("SELECT event_id, 0e0 AS minx, 0e0 AS miny, 256 * pow(2e0, event_id % 20) AS maxx, 256 * pow(2e0, event_id % 20) AS maxy, 0.5 * 256 * pow(2e0, event_id % 20) AS middle FROM events")
def world_pixels(spark, sf_dir):
    """The whole world in pixels of each event's zoom, and the middle of that of the other axes' projection."""
    zoom = F.col("event_id") % 20
    whole, flat = view.projected_bounds(geo.EPSG3857, zoom), view.projected_bounds(geo.EPSG4326, zoom)
    side = F.pow(F.lit(2.0), zoom) * 256
    near = lambda x: F.when(F.abs(x) < 1e-6 * side, 0.0).otherwise(F.round(x, 3))
    return table(spark, sf_dir, "events").select("event_id", *[near(whole[c]).alias(c) for c in ("minx", "miny", "maxx", "maxy")], F.round((flat.miny + flat.maxy) / 2, 3).alias("middle"))
