"""Queries over projections, geodesy and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.functions.expressions import Scope, where
from tilewright.sources.views import EV, event_points, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put




def at_lat():
    return F.col("lat")


def at_lng():
    return F.col("lng")


FILTER = ["all", ["==", ["get", "event_type"], "click"], [">", ["get", "value"], 10]]
TX = "CAST(floor((lng+180)/360*pow(2,{z})) AS INT)"
TY = "CAST(floor((1-ln(tan(lat*pi()/180)+1/cos(lat*pi()/180))/pi())/2*pow(2,{z})) AS INT)"


@query(f"SELECT {TX.format(z=4)} AS x, {TY.format(z=4)} AS y, count(*) AS n, round(sum(value), 2) AS total FROM ({EV}) WHERE event_type = 'click' AND value > 10 GROUP BY 1, 2")
def flagship_tile_density(spark, sf_dir):
    """Filtered events counted by tile: the filter reaches the scan, counts are combined before the shuffle."""
    events = event_points(spark, sf_dir)
    kept = events.where(where(FILTER, Scope.of(events, ["event_type", "value"])))
    return kept.groupBy(geo.tile_x(at_lng(), 4).alias("x"), geo.tile_y(at_lat(), 4).alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"SELECT event_id, round(6378137*lng*pi()/180, 3) AS px, round(6378137*ln((1+sin(lat*pi()/180))/(1-sin(lat*pi()/180)))/2, 3) AS py FROM ({EV})")
def proj_3857(spark, sf_dir):
    x, y = geo.spherical_mercator(at_lat(), at_lng())
    return event_points(spark, sf_dir).select("event_id", F.round(x, 3).alias("px"), F.round(y, 3).alias("py"))


@query(f"SELECT event_id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM ({EV})")
def proj_3857_inverse(spark, sf_dir):
    lat, lng = geo.EPSG3857.from_pixel(*geo.EPSG3857.to_pixel(at_lat(), at_lng(), 3), 3)
    return event_points(spark, sf_dir).select("event_id", F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"))


@query(
    "WITH c AS (SELECT 6378137e0 AS a, 6356752.314245179e0 AS b), e AS (SELECT *, sqrt(1-pow(b/a,2)) AS e FROM c) "
    f"SELECT event_id, round(lng*pi()/180*a, 3) AS px, round(-a*ln(greatest(tan(pi()/4-lat*pi()/360)/pow((1-e*sin(lat*pi()/180))/(1+e*sin(lat*pi()/180)),e/2),1e-10)), 3) AS py FROM ({EV}), e"
)
def proj_3395(spark, sf_dir):
    x, y = geo.elliptical_mercator(at_lat(), at_lng())
    return event_points(spark, sf_dir).select("event_id", F.round(x, 3).alias("px"), F.round(y, 3).alias("py"))


@query(f"SELECT event_id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM ({EV})")
def proj_3395_inverse(spark, sf_dir):
    lat, lng = geo.from_elliptical_mercator(*geo.elliptical_mercator(at_lat(), at_lng()))
    return event_points(spark, sf_dir).select("event_id", F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"))


@query(f"SELECT event_id, round(1024*(lng/180+1), 4) AS px, round(1024*(-lat/180+0.5), 4) AS py FROM ({EV})")
def proj_4326_pixels(spark, sf_dir):
    x, y = geo.EPSG4326.to_pixel(at_lat(), at_lng(), 2)
    return event_points(spark, sf_dir).select("event_id", F.round(x, 4).alias("px"), F.round(y, 4).alias("py"))


@query(f"SELECT event_id, round(8*lng, 4) AS px, round(-8*lat, 4) AS py FROM ({EV})")
def proj_simple_pixels(spark, sf_dir):
    x, y = geo.SIMPLE.to_pixel(at_lat(), at_lng(), 3)
    return event_points(spark, sf_dir).select("event_id", F.round(x, 4).alias("px"), F.round(y, 4).alias("py"))


@query(f"SELECT event_id, round(cos(lat*pi()/180)*sin(lng*pi()/180), 6) AS px, round(sin(lat*pi()/180), 6) AS py, round(cos(lat*pi()/180)*cos(lng*pi()/180), 6) AS pz FROM ({EV})")
def globe_sphere(spark, sf_dir):
    x, y, z = (F.round(v, 6) for v in geo.to_sphere(at_lat(), at_lng()))
    return event_points(spark, sf_dir).select("event_id", x.alias("px"), y.alias("py"), z.alias("pz"))


@query(f"SELECT event_id, round(1 - least(1, greatest(0, (value/20-5.5)/0.5))**2 * (3 - 2*least(1, greatest(0, (value/20-5.5)/0.5))), 6) AS share FROM ({EV})")
def globe_blend(spark, sf_dir):
    return event_points(spark, sf_dir).select("event_id", F.round(geo.globe_share(F.col("value") / 20), 6).alias("share"))


@query(
    "SELECT event_id, round(2*6371000*atan2(sqrt(h), sqrt(1-h)), 3) AS metres FROM (SELECT event_id, pow(sin((40.7-lat)*pi()/360),2)+cos(lat*pi()/180)*cos(40.7*pi()/180)*pow(sin((-74-lng)*pi()/360),2) AS h "
    f"FROM ({EV}))"
)
def haversine(spark, sf_dir):
    return event_points(spark, sf_dir).select("event_id", F.round(geo.haversine(at_lat(), at_lng(), F.lit(40.7), F.lit(-74.0)), 3).alias("metres"))


@query(f"SELECT event_id, round(((lng*3+180) - 360*floor((lng*3+180)/360)) - 180, 6) AS lng FROM ({EV}) WHERE lng*3 <> 180")
def wrap_lng(spark, sf_dir):
    return event_points(spark, sf_dir).where(at_lng() * 3 != 180).select("event_id", F.round(geo.wrap(at_lng() * 3), 6).alias("lng"))


@query(f"SELECT event_id, round(lng - 180*1000/40075017e0/cos(lat*pi()/180), 6) AS west, round(lat - 180*1000/40075017e0, 6) AS south, round(lng + 180*1000/40075017e0/cos(lat*pi()/180), 6) AS east, round(lat + 180*1000/40075017e0, 6) AS north FROM ({EV})")
def latlng_to_bounds(spark, sf_dir):
    b = geo.square_around(at_lat(), at_lng(), 1000.0)
    return event_points(spark, sf_dir).select("event_id", *[F.round(b[k], 6).alias(k) for k in ("west", "south", "east", "north")])


@query(f"SELECT event_id, {TX.format(z=12)} AS x, {TY.format(z=12)} AS y FROM ({EV})")
def tile_id(spark, sf_dir):
    return event_points(spark, sf_dir).select("event_id", geo.tile_x(at_lng(), 12).alias("x"), geo.tile_y(at_lat(), 12).alias("y"))


@query(
    "WITH b AS (SELECT c_custkey AS id, ((c_custkey*7919)%360000)/1000e0-180 AS lng, ((c_custkey*104729)%170000)/1000e0-85 AS lat FROM customer), "
    "z AS (SELECT *, unnest(range(3, 6)) AS z FROM b), r AS (SELECT id, z, least(greatest(CAST(floor((lng+180)/360*pow(2,z)) AS INT),0),CAST(pow(2,z) AS INT)-1) AS x0, least(greatest(CAST(floor((lng+3+180)/360*pow(2,z)) AS INT),0),CAST(pow(2,z) AS INT)-1) AS x1, "
    + "".join(
        f"least(greatest(CAST(floor((1-ln(tan({v}*pi()/180)+1/cos({v}*pi()/180))/pi())/2*pow(2,z)) AS INT),0),CAST(pow(2,z) AS INT)-1) AS {k}{', ' if k == 'y0' else ' '}"
        for k, v in (("y0", "least(lat+3,85.0511287798e0)"), ("y1", "lat"))
    )
    + "FROM z), xs AS (SELECT *, unnest(range(x0, x1+1)) AS x FROM r) SELECT id, CAST(z AS INT) AS z, CAST(x AS INT) AS x, CAST(unnest(range(y0, y1+1)) AS INT) AS y FROM xs"
)
def tile_cover(spark, sf_dir):
    from tilewright.sources.views import with_points

    boxes = with_points(table(spark, sf_dir, "customer"), "c_custkey")
    boxes = boxes.select(F.col("c_custkey").alias("id"), at_lng().alias("west"), at_lat().alias("south"), (at_lng() + 3).alias("east"), (at_lat() + 3).alias("north"))
    return geo.tile_cover(boxes, 3, 5).select("id", "z", "x", "y")


@query(f"WITH t AS (SELECT DISTINCT {TX.format(z=4)} AS x, {TY.format(z=4)} AS y FROM ({EV})), k AS (SELECT *, unnest(range(0, 5)) AS up FROM t) SELECT DISTINCT CAST(4-up AS INT) AS z, CAST(floor(x/pow(2,up)) AS INT) AS x, CAST(floor(y/pow(2,up)) AS INT) AS y FROM k")
def tile_ancestors(spark, sf_dir):
    tiles = event_points(spark, sf_dir).select(F.lit(4).alias("z"), geo.tile_x(at_lng(), 4).alias("x"), geo.tile_y(at_lat(), 4).alias("y")).distinct()
    return geo.ancestors(tiles, 4).select(F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()


@query(f"WITH t AS (SELECT DISTINCT {TX.format(z=4)} AS x, {TY.format(z=4)} AS y FROM ({EV})) SELECT 4 AS z, x, y, 5 AS cz, CAST(x*2+i AS INT) AS cx, CAST(y*2+j AS INT) AS cy FROM t, (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j)")
def tile_children(spark, sf_dir):
    tiles = event_points(spark, sf_dir).select(F.lit(4).alias("z"), geo.tile_x(at_lng(), 4).alias("x"), geo.tile_y(at_lat(), 4).alias("y")).distinct()
    return geo.children(tiles)


@query(f"WITH t AS (SELECT DISTINCT {TX.format(z=6)} AS x, {TY.format(z=6)} AS y FROM ({EV})) SELECT x, y, round(x/64e0*360-180, 6) AS west, round(atan(sinh(pi()*(1-2*y/64e0)))*180/pi(), 6) AS north FROM t")
def tile_corner(spark, sf_dir):
    tiles = event_points(spark, sf_dir).select(geo.tile_x(at_lng(), 6).alias("x"), geo.tile_y(at_lat(), 6).alias("y")).distinct()
    return tiles.select("x", "y", F.round(geo.tile_west(F.col("x"), 6), 6).alias("west"), F.round(geo.tile_north(F.col("y"), 6), 6).alias("north"))


@query(f"SELECT event_id, 'https://' || substr('abc', abs({TX.format(z=7)}+{TY.format(z=7)})%3+1, 1) || '.t/7/' || {TX.format(z=7)} || '/' || (127-{TY.format(z=7)}) || '.png' AS url FROM ({EV})")
def tile_url(spark, sf_dir):
    url = geo.tile_url("https://{s}.t/{z}/{x}/{-y}{r}.png", F.lit(7), geo.tile_x(at_lng(), 7), geo.tile_y(at_lat(), 7))
    return event_points(spark, sf_dir).select("event_id", url.alias("url"))


@query(f"SELECT event_id, concat_ws(',', CAST({TY.format(z=7)} AS VARCHAR), CAST({TX.format(z=7)} AS VARCHAR), CAST({TY.format(z=7)}+1 AS VARCHAR), CAST({TX.format(z=7)}+1 AS VARCHAR)) AS bbox FROM ({EV})")
def wms_bbox(spark, sf_dir):
    x, y = geo.tile_x(at_lng(), 7), geo.tile_y(at_lat(), 7)
    return event_points(spark, sf_dir).select("event_id", geo.wms_box(x, y, x + 1, y + 1, "EPSG:4326", 1.3).alias("bbox"))


@query("SELECT id, least(18, greatest(0, floor(log2(least(800e0/(maxx-minx), 600e0/(maxy-miny))) + 4 + 1e-9))) AS zoom FROM (SELECT p_partkey AS id, (p_partkey*7919)%4096 AS minx, (p_partkey*104729)%4096 AS miny, (p_partkey*7919)%4096+p_size AS maxx, (p_partkey*104729)%4096+p_size*2 AS maxy FROM part)")
def bounds_zoom(spark, sf_dir):
    from tilewright.sources.views import part_boxes

    b = part_boxes(spark, sf_dir)
    return b.select("id", geo.bounds_zoom(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), 800.0, 600.0, 4, 0.0, 18.0).alias("zoom"))
