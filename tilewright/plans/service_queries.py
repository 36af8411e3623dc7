"""Queries over the answers of services and over style documents, both made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import style_edits as edits
from tilewright.operators import style_expressions
from tilewright.operators import styles
from tilewright.sources import services
from tilewright.sources.views import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def K():
    return F.col("c_custkey")


def answers(spark, sf_dir, value):
    """One answer (JSON) for each customer."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(value).alias("answer"))


def pick(*values):
    return F.element_at(F.array(*map(F.lit, values)), (K() % len(values) + 1).cast("int"))


def pick_sql(*values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][c_custkey % {len(values)} + 1]"


def X():
    return (K() % 180).cast("double")


def Y():
    return (K() % 90).cast("double")


PLACE = "c_custkey, 0 AS rank, {text} AS text, (c_custkey % 90) * 1e0 AS lat, (c_custkey % 180) * 1e0 AS lng, {kind} AS place_type"
WORLD = "-1e0 AS west, 2e0 AS south, 3e0 AS east, 4e0 AS north"
RESULT = ("c_custkey", "rank", "text", "lat", "lng", "place_type")


def boxed(df, *more):
    return df.select(*RESULT, *[F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate(("west", "south", "east", "north"))], *more)


OSM = [("boundary", "administrative"), ("place", "country"), ("place", "state"), ("place", "village"), ("place", "postcode"), ("x", "administrative"), ("highway", "primary"), ("place", "house"), ("shop", "bakery"), ("x", "y")]


@query(f"SELECT {PLACE.format(text='c_name', kind=pick_sql('region', 'country', 'region', 'place', 'postcode', 'district', 'address', 'address', 'poi', None))}, {WORLD}, greatest(0e0, least(1e0, c_custkey / 100e0 - 0.1)) AS relevance FROM customer")
def nominatim_places(spark, sf_dir):
    text = lambda v: F.lit(v).cast("string")
    one = F.struct(
        Y().cast("string").alias("lat"), X().cast("string").alias("lon"), F.col("c_name").alias("display_name"), pick(*[a for a, _ in OSM]).alias("class"), pick(*[b for _, b in OSM]).alias("type"), (K() / 100 - 0.1).alias("importance"),
        F.array(text(2), text(4), text(-1), text(3)).alias("boundingbox"),
    )
    return boxed(services.read("places", answers(spark, sf_dir, F.array(one)), "answer"), "relevance")


@query(f"SELECT {PLACE.format(text='c_name', kind=pick_sql('place', 'address', 'poi'))} FROM customer")
def nominatim_reverse(spark, sf_dir):
    one = F.struct(Y().cast("string").alias("lat"), X().cast("string").alias("lon"), F.col("c_name").alias("display_name"), pick("place", "highway", "amenity").alias("class"), pick("town", "road", "bar").alias("type"))
    return services.nominatim_places(answers(spark, sf_dir, one), "answer").select(*RESULT)


@query(f"SELECT {PLACE.format(text=chr(39) + 'Main Street 5, 1000 Town, Land' + chr(39), kind=pick_sql('place', 'country', 'district', 'address'))}, {WORLD} FROM customer")
def photon_places(spark, sf_dir):
    own = F.struct(
        F.lit("Main Street 5").alias("name"), F.lit("Main Street").alias("street"), F.when(K() % 4 == 3, "5").otherwise("").alias("housenumber"), F.lit("1000").alias("postcode"), F.lit("Town").alias("city"), F.lit("Land").alias("country"),
        pick("place", "x", "x", "x").alias("osm_key"), pick("city", "country", "x", "x").alias("osm_value"), pick("x", "x", "county", "x").alias("type"), F.array(*[F.lit(float(v)) for v in (-1, 4, 3, 2)]).alias("extent"),
    )
    own = own.withField("street", F.when(K() % 4 == 3, "Main Street"))
    feature = F.struct(F.struct(F.array(X(), Y()).alias("coordinates")).alias("geometry"), own.alias("properties"))
    return boxed(services.photon_places(answers(spark, sf_dir, F.struct(F.array(feature).alias("features"))), "answer"))


@query(f"SELECT {PLACE.format(text='c_name', kind=pick_sql('poi', None, 'region'))}, {WORLD}, 0.5e0 AS relevance FROM customer")
def mapbox_places(spark, sf_dir):
    own = F.struct(F.when(K() % 2 == 0, F.col("c_name")).alias("full_address"), F.col("c_name").alias("name"), F.array(*[F.lit(float(v)) for v in (-1, 2, 3, 4)]).alias("bbox"), pick("poi", "street", "region").alias("feature_type"))
    feature = F.struct(F.struct(F.array(X(), Y()).alias("coordinates")).alias("geometry"), own.alias("properties"), F.lit(0.5).alias("relevance"))
    return boxed(services.mapbox_places(answers(spark, sf_dir, F.struct(F.array(feature).alias("features"))), "answer"), "relevance")


@query(f"SELECT {PLACE.format(text='c_name', kind=pick_sql('place', None))}, {WORLD}, 0.5e0 AS relevance FROM customer")
def maptiler_places(spark, sf_dir):
    feature = F.struct(F.col("c_name").alias("place_name"), F.array(X(), Y()).alias("center"), F.array(*[F.lit(float(v)) for v in (-1, 2, 3, 4)]).alias("bbox"), F.array(pick("place", "street")).alias("place_type"), F.lit(0.5).alias("relevance"))
    return boxed(services.maptiler_places(answers(spark, sf_dir, F.struct(F.array(feature, feature, feature).alias("features"))), "answer", limit=1), "relevance")


@query(f"SELECT {PLACE.format(text='c_name', kind=pick_sql('country', 'place', 'address', None))}, {WORLD} FROM customer")
def google_places(spark, sf_dir):
    spot = lambda lat, lng: F.struct(F.lit(lat).cast("double").alias("lat"), F.lit(lng).cast("double").alias("lng"))
    box = F.struct(spot(4, 3).alias("northeast"), spot(2, -1).alias("southwest"))
    geometry = F.struct(spot(Y(), X()).alias("location"), F.when(K() % 2 == 0, box).alias("bounds"), box.alias("viewport"))
    one = F.struct(F.col("c_name").alias("formatted_address"), geometry.alias("geometry"), F.array(F.lit("political"), pick("country", "locality", "route", "x")).alias("types"))
    return boxed(services.google_places(answers(spark, sf_dir, F.struct(F.lit("OK").alias("status"), F.array(one).alias("results"))), "answer"))


STEPS = "SELECT l_orderkey AS id, count(*) AS steps, sum(l_quantity) AS distance"


def legs(spark, sf_dir, step):
    """One leg for each order, with a step for each of its lines."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("q"), F.col("l_linenumber").alias("k"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", step.alias("s")))).alias("v"), F.sum("q").alias("total")).withColumn("steps", F.transform("v", lambda x: x.s)).drop("v")


@query(f"{STEPS}, 'turn left onto High Street' AS first, 'turn-left' AS maneuver, 2 * count(*) AS points FROM lineitem GROUP BY l_orderkey")
def osrm_routes(spark, sf_dir):
    line = F.struct(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.col("q"))).alias("coordinates"))
    move = F.struct(F.lit("turn").alias("type"), F.lit("left").alias("modifier"))
    rows = legs(spark, sf_dir, F.struct(F.col("q").alias("distance"), F.lit(1.0).alias("duration"), F.lit("High Street").alias("name"), line.alias("geometry"), move.alias("maneuver")))
    route = F.struct(F.col("total").alias("distance"), F.lit(9.0).alias("duration"), F.array(F.struct("steps")).alias("legs"))
    found = services.read("routes", rows.select("id", F.to_json(F.struct(F.lit("Ok").alias("code"), F.array(route).alias("routes"))).alias("answer")), "answer")
    first = F.get("steps", F.lit(0))
    return found.select("id", F.size("steps").cast("long").alias("steps"), "distance", first.instruction.alias("first"), first.maneuver.alias("maneuver"), F.size(F.flatten(F.transform("steps", lambda s: s.geometry))).cast("long").alias("points"))


@query(f"{STEPS}, 'Go on' AS first, 3 AS points, 38.5e0/10 AS lat FROM lineitem GROUP BY l_orderkey")
def valhalla_routes(spark, sf_dir):
    step = F.struct((F.col("q") / 1000).alias("length"), F.lit(1.0).alias("time"), F.lit("Go on").alias("instruction"), F.lit(0).alias("begin_shape_index"), F.lit(2).alias("end_shape_index"))
    leg = F.struct(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@").alias("shape"), F.col("steps").alias("maneuvers"))
    trip = F.struct(F.struct((F.col("total") / 1000).alias("length"), F.lit(9.0).alias("time")).alias("summary"), F.array(leg).alias("legs"))
    found = services.valhalla_routes(legs(spark, sf_dir, step).select("id", F.to_json(F.struct(trip.alias("trip"))).alias("answer")), "answer")
    first = F.get("steps", F.lit(0))
    return found.select("id", F.size("steps").cast("long").alias("steps"), F.round("distance", 6).alias("distance"), first.instruction.alias("first"), F.size(first.geometry).alias("points"), F.get("geometry", F.lit(0)).y.alias("lat"))


@query(f"{STEPS}, 'Turn right' AS first, 3 AS points, 38.5e0 AS lat FROM lineitem GROUP BY l_orderkey")
def google_routes(spark, sf_dir):
    shape = F.struct(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@").alias("points"))
    value = lambda v: F.struct(v.cast("double").alias("value"))
    step = F.struct(value(F.col("q")).alias("distance"), value(F.lit(1)).alias("duration"), F.lit("Turn <b>right</b>").alias("html_instructions"), shape.alias("polyline"))
    leg = F.struct(value(F.col("total")).alias("distance"), value(F.lit(9)).alias("duration"), "steps")
    route = F.struct(shape.alias("overview_polyline"), F.array(leg).alias("legs"))
    found = services.google_routes(legs(spark, sf_dir, step).select("id", F.to_json(F.struct(F.lit("OK").alias("status"), F.array(route).alias("routes"))).alias("answer")), "answer")
    return found.select("id", F.size("steps").cast("long").alias("steps"), "distance", F.get("steps", F.lit(0)).instruction.alias("first"), F.size("geometry").alias("points"), F.get("geometry", F.lit(0)).y.alias("lat"))


@query(
    "SELECT c_custkey, 10e0 AS contour, 4 AS points, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS holes FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT c_custkey, 10, 4, 0 FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT c_custkey, 10, 4, 0 FROM customer WHERE c_custkey % 3 = 2"
)
def isochrone_polygons(spark, sf_dir):
    ring = "[[0,0],[1,0],[1,1],[0,0]]"
    shape = F.when(K() % 3 == 0, f'{{"type":"Polygon","coordinates":[{ring},{ring}]}}').when(K() % 3 == 1, f'{{"type":"MultiPolygon","coordinates":[[{ring}],[{ring}],[]]}}').otherwise(f'{{"type":"LineString","coordinates":{ring}}}')
    text = F.concat(F.lit('{"features":[{"properties":{"contour":10},"geometry":'), shape, F.lit("}]}"))
    found = services.read("isochrones", table(spark, sf_dir, "customer").select("c_custkey", text.alias("answer")), "answer")
    return found.select("c_custkey", "contour", F.size("geometry").alias("points"), F.size("holes").alias("holes"))


@query("SELECT c_custkey, service, CASE WHEN service = 'osrm' THEN CAST('inf' AS DOUBLE) ELSE c_custkey * 1e0 END AS d01, c_custkey * 2e0 AS d10 FROM customer, (VALUES ('osrm'), ('valhalla'), ('mapbox')) AS v(service)")
def travel_matrices(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("double")
    plain = lambda a: F.array(F.array(F.lit(0.0), a), F.array(k * 2, F.lit(0.0)))
    ok = lambda a: F.to_json(F.struct(F.lit("Ok").alias("code"), plain(a).alias("durations")))
    cell = lambda v: F.struct(v.alias("time"), (v / 1000).alias("distance"))
    cells = F.to_json(F.struct(F.array(F.array(cell(F.lit(0.0)), cell(k)), F.array(cell(k * 2), cell(F.lit(0.0)))).alias("sources_to_targets")))
    out = None
    for service, answer in (("osrm", ok(F.lit(None).cast("double"))), ("valhalla", cells), ("mapbox", ok(k))):
        found = services.read("matrix", c.select("c_custkey", answer.alias("answer")), "answer", service)
        d = lambda a, b: F.get(F.get("durations", F.lit(a)), F.lit(b))
        own = lambda v: F.when(K().isNotNull(), v)  # noqa: E731  # a missing key tells nothing; readers take it for no way or for zero
        one = found.select("c_custkey", F.lit(service).alias("service"), (d(0, 1) if service == "osrm" else own(d(0, 1))).alias("d01"), own(d(1, 0)).alias("d10"))
        out = one if out is None else out.union(one)
    return out


def P():
    return F.col("p_partkey")


#: Styles by p_partkey % 8: sound, then seven that are wrong in one way each.
WRONG = [
    (None, None, None),
    ("version", "version is not 8", ('"version":8', '"version":7')),
    ("sources.vt", "a tiled source needs url or tiles", ('"url":"u"', '"x":1')),
    ("layers.1.source", "no source nowhere", ('"source":"vt","paint"', '"source":"nowhere","paint"')),
    ("layers.1.paint.line-width", "not a number as wanted", ('"line-width":2', '"line-width":-2')),
    ("layers.1.paint.line-colour", "no such property of line", ('"line-color":"red"', '"line-colour":"red"')),
    ("layers.1.id", "a second layer bg", ('"id":"roads"', '"id":"bg"')),
    ("layers.1.layout.line-cap", "not a choice as wanted", ('"line-cap":"round"', '"line-cap":"oval"')),
]
STYLE = (
    '{"version":8,"sources":{"vt":{"type":"vector","url":"u"}},"layers":[{"id":"bg","type":"background"},{"id":"roads","type":"line","source":"vt","paint":'
    '{"line-width":2,"line-color":"red","line-opacity":["interpolate",["linear"],["zoom"],0,0,10,1]},"layout":{"line-cap":"round"}}]}'
)


def style_texts():
    texts = [STYLE if change is None else STYLE.replace(*change) for _, _, change in WRONG]
    return F.element_at(F.array(*map(F.lit, texts)), (P() % len(texts) + 1).cast("int"))


@query("SELECT p_partkey, path, message FROM part JOIN (VALUES " + ", ".join(f"({k}, '{path}', '{message}')" for k, (path, message, _) in enumerate(WRONG) if path) + f") AS v(k, path, message) ON p_partkey % {len(WRONG)} = k")
def style_issues(spark, sf_dir):
    return styles.style_issues(table(spark, sf_dir, "part").select("p_partkey", style_texts().alias("style")), "p_partkey", "style")


#: What each change of a style takes, by p_partkey % 8.
CHANGES = [
    ((), []),
    (('"version":8', '"version":9'), [("setStyle", None, None, None)]),
    (('"url":"u"', '"url":"w"'), [("removeSource", "vt", None, None), ("addSource", "vt", None, None)]),
    (('"line-width":2,', ""), [("setPaintProperty", "roads", "line-width", None)]),
    (('"line-cap":"round"', '"line-cap":"butt"'), [("setLayoutProperty", "roads", "line-cap", None)]),
    (('{"id":"roads"', '{"id":"rail","type":"line","source":"vt"},{"id":"roads"'), [("addLayer", "rail", None, "roads")]),
    (('{"id":"bg","type":"background"},', ""), [("removeLayer", "bg", None, None)]),
    (('"id":"roads","type":"line"', '"id":"roads","minzoom":3,"filter":["has","a"],"type":"line"'), [("setLayerZoomRange", "roads", None, None), ("setFilter", "roads", None, None)]),
]


def _text(v):
    return "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"


@query(
    "SELECT p_partkey, CAST(step AS INT) AS step, command, target, name, anchor FROM part JOIN (VALUES "
    + ", ".join(f"({k}, {step}, {', '.join(map(_text, c))})" for k, (_, commands) in enumerate(CHANGES) for step, c in enumerate(commands, 1))
    + f") AS v(k, step, command, target, name, anchor) ON p_partkey % {len(CHANGES)} = k"
)
def style_changes(spark, sf_dir):
    texts = [STYLE.replace(*change) if change else STYLE for change, _ in CHANGES]
    after = F.element_at(F.array(*map(F.lit, texts)), (P() % len(texts) + 1).cast("int"))
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.lit(STYLE).alias("before"), after.alias("after"))
    return styles.style_changes(pairs, "p_partkey", "before", "after").select("p_partkey", "step", "command", "target", "name", "anchor")


#: Layers in order after the change of each style, by p_partkey % 8.
ORDERS = ["bg,roads"] * 5 + ["bg,rail,roads", "roads", "bg,roads"]


@query(
    "SELECT p_partkey, true AS same, layers, CASE WHEN p_partkey % 8 <> 3 THEN CAST(p_size AS INT) END AS width, CAST(CASE WHEN p_partkey % 8 = 1 THEN 9 ELSE 8 END AS INT) AS version, CASE WHEN p_partkey % 8 = 7 THEN 3 END AS least FROM part "
    f"JOIN (VALUES {', '.join(f'({k}, {chr(39)}{v}{chr(39)})' for k, v in enumerate(ORDERS))}) AS v(k, layers) ON k = p_partkey % 8"
)
def style_applied(spark, sf_dir):
    """The changes between two styles of each part, applied to the first: the second."""
    texts = [STYLE.replace(*change) if change else STYLE for change, _ in CHANGES]
    sized = lambda text: F.replace(text, F.lit('"line-width":2'), F.concat(F.lit('"line-width":'), "p_size"))
    after = F.element_at(F.array(*map(F.lit, texts)), (P() % len(texts) + 1).cast("int"))
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.lit(STYLE).alias("before"), sized(after).alias("after"))
    made = edits.style_applied(pairs.select("p_partkey", "before"), styles.style_changes(pairs, "p_partkey", "before", "after"), "p_partkey", "before")
    both = made.join(pairs.select("p_partkey", "after"), "p_partkey")
    same = F.to_json(F.parse_json("before")) == F.to_json(F.parse_json("after"))
    layers = F.transform(F.try_variant_get(F.parse_json("before"), "$.layers", "array<variant>"), lambda v: F.try_variant_get(v, "$.id", "string"))
    at = lambda path, kind: F.try_variant_get(F.parse_json("before"), path, kind)
    last = F.element_at(at("$.layers", "array<variant>"), -1)
    width, least = F.try_variant_get(last, "$.paint['line-width']", "int"), F.try_variant_get(last, "$.minzoom", "int")
    return both.select("p_partkey", same.alias("same"), F.array_join(layers, ",").alias("layers"), width.alias("width"), at("$.version", "int").alias("version"), least.alias("least"))


@query("SELECT s_suppkey, k AS position, ['bg', 'rail', 'roads'][k + 1] AS id, k = 2 AS filtered, CASE WHEN k = 2 THEN 4 END AS width FROM supplier, range(3) AS r(k)")
def style_edits(spark, sf_dir):
    docs = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(STYLE).alias("style"))
    made = styles.with_layer(styles.layers_of(docs, "s_suppkey", "style"), "s_suppkey", "rail", '{"id":"rail","type":"line"}', before="roads")
    made = styles.with_filter(styles.with_property(made, "roads", "paint", "line-width", "4"), "roads", '["has","a"]')
    shown = styles.drawn_at(styles.with_zooms(made, "rail", 2, 9), 5)
    layer = lambda path: F.get_json_object("layer", path)
    return shown.select("s_suppkey", F.col("position").cast("long").alias("position"), "id", layer("$.filter").isNotNull().alias("filtered"), layer("$.paint.line-width").cast("int").alias("width"))


@query(
    "WITH s AS (SELECT l_orderkey AS id, l_linenumber % 2 AS half, count(*) AS steps, sum(l_quantity) AS distance FROM lineitem GROUP BY ALL) "
    "SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY half) - 1 AS INT) AS leg, distance, half + 7e0 AS duration, steps, 2 * steps AS points FROM s"
)
def route_legs(spark, sf_dir):
    """Routes with a leg for the lines of even number and one for those of odd number, taken apart again."""
    line = F.struct(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.col("l_quantity"))).alias("coordinates"))
    step = F.struct(F.col("l_quantity").alias("distance"), F.lit(1.0).alias("duration"), F.lit("High Street").alias("name"), line.alias("geometry"))
    halves = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("half")).agg(F.sum("l_quantity").alias("distance"), F.collect_list(step).alias("steps"))
    leg = F.struct("half", "distance", (F.col("half") + 7.0).alias("duration"), "steps")
    routes = halves.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(leg)).alias("legs"), F.sum("distance").alias("distance"))
    answer = F.to_json(F.struct(F.lit("Ok").alias("code"), F.array(F.struct("distance", "legs")).alias("routes")))
    found = services.read("routes", routes.select("id", answer.alias("answer")), "answer").select("id", F.posexplode("legs").alias("leg", "l"))
    return found.select("id", "leg", "l.distance", "l.duration", F.size("l.steps").cast("long").alias("steps"), F.size("l.geometry").cast("long").alias("points"))


@query(
    "SELECT c_custkey, service, CASE service WHEN 'nominatim' THEN 'T' || c_nationkey WHEN 'google' THEN 'p' || c_custkey ELSE c_mktsegment END AS told, CASE WHEN service = 'nominatim' AND c_custkey % 2 = 0 THEN 'city' END AS kind "
    "FROM customer, (VALUES ('nominatim'), ('google'), ('photon')) AS v(service)"
)
def place_properties(spark, sf_dir):
    """What three services say of each customer's place besides."""
    c = table(spark, sf_dir, "customer")
    address = F.struct(F.concat(F.lit("T"), "c_nationkey").alias("town"), F.lit("lost").alias("type"))
    raw = F.struct(F.lit("1").alias("lat"), F.lit("2").alias("lon"), F.col("c_name").alias("display_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit("city")).alias("type"), address.alias("address"), F.col("c_custkey").alias("osm_id"))
    spot = F.struct(F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng")).alias("location"))
    google = F.struct(F.array(F.struct(F.concat(F.lit("p"), "c_custkey").alias("place_id"), F.col("c_name").alias("formatted_address"), spot.alias("geometry"), F.array(F.lit("country")).alias("types"))).alias("results"), F.lit("OK").alias("status"))
    photon = F.struct(F.array(F.struct(F.struct(F.col("c_mktsegment").alias("extra"), F.col("c_name").alias("name")).alias("properties"))).alias("features"))
    out = None
    for service, read, answer, path in (
        ("nominatim", services.nominatim_places, F.to_json(F.array(raw)), "$.town"), ("google", services.google_places, F.to_json(google), "$.place_id"), ("photon", services.photon_places, F.to_json(photon), "$.extra"),
    ):
        found = read(c.select("c_custkey", answer.alias("answer")), "answer")
        kind = F.when(F.lit(service) == "nominatim", F.get_json_object("properties", "$.type"))
        one = found.select("c_custkey", F.lit(service).alias("service"), F.get_json_object("properties", path).alias("told"), F.when(kind != "lost", kind).alias("kind"))
        out = one if out is None else out.union(one)
    return out


#: Expressions that take the place of a width, by p_partkey % 6, and what is wrong in each: path after the property, and message.
EXPRESSIONS = [
    ('["interpolate",["linear"],["zoom"],0,1,#,9]', None, None),
    ('["case",["has","a"],["+",1,"x"],#]', ".2", "+ takes numbers"),
    ('["all",["all",["all",["==",#]]]]', ".1.1.1", "a wrong number of arguments to =="),
    ('["step",["zoom"],0,#,1,3,2]', "", "stops of step don't grow"),
    ('["match",["get","k"],[["a"]],1,#]', "", "labels of match are scalars"),
    ('["coalesce",["get",#],["interpolate",["bent"],["zoom"],0,1,5,#]]', ".1", "get takes a key"),
]


@query(
    "SELECT p_partkey, 'layers.1.paint.line-width' || path AS path, message FROM part JOIN (VALUES "
    + ", ".join(f"({k}, '{path}', '{message.replace(chr(39), chr(39) * 2)}')" for k, (_, path, message) in enumerate(EXPRESSIONS) if message)
    + ", (5, '.2', 'no such curve')) AS v(k, path, message) ON p_partkey % 6 = k WHERE k <> 3 OR p_size >= 3"
)
def style_expression_issues(spark, sf_dir):
    """What is wrong in an expression of each part's style, whose numbers are the part's."""
    texts = F.element_at(F.array(*[F.lit(t) for t, _, _ in EXPRESSIONS]), (P() % len(EXPRESSIONS) + 1).cast("int"))
    style = F.replace(F.lit(STYLE), F.lit('"line-width":2'), F.concat(F.lit('"line-width":'), F.replace(texts, F.lit("#"), F.col("p_size").cast("string"))))
    return style_expressions.expression_issues(table(spark, sf_dir, "part").select("p_partkey", style.alias("style")), "p_partkey", "style")
