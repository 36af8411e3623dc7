"""Answers of geocoding, routing, isochrone and matrix services, each brought into one form, in built-in functions.

Places: text, lat, lng, bbox (west, south, east, north), place_type, relevance, properties (JSON: what the service says
besides). Routes: distance (metres), duration (seconds), geometry, steps (distance, duration, instruction, maneuver,
geometry) and legs (distance, duration, geometry, steps; null from a service that gives no legs of its own). Isochrones: contour, geometry,
holes. Matrices: durations and distances by origin and destination. Geometries are arrays of points x (longitude) and y
(latitude). An answer is one JSON text; one that doesn't parse gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import POINTS
from tilewright.functions.text import decoded_polylines, strip_html

BOX = "array<double>"
NO_POINTS = lambda: F.array().cast(POINTS)
#: The kinds of places that are handed on as they are.
COMMON = ("country", "region", "district", "postcode", "place", "address", "poi")


def _rows(answers: DataFrame, column: str, schema: str, items: Callable[[Column], Column], raw: str | None = None) -> DataFrame:
    """One row for each of the answer's items, as `__i`, with its place `rank` from 0. raw: the path of the array of items,
    each of which then comes along whole as `__raw`."""
    parsed = answers.withColumn("__a", F.from_json(column, schema))
    each = parsed.select("*", F.posexplode(items(F.col("__a"))).alias("rank", "__i"))
    if raw:
        each = each.withColumn("__raw", F.get(F.try_variant_get(F.try_parse_json(column), raw, "array<variant>"), F.col("rank")))
    return each.drop("__a", column)


def _told(*names: str) -> Column:
    """What an item says under these names, as JSON; its object `properties` without names."""
    if not names:
        return F.to_json(F.try_variant_get("__raw", "$.properties", "variant"))
    own = [F.struct(F.lit(n).alias("key"), F.try_variant_get("__raw", f"$.{n}", "variant").alias("value")) for n in names]
    return F.filter(F.array(*own), lambda e: e["value"].isNotNull())


def _places(rows: DataFrame, text: Column, lat: Column, lng: Column, bbox: Column, place_type: Column, relevance: Column | None = None, limit: int | None = None, properties: Column | None = None) -> DataFrame:
    """limit: the first so many places of each answer."""
    rows = rows if limit is None else rows.where(F.col("rank") < limit)
    keys = [c for c in rows.columns if c not in ("__i", "__raw")]
    told = _told() if properties is None else properties
    score = F.lit(None).cast("double") if relevance is None else relevance
    return rows.select(*keys, text.alias("text"), lat.alias("lat"), lng.alias("lng"), bbox.alias("bbox"), place_type.alias("place_type"), score.alias("relevance"), told.alias("properties"))


def _spot(c: Column, k: int) -> Column:
    return F.coalesce(F.get(c, F.lit(k)), F.lit(0.0))


def nominatim_places(answers: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Of a search (a list) or of one reverse lookup (an object)."""
    raw = "lat string, lon string, display_name string, class string, type string, importance double, boundingbox array<string>"
    listed = F.when(F.trim(column).startswith("["), F.col(column)).otherwise(F.concat(F.lit("["), column, F.lit("]")))
    rows = _rows(answers.withColumn(column, listed), column, f"array<struct<{raw}>>", lambda a: a, "$")
    i = F.col("__i")
    k, t = i["class"], i["type"]
    kind = (
        F.when((k == "boundary") & (t == "administrative"), "region").when(t == "country", "country").when(t.isin("state", "province"), "region").when(t.isin("city", "town", "village"), "place")
        .when(t == "postcode", "postcode").when(t == "administrative", "district").when((k == "highway") | ((k == "place") & (t == "house")), "address").when(k.isin("amenity", "shop", "tourism"), "poi")
    )
    side = lambda n: F.get(i.boundingbox, F.lit(n)).cast("double")
    bbox = F.when(i.boundingbox.isNotNull(), F.array(side(2), side(0), side(3), side(1)))
    relevance = F.when(i.importance.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), i.importance)))
    names = ("osm_id", "osm_type", "class", "type")
    own = F.map_from_entries(_told(*names))
    address = F.coalesce(F.try_variant_get("__raw", "$.address", "map<string,variant>"), F.map_filter(own, lambda k, v: F.lit(False)))
    told = F.to_json(F.map_concat(F.map_filter(address, lambda k, v: ~k.isin(*names)), own))
    return _places(rows, i.display_name, i.lat.cast("double"), i.lon.cast("double"), bbox, kind, relevance, limit, told)


def photon_places(answers: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    own = "name:string,street:string,housenumber:string,postcode:string,city:string,country:string,osm_key:string,osm_value:string,type:string,extent:array<double>"
    rows = _rows(answers, column, f"features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<{own}>>>", lambda a: a.features, "$.features")
    i = F.col("__i")
    p, at = i.properties, i.geometry.coordinates
    v, t, k = p.osm_value, p.type, p.osm_key
    kind = (
        F.when((v == "country") | (t == "country"), "country").when((v == "state") | (t == "state"), "region").when(t == "county", "district").when((k == "place") & v.isin("city", "town", "village"), "place")
        .when((k == "highway") | (F.length(p.housenumber) > 0), "address").when((F.length(p.postcode) > 0) & (t == "postcode"), "postcode").when(k.isin("amenity", "shop", "tourism"), "poi")
    )
    some = lambda c: F.when(F.length(c) > 0, c)
    street = F.when(some(p.street).isNotNull(), F.concat_ws(" ", p.street, some(p.housenumber)))
    street = F.when(~street.eqNullSafe(some(p["name"])), street)
    town = some(F.concat_ws(" ", some(p.postcode), some(p.city)))
    label = F.concat_ws(", ", some(p["name"]), street, town, some(p.country))
    side = lambda n: F.get(p.extent, F.lit(n))
    bbox = F.when(p.extent.isNotNull(), F.array(side(0), side(3), side(2), side(1)))
    return _places(rows, label, _spot(at, 1), _spot(at, 0), bbox, kind, None, limit)


def mapbox_places(answers: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    own = f"full_address:string,name:string,bbox:{BOX},feature_type:string"
    rows = _rows(answers, column, f"features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<{own}>,relevance:double>>", lambda a: a.features, "$.features")
    i = F.col("__i")
    p, at = i.properties, i.geometry.coordinates
    return _places(rows, F.coalesce(p.full_address, p["name"], F.lit("")), _spot(at, 1), _spot(at, 0), p.bbox, F.when(p.feature_type.isin(*COMMON), p.feature_type), i.relevance, limit)


def maptiler_places(answers: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    rows = _rows(answers, column, f"features array<struct<place_name:string,text:string,center:array<double>,bbox:{BOX},place_type:array<string>,relevance:double>>", lambda a: a.features, "$.features")
    i = F.col("__i")
    kind = F.get(i.place_type, F.lit(0))
    return _places(rows, F.coalesce(i.place_name, i.text, F.lit("")), _spot(i.center, 1), _spot(i.center, 0), i.bbox, F.when(kind.isin(*COMMON), kind), i.relevance, limit)


def google_places(answers: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    spot = "struct<lat:double,lng:double>"
    box = f"struct<northeast:{spot},southwest:{spot}>"
    rows = _rows(answers, column, f"results array<struct<formatted_address:string,geometry:struct<location:{spot},bounds:{box},viewport:{box}>,types:array<string>>>", lambda a: a.results, "$.results")
    i = F.col("__i")
    b = F.coalesce(i.geometry.bounds, i.geometry.viewport)
    has = lambda *names: F.arrays_overlap(i.types, F.array(*map(F.lit, names)))
    kind = (
        F.when(has("country"), "country").when(has("administrative_area_level_1"), "region").when(has("administrative_area_level_2"), "district").when(has("postal_code"), "postcode")
        .when(has("locality", "sublocality"), "place").when(has("street_address", "route", "premise"), "address").when(has("point_of_interest", "establishment"), "poi")
    )
    bbox = F.when(b.isNotNull(), F.array(b.southwest.lng, b.southwest.lat, b.northeast.lng, b.northeast.lat))
    told = F.to_json(F.map_from_entries(_told("place_id", "types", "address_components")))
    return _places(rows, i.formatted_address, i.geometry.location.lat, i.geometry.location.lng, bbox, kind, None, limit, told)


def _line(c: Column) -> Column:
    """[[lng, lat], ...] as points."""
    return F.coalesce(F.transform(c, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))), NO_POINTS())


def _step(distance: Column, duration: Column, instruction: Column, maneuver: Column, geometry: Column) -> Column:
    return F.struct(distance.alias("distance"), duration.alias("duration"), instruction.alias("instruction"), maneuver.cast("string").alias("maneuver"), geometry.alias("geometry"))


STEP = f"struct<distance:double,duration:double,instruction:string,maneuver:string,geometry:{POINTS}>"
LEGS = f"array<struct<distance:double,duration:double,geometry:{POINTS},steps:array<{STEP}>>>"


def _leg(distance: Column, duration: Column, geometry: Column, steps: Column) -> Column:
    return F.struct(distance.alias("distance"), duration.alias("duration"), geometry.alias("geometry"), steps.alias("steps"))


def _routes(rows: DataFrame, distance: Column, duration: Column, geometry: Column, steps: Column, legs: Column | None = None) -> DataFrame:
    """geometry may be made of the column `steps`, geometry and steps of `legs`: a column that is read twice is made once."""
    keys = [c for c in rows.columns if c not in ("__i", "__steps", "__lines")]
    own = F.lit(None) if legs is None else legs
    made = rows.withColumn("legs", own.cast(LEGS)).withColumn("steps", steps)
    return made.select(*keys, distance.alias("distance"), duration.alias("duration"), geometry.alias("geometry"), "steps", "legs")


def _all(legs: Column, of: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(F.coalesce(legs, F.array()), of))


def osrm_routes(answers: DataFrame, column: str) -> DataFrame:
    """An instruction that is missing is made of the maneuver and the street's name."""
    line = "struct<coordinates:array<array<double>>>"
    step = f"struct<distance:double,duration:double,name:string,geometry:{line},maneuver:struct<type:string,modifier:string,instruction:string>>"
    rows = _rows(answers, column, f"code string, routes array<struct<distance:double,duration:double,geometry:{line},legs:array<struct<distance:double,duration:double,steps:array<{step}>>>>>", lambda a: F.when(a.code == "Ok", a.routes))
    i = F.col("__i")

    def told(s: Column) -> Column:
        m, some = s.maneuver, lambda c: F.when(F.length(c) > 0, c)
        made = F.concat_ws(" ", some(m.type), some(m.modifier), F.concat(F.lit("onto "), some(s["name"])))
        instruction = F.coalesce(some(m.instruction), some(F.trim(made)), F.lit("continue"))
        maneuver = F.when(F.length(m.type) > 0, F.coalesce(F.regexp_replace(F.concat(m.type, F.lit("-"), some(m.modifier)), r"\s+", "-"), m.type))
        return _step(s.distance, s.duration, instruction, maneuver, _line(s.geometry.coordinates))

    def one(leg: Column) -> Column:
        own = F.coalesce(F.transform(leg.steps, told), F.array().cast(f"array<{STEP}>"))
        return _leg(leg.distance, leg.duration, F.flatten(F.transform(own, lambda s: s.geometry)), own)

    legs = F.transform(F.coalesce(i.legs, F.array()), one)
    return _routes(rows, i.distance, i.duration, _line(i.geometry.coordinates), F.flatten(F.transform("legs", lambda leg: leg.steps)), legs)


def valhalla_routes(answers: DataFrame, column: str) -> DataFrame:
    """Kilometres become metres; a step's geometry is its slice of the leg's shape."""
    move = "struct<length:double,time:double,instruction:string,begin_shape_index:int,end_shape_index:int>"
    trip = f"struct<summary:struct<length:double,time:double>,legs:array<struct<summary:struct<length:double,time:double>,shape:string,maneuvers:array<{move}>>>>"
    rows = _rows(answers, column, f"trip {trip}, alternates array<struct<trip:{trip}>>", lambda a: F.filter(F.concat(F.array(a.trip), F.coalesce(F.transform(a.alternates, lambda x: x.trip), F.array().cast(f"array<{trip}>"))), lambda t: t.isNotNull()))
    i, zero = F.col("__i"), F.lit(0.0)
    rows = rows.withColumn("__lines", decoded_polylines(F.transform(i.legs, lambda leg: leg["shape"]), 6))
    legs = F.transform(i.legs, lambda leg, k: F.struct(leg.summary.alias("summary"), F.get("__lines", k).alias("shape"), leg.maneuvers.alias("moves")))

    def told(leg: Column) -> Column:
        def one(m: Column) -> Column:
            first = F.coalesce(m.begin_shape_index, F.lit(0))
            last = F.coalesce(m.end_shape_index, first)
            return _step(F.coalesce(m.length, zero) * 1000, F.coalesce(m.time, zero), F.coalesce(m.instruction, F.lit("")), F.lit(None), F.slice(leg["shape"], first + 1, F.greatest(last - first + 1, F.lit(0))))

        return F.coalesce(F.transform(leg.moves, one), F.array().cast(f"array<{STEP}>"))

    whole = F.transform(F.coalesce(legs, F.array()), lambda leg: _leg(F.coalesce(leg.summary.length, zero) * 1000, F.coalesce(leg.summary.time, zero), F.coalesce(leg["shape"], NO_POINTS()), told(leg)))
    return _routes(rows, F.coalesce(i.summary.length, zero) * 1000, F.coalesce(i.summary.time, zero), F.flatten(F.transform("legs", lambda leg: leg.geometry)), F.flatten(F.transform("legs", lambda leg: leg.steps)), whole)


def google_routes(answers: DataFrame, column: str) -> DataFrame:
    """A route's distance and duration are the sums of its legs'."""
    n, shape = "struct<value:double>", "struct<points:string>"
    step = f"struct<distance:{n},duration:{n},html_instructions:string,maneuver:string,polyline:{shape}>"
    rows = _rows(answers, column, f"status string, routes array<struct<overview_polyline:{shape},legs:array<struct<distance:{n},duration:{n},steps:array<{step}>>>>>", lambda a: F.when(a.status.isin("OK", "ZERO_RESULTS"), a.routes))
    i, zero = F.col("__i"), F.lit(0.0)
    rows = rows.withColumn("__steps", _all(i.legs, lambda leg: leg.steps))
    shapes = F.concat(F.array(i.overview_polyline.points), F.coalesce(F.transform("__steps", lambda s: s.polyline.points), F.array()))
    rows = rows.withColumn("__lines", decoded_polylines(shapes))
    told = lambda s, k: _step(F.coalesce(s.distance.value, zero), F.coalesce(s.duration.value, zero), strip_html(s.html_instructions), s.maneuver, F.get("__lines", k + 1))
    steps = F.transform("__steps", told)
    total = lambda of: F.aggregate(F.coalesce(i.legs, F.array()), zero, lambda s, leg: s + F.coalesce(of(leg), zero))
    geometry = F.when(i.overview_polyline.isNotNull(), F.get("__lines", F.lit(0))).otherwise(F.flatten(F.transform("steps", lambda s: s.geometry)))
    return _routes(rows, total(lambda leg: leg.distance.value), total(lambda leg: leg.duration.value), geometry, steps)


def isochrones(answers: DataFrame, column: str) -> DataFrame:
    """Rows contour, geometry (the outer ring, or a line) and holes, from a collection of polygons, multi-polygons and
    lines; polygons without rings are left out."""
    rows = _rows(answers, column, "features array<struct<properties:struct<contour:double>,geometry:struct<type:string,coordinates:string>>>", lambda a: a.features)
    g = F.col("__i.geometry")
    shape = "array<array<array<double>>>"
    polygons = (
        F.when(g.type == "Polygon", F.array(F.from_json(g.coordinates, shape))).when(g.type == "MultiPolygon", F.from_json(g.coordinates, f"array<{shape}>"))
        .when(g.type == "LineString", F.array(F.array(F.from_json(g.coordinates, "array<array<double>>"))))
    )
    keys = [c for c in rows.columns if c != "__i"]
    each = rows.select(*keys, F.coalesce("__i.properties.contour", F.lit(0.0)).alias("contour"), F.explode(polygons).alias("__p")).where(F.size("__p") > 0)
    rings = F.transform("__p", _line)
    return each.select(*keys, "contour", F.get(rings, F.lit(0)).alias("geometry"), F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))).alias("holes"))


mapbox_isochrones = valhalla_isochrones = isochrones


def osrm_matrix(answers: DataFrame, column: str) -> DataFrame:
    """Where no way is found, the value is infinite."""
    table = "array<array<double>>"
    parsed = answers.withColumn("__a", F.from_json(column, f"code string, durations {table}, distances {table}")).where("__a.code = 'Ok'")
    full = lambda c: F.transform(c, lambda row: F.transform(row, lambda v: F.coalesce(v, F.lit(float("inf")))))
    return parsed.select(*[c for c in answers.columns if c != column], full(F.col("__a.durations")).alias("durations"), full(F.col("__a.distances")).alias("distances"))


def mapbox_matrix(answers: DataFrame, column: str) -> DataFrame:
    table = "array<array<double>>"
    parsed = answers.withColumn("__a", F.from_json(column, f"code string, durations {table}, distances {table}")).where("__a.code = 'Ok'")
    return parsed.select(*[c for c in answers.columns if c != column], "__a.durations", "__a.distances")


def valhalla_matrix(answers: DataFrame, column: str) -> DataFrame:
    parsed = answers.withColumn("__a", F.from_json(column, "sources_to_targets array<array<struct<distance:double,time:double>>>"))
    cells, zero = F.col("__a.sources_to_targets"), F.lit(0.0)
    of = lambda pick: F.transform(cells, lambda row: F.transform(row, pick))
    return parsed.where("__a.sources_to_targets IS NOT NULL").select(
        *[c for c in answers.columns if c != column], of(lambda c: F.coalesce(c.time, zero)).alias("durations"), of(lambda c: F.coalesce(c.distance, zero) * 1000).alias("distances")
    )


#: Readers by what they answer and by service; register() adds one's own.
READERS: dict[tuple[str, str], Callable[[DataFrame, str], DataFrame]] = {
    ("places", "nominatim"): nominatim_places, ("places", "photon"): photon_places, ("places", "mapbox"): mapbox_places, ("places", "maptiler"): maptiler_places, ("places", "google"): google_places,
    ("routes", "osrm"): osrm_routes, ("routes", "valhalla"): valhalla_routes, ("routes", "google"): google_routes,
    ("isochrones", "valhalla"): isochrones, ("isochrones", "mapbox"): isochrones,
    ("matrix", "osrm"): osrm_matrix, ("matrix", "valhalla"): valhalla_matrix, ("matrix", "mapbox"): mapbox_matrix,
}
#: The service that is read where none is named.
DEFAULTS = {"places": "nominatim", "routes": "osrm", "isochrones": "valhalla", "matrix": "osrm"}


def register(kind: str, service: str, reader: Callable[[DataFrame, str], DataFrame]) -> None:
    READERS[kind, service] = reader


def read(kind: str, answers: DataFrame, column: str, service: str | None = None) -> DataFrame:
    return READERS[kind, service or DEFAULTS[kind]](answers, column)
