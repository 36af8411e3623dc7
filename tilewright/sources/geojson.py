"""GeoJSON: documents to features and back, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geo, geometry

GEOMETRY = "type:string,coordinates:string"
NESTED = f"{GEOMETRY},geometries:array<string>"
#: Collections within collections that are opened.
DEPTH = 12
FEATURE = f"type:string,id:string,properties:map<string,string>,geometry:struct<{NESTED}>"
KINDS = {"Point": 1, "MultiPoint": 1, "LineString": 2, "MultiLineString": 2, "Polygon": 3, "MultiPolygon": 3}
XYZ = "array<double>"


def _feature(kind: Column, feature_id: Column, properties: Column, geometry: Column) -> Column:
    return F.struct(kind.alias("type"), feature_id.alias("id"), properties.alias("properties"), geometry.alias("geometry"))


def _opened(members: Column) -> Column:
    """Geometries (JSON) with those of collections among them in their place, at any depth up to DEPTH; in order."""
    nested = lambda g: F.coalesce(F.get_json_object(g, "$.type") == "GeometryCollection", F.lit(False))
    inner = lambda g: F.coalesce(F.from_json(F.get_json_object(g, "$.geometries"), "array<string>"), F.array().cast("array<string>"))
    for _ in range(DEPTH):
        members = F.flatten(F.transform(members, lambda g: F.when(nested(g), inner(g)).otherwise(F.array(g))))
    return F.transform(members, lambda g: F.from_json(g, f"struct<{GEOMETRY}>"))


def read_features(docs: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """One row per geometry of a FeatureCollection, a Feature, a bare geometry or an array of features: the other columns
    of docs, then id, properties, geometry_type, coordinates (as JSON) and kind. The members of a GeometryCollection,
    and of collections within it, come each by itself with the feature's id and properties. Features without geometry and what is no GeoJSON give no
    row; with `strict` a geometry of an unknown type stops the job, else it has no kind."""
    none = F.lit(None).cast("string")
    g = F.from_json(column, f"type string, features array<struct<{FEATURE}>>, id string, properties map<string,string>, geometry struct<{NESTED}>, coordinates string, geometries array<string>")
    listed = F.from_json(column, f"array<struct<{FEATURE}>>")
    parsed = docs.withColumns({"__g": g, "__l": F.when(F.trim(column).startswith("["), listed)})
    g = F.col("__g")
    bare = F.struct(g.type.alias("type"), g.coordinates.alias("coordinates"), g.geometries.alias("geometries"))
    whole = _feature(F.lit("Feature"), none, F.create_map().cast("map<string,string>"), bare)
    several = (
        F.when(F.col("__l").isNotNull(), F.col("__l")).when(g.features.isNotNull(), g.features).when(g.geometry.isNotNull(), F.array(_feature(g.type, g.id, g.properties, g.geometry))).when(g.coordinates.isNotNull() | g.geometries.isNotNull(), F.array(whole))
    )
    each = parsed.withColumn("__f", F.explode(several)).where("__f.geometry IS NOT NULL")
    inner = F.col("__f.geometry")
    members = F.when(inner.geometries.isNotNull(), _opened(inner.geometries)).otherwise(F.array(F.struct(inner.type.alias("type"), inner.coordinates.alias("coordinates"))))
    each = each.withColumn("__m", F.explode(members))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("__m.type"))
    if strict:
        kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("no geometry of type "), F.coalesce("__m.type", F.lit("null")))).cast("int"))
    return each.select(*[c for c in docs.columns if c != column], F.col("__f.id").alias("id"), F.col("__f.properties").alias("properties"), F.col("__m.type").alias("geometry_type"), F.col("__m.coordinates").alias("coordinates"), kind.alias("kind"))


def _point(c: Column) -> Column:
    return F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))


def typed_parts(geometry_type: Column, coordinates: Column) -> Column:
    """Coordinates (JSON) as parts, arrays of points x (longitude) and y (latitude): each point of a multi-point, line of
    a multi-line and ring of a polygon by itself; a multi-polygon's rings one after the other."""
    one = lambda depth: F.from_json(coordinates, "array<" * depth + XYZ + ">" * depth)
    line = lambda c: F.transform(c, _point)
    return (
        F.when(geometry_type == "Point", F.array(F.array(_point(one(0)))))
        .when(geometry_type == "MultiPoint", F.transform(one(1), lambda c: F.array(_point(c))))
        .when(geometry_type == "LineString", F.array(line(one(1))))
        .when(geometry_type.isin("MultiLineString", "Polygon"), F.transform(one(2), line))
        .when(geometry_type == "MultiPolygon", F.transform(F.flatten(one(3)), line))
    )


def coords_to_latlng(coordinates: Column) -> Column:
    """lat, lng and alt of one position (JSON)."""
    c = F.from_json(coordinates, XYZ)
    return F.struct(*[F.get(c, F.lit(k)).alias(n) for n, k in (("lat", 1), ("lng", 0), ("alt", 2))])


def latlng_to_coords(latlng: Column, places: int | None = 6) -> Column:
    """[lng, lat] or [lng, lat, alt] rounded to so many places."""
    r = (lambda v: v) if places is None else (lambda v: geo.rounded(v, places))
    flat = F.array(r(latlng.lng), r(latlng.lat))
    return F.when(latlng.alt.isNotNull(), F.concat(flat, F.array(r(latlng.alt)))).otherwise(flat)


def _positions(points: Column, places: int) -> Column:
    return F.transform(points, lambda p: F.array(geo.rounded(p.x, places), geo.rounded(p.y, places)))


def as_feature(geometry_type: str, coordinates: Column, properties: Column | None = None, feature_id: Column | None = None) -> Column:
    """A feature as GeoJSON text; without properties, with none."""
    properties = F.create_map().cast("map<string,string>") if properties is None else properties
    ids = [] if feature_id is None else [feature_id.alias("id")]
    return F.to_json(F.struct(F.lit("Feature").alias("type"), *ids, properties.alias("properties"), F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def point_feature(lng: Column, lat: Column, properties: Column, feature_id: Column, places: int = 6) -> Column:
    """A point feature as GeoJSON text."""
    return as_feature("Point", F.array(F.round(lng, places), F.round(lat, places)), properties, feature_id)


def points_feature(points: Column, properties: Column, feature_id: Column, places: int = 6) -> Column:
    return as_feature("MultiPoint", _positions(points, places), properties, feature_id)


def line_feature(line: Column, properties: Column, feature_id: Column, places: int = 6) -> Column:
    return as_feature("LineString", _positions(line, places), properties, feature_id)


def lines_feature(lines: Column, properties: Column, feature_id: Column, places: int = 6) -> Column:
    return as_feature("MultiLineString", F.transform(lines, lambda c: _positions(c, places)), properties, feature_id)


def polygon_feature(rings: Column, properties: Column, feature_id: Column, places: int = 6) -> Column:
    """Rings are closed where they aren't."""
    return as_feature("Polygon", F.transform(rings, lambda r: _positions(geometry.closed(r), places)), properties, feature_id)


def polygons_feature(polygons: Column, properties: Column, feature_id: Column, places: int = 6) -> Column:
    rings = lambda p: F.transform(p, lambda r: _positions(geometry.closed(r), places))
    return as_feature("MultiPolygon", F.transform(polygons, rings), properties, feature_id)


def collections(features: DataFrame, column: str, *groups: str, kind: str = "FeatureCollection") -> DataFrame:
    """One document for each group of features (GeoJSON texts), a FeatureCollection or a GeometryCollection. A document is
    as large as its group: choose groups of a size that one task can hold."""
    if kind == "FeatureCollection":
        head, member = '{"type":"FeatureCollection","features":[', F.col(column)
    else:
        head, member = '{"type":"GeometryCollection","geometries":[', F.get_json_object(column, "$.geometry")
    return features.groupBy(*groups).agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(member)), ","), F.lit("]}")).alias("document"))
