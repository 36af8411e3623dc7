"""Style documents as tables: what is wrong with them, what differs between two of them, and edits of their layers.

A document is one JSON text (an object with version, sources and layers). Documents are taken apart into rows of
sources, layers and properties, each a VARIANT value, so that checks and differences are filters and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions.expressions import OPERATORS
from tilewright.operators.shared import dealt

# The types of layers and sources, and the properties of each type of layer with what they may hold.
LAYER_TYPES = ("background", "fill", "fill-extrusion", "line", "circle", "symbol", "raster")
SOURCE_TYPES = ("vector", "raster", "raster-dem", "geojson")
ANCHORS = "center|left|right|top|bottom|top-left|top-right|bottom-left|bottom-right"
# type of layer, paint or layout, the value (number with its least and greatest, array with its length, choice with its
# values), then the properties.
PROPERTIES = f"""
background paint color : background-color
background paint number 0 1 : background-opacity
background paint image : background-pattern
background layout choice visible|none : visibility
fill paint boolean : fill-antialias
fill paint color : fill-color fill-outline-color
fill paint number 0 1 : fill-opacity
fill paint image : fill-pattern
fill paint array 2 : fill-translate
fill paint choice map|viewport : fill-translate-anchor
fill layout choice visible|none : visibility
fill layout number : fill-sort-key
fill-extrusion paint number 0 1 : fill-extrusion-opacity
fill-extrusion paint color : fill-extrusion-color
fill-extrusion paint array 2 : fill-extrusion-translate
fill-extrusion paint choice map|viewport : fill-extrusion-translate-anchor
fill-extrusion paint image : fill-extrusion-pattern
fill-extrusion paint number 0 : fill-extrusion-height fill-extrusion-base
fill-extrusion paint boolean : fill-extrusion-vertical-gradient
fill-extrusion layout choice visible|none : visibility
line paint number 0 1 : line-opacity
line paint color : line-color line-gradient
line paint array 2 : line-translate
line paint choice map|viewport : line-translate-anchor
line paint number 0 : line-width line-gap-width line-blur
line paint number : line-offset
line paint array : line-dasharray
line paint image : line-pattern
line layout choice visible|none : visibility
line layout choice butt|round|square : line-cap
line layout choice bevel|round|miter : line-join
line layout number : line-miter-limit line-round-limit line-sort-key
circle paint number 0 : circle-radius circle-stroke-width
circle paint color : circle-color circle-stroke-color
circle paint number : circle-blur
circle paint number 0 1 : circle-opacity circle-stroke-opacity
circle paint array 2 : circle-translate
circle paint choice map|viewport : circle-translate-anchor circle-pitch-scale circle-pitch-alignment
circle layout choice visible|none : visibility
circle layout number : circle-sort-key
symbol paint number 0 1 : icon-opacity text-opacity
symbol paint color : icon-color icon-halo-color text-color text-halo-color
symbol paint number 0 : icon-halo-width icon-halo-blur text-halo-width text-halo-blur
symbol paint array 2 : icon-translate text-translate
symbol paint choice map|viewport : icon-translate-anchor text-translate-anchor
symbol layout choice visible|none : visibility
symbol layout choice point|line|line-center : symbol-placement
symbol layout number 1 : symbol-spacing
symbol layout boolean : symbol-avoid-edges icon-allow-overlap icon-ignore-placement icon-optional icon-keep-upright text-keep-upright text-allow-overlap text-ignore-placement text-optional
symbol layout choice auto|viewport-y|source : symbol-z-order
symbol layout choice map|viewport|auto : icon-rotation-alignment icon-pitch-alignment text-pitch-alignment text-rotation-alignment
symbol layout number 0 : icon-size text-size text-max-width text-padding
symbol layout number : symbol-sort-key icon-rotate text-line-height text-letter-spacing text-radial-offset text-max-angle text-rotate
symbol layout choice none|width|height|both : icon-text-fit
symbol layout array 4 : icon-text-fit-padding
symbol layout image : icon-image
symbol layout padding : icon-padding
symbol layout array 2 : icon-offset text-offset
symbol layout choice {ANCHORS} : icon-anchor text-anchor
symbol layout text : text-field
symbol layout array : text-font text-variable-anchor text-writing-mode
symbol layout choice auto|left|center|right : text-justify
symbol layout choice none|uppercase|lowercase : text-transform
raster paint number 0 1 : raster-opacity raster-brightness-min raster-brightness-max
raster paint number : raster-hue-rotate
raster paint number -1 1 : raster-saturation raster-contrast
raster paint choice linear|nearest : raster-resampling
raster paint number 0 : raster-fade-duration
raster layout choice visible|none : visibility
"""


def property_rules(spark: SparkSession) -> DataFrame:
    """layer_type, kind, name, holds, least, greatest, length, choices: one row per property, about 130."""
    rows = []
    for line in PROPERTIES.strip().split("\n"):
        head, _, names = line.partition(" : ")
        layer_type, kind, holds, *limits = head.split()
        least, greatest = ([float(x) for x in limits] + [None, None])[:2] if holds == "number" else (None, None)
        length = int(limits[0]) if holds == "array" and limits else None
        rows += [(layer_type, kind, name, holds, least, greatest, length, limits[0].split("|") if holds == "choice" else None) for name in names.split()]
    return spark.createDataFrame(rows, "layer_type string, kind string, name string, holds string, least double, greatest double, length int, choices array<string>")


def _get(v: Column, *path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path), kind)


def _is(v: Column) -> Column:
    """object, array, string, boolean, number or null; NULL for what is missing."""
    s = F.schema_of_variant(v)
    return F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.isNotNull(), "number")


def _text(v: Column) -> Column:
    return F.when(_is(v) == "string", F.try_variant_get(v, "$", "string"))


def _issues(*found: tuple[Column, Column, str | Column]) -> Column:
    """(condition, path, message) as an array of the issues whose condition holds."""
    each = [F.when(F.coalesce(c, F.lit(False)), F.struct(path.alias("path"), F.lit(m).alias("message"))) for c, path, m in found]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def _path(*parts: str | Column) -> Column:
    return F.concat_ws(".", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _wrong(v: Column, want: str) -> Column:
    """Whether a value is there and is not of the wanted kind."""
    return v.isNotNull() & (_is(v) != want)


def style_issues(docs: DataFrame, key: str, column: str) -> DataFrame:
    """key, path and message of all that is wrong with each document. An array that begins with the name of an operator is
    an expression, which functions.expressions.validate checks; null documents and those that are no objects have one
    issue."""
    parsed, name, key = docs.select(F.col(key).alias("__key"), F.try_parse_json(column).alias("s")), key, "__key"
    s, whole = F.col("s"), _is(F.col("s")).eqNullSafe("object")
    version, sources, layers, centre, sprite = (_get(s, k) for k in ("version", "sources", "layers", "center", "sprite"))
    pair = F.try_variant_get(centre, "$", "array<variant>")
    numbers = (F.size(pair) == 2) & (_is(F.get(pair, F.lit(0))) == "number") & (_is(F.get(pair, F.lit(1))) == "number")
    root = _issues(
        (~whole, F.lit(""), "a style is an object"),
        (whole & version.isNull(), F.lit("version"), "version is missing"),
        (version.isNotNull() & ~(_is(version).eqNullSafe("number") & F.try_variant_get(version, "$", "double").eqNullSafe(8.0)), F.lit("version"), "version is not 8"),
        (whole & sources.isNull(), F.lit("sources"), "sources is missing"),
        (_wrong(sources, "object"), F.lit("sources"), "sources is no object"),
        (whole & layers.isNull(), F.lit("layers"), "layers is missing"),
        (_wrong(layers, "array"), F.lit("layers"), "layers is no array"),
        *[(_wrong(_get(s, k), "string"), F.lit(k), f"{k} is no string") for k in ("name", "glyphs")],
        *[(_wrong(_get(s, k), "number"), F.lit(k), f"{k} is no number") for k in ("zoom", "bearing", "pitch")],
        (centre.isNotNull() & ~F.coalesce(numbers, F.lit(False)), F.lit("center"), "center is no pair of numbers"),
        (_wrong(sprite, "string") & _wrong(sprite, "array"), F.lit("sprite"), "sprite is no string or array"),
    )
    found = [parsed.select(key, F.inline(root)), _source_issues(parsed, key), *_layer_issues(parsed, key, docs.sparkSession)]
    every = found[0]
    for one in found[1:]:
        every = every.union(one)
    return every.withColumnRenamed(key, name)


def _source_issues(parsed: DataFrame, key: str) -> DataFrame:
    rows = parsed.select(key, F.explode(_get(F.col("s"), "sources", kind="map<string,variant>")).alias("id", "v"))
    v, at = F.col("v"), lambda *more: _path("sources", F.col("id"), *more)
    whole, kind, tiles, url = _is(v) == "object", _text(_get(v, "type")), _get(v, "tiles"), _get(v, "url")
    tiled = kind.isin("vector", "raster", "raster-dem")
    listed = F.size(F.try_variant_get(tiles, "$", "array<variant>")) > 0
    return rows.select(
        key,
        F.inline(
            _issues(
                (~whole, at(), "a source is an object"),
                (whole & kind.isNull(), at("type"), "type is missing"),
                (whole & ~kind.isin(*SOURCE_TYPES), at("type"), F.concat(F.lit("no source type "), kind)),
                (tiled & _text(url).isNull() & ~F.coalesce(listed, F.lit(False)), at(), "a tiled source needs url or tiles"),
                (tiled & _wrong(tiles, "array"), at("tiles"), "tiles is no array"),
                (tiled & _wrong(url, "string"), at("url"), "url is no string"),
                *[(tiled & _wrong(_get(v, k), "number"), at(k), f"{k} is no number") for k in ("minzoom", "maxzoom")],
                ((kind == "geojson") & _get(v, "data").isNull(), at("data"), "data is missing"),
            )
        ),
    )


def _layer_issues(parsed: DataFrame, key: str, spark: SparkSession) -> list[DataFrame]:
    named = F.map_keys(_get(F.col("s"), "sources", kind="map<string,variant>"))
    rows = parsed.select(key, named.alias("named"), F.posexplode(_get(F.col("s"), "layers", kind="array<variant>")).alias("k", "v"))
    v, at = F.col("v"), lambda *more: _path("layers", F.col("k"), *more)
    whole, layer_id, kind, source = _is(v) == "object", _text(_get(v, "id")), _text(_get(v, "type")), _text(_get(v, "source"))
    again = F.row_number().over(Window.partitionBy(key, layer_id).orderBy("k")) > 1
    known = kind.isin(*LAYER_TYPES)
    made = rows.withColumns({"again": again, "kind": kind})
    own = made.select(
        key,
        F.inline(
            _issues(
                (~whole, at(), "a layer is an object"),
                (layer_id.isNotNull() & F.col("again"), at("id"), F.concat(F.lit("a second layer "), layer_id)),
                (whole & (F.length(F.coalesce(layer_id, F.lit(""))) == 0), at("id"), "id is missing"),
                (whole & kind.isNull(), at("type"), "type is missing"),
                (whole & ~known, at("type"), F.concat(F.lit("no layer type "), kind)),
                (known & (kind != "background") & source.isNull(), at("source"), "source is missing"),
                (known & (kind != "background") & ~F.array_contains("named", source), at("source"), F.concat(F.lit("no source "), source)),
                *[(known & _wrong(_get(v, k), "number"), at(k), f"{k} is no number") for k in ("minzoom", "maxzoom")],
                *[(known & _wrong(_get(v, k), "object"), at(k), f"{k} is no object") for k in ("paint", "layout")],
            )
        ),
    )
    parts = [made.where(known).select(key, "k", "kind", F.lit(part).alias("part"), F.explode(_get(v, part, kind="map<string,variant>")).alias("name", "value")) for part in ("paint", "layout")]
    rules = property_rules(spark).select(F.col("layer_type").alias("kind"), F.col("kind").alias("part"), "name", "holds", "least", "greatest", "length", "choices")
    told = parts[0].union(parts[1]).join(F.broadcast(rules), ["kind", "part", "name"], "left")  # about 130 rules
    value, holds = F.col("value"), F.col("holds")
    number, text, items = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "array<variant>")
    of, head = _is(value), _text(F.get(items, F.lit(0)))
    expression = (of == "array") & F.coalesce(head.isin(*sorted(OPERATORS)), F.lit(False))
    fits = (
        F.when(expression, True)
        .when(of == "array", ((holds == "array") & (F.col("length").isNull() | (F.size(items) == F.col("length")))) | ((holds == "padding") & F.size(items).isin(2, 4)))
        .when(holds.isin("color", "text", "image"), of == "string")
        .when(holds == "number", (of == "number") & (F.col("least").isNull() | (number >= F.col("least"))) & (F.col("greatest").isNull() | (number <= F.col("greatest"))))
        .when(holds == "boolean", of == "boolean")
        .when(holds == "choice", (of == "string") & F.array_contains("choices", text))
        .when(holds == "padding", of == "number")
        .otherwise(False)
    )
    at = _path("layers", F.col("k"), F.col("part"), F.col("name"))
    bad = told.select(
        key, F.inline(_issues((holds.isNull(), at, F.concat(F.lit("no such property of "), F.col("kind"))), (holds.isNotNull() & ~F.coalesce(fits, F.lit(False)), at, F.concat(F.lit("not a "), holds, F.lit(" as wanted")))))
    )
    return [own, bad]


def _same(a: Column, b: Column) -> Column:
    return F.to_json(a).eqNullSafe(F.to_json(b))


def style_changes(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, step (from 1), command, target, name, value (JSON) and anchor: what turns each document `before` into `after`.

    Commands: setStyle (all anew: another version, sprite, glyphs, or an order of layers that the others can't express),
    setTransition, setLight, addSource, removeSource, setSourceData, addLayer (below the layer `anchor`, on top without),
    removeLayer, setLayerZoomRange, setFilter, setPaintProperty, setLayoutProperty. Values equal but for the order of
    keys are equal. Of layers that repeat an id the last one counts. The key tells documents apart.

    Documents are dealt out by key before they are read, so that many small ones of one file are no single task's; each is
    taken apart once, into a row of its own and one for each layer, and its rows stay in the task."""
    docs = dealt(pairs.select(F.col(key).alias("__key"), F.col(before).alias("p"), F.col(after).alias("n")), "__key")
    parts = _parts(docs.select("__key", F.try_parse_json("p").alias("p"), F.try_parse_json("n").alias("n")))
    there = ~F.col("whole") & F.col("p_k").isNotNull() & F.col("n_k").isNotNull()
    order = Window.partitionBy("__key").orderBy("n_k")
    earlier, later, all_of = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy("__key")
    kept = F.when(there, F.struct("n_k", "id"))
    told = parts.withColumns({"back": there & (F.col("p_k") < F.last(F.when(there, F.col("p_k")), True).over(earlier)), "anchor": F.when(F.col("n_k").isNotNull(), F.min(kept).over(later)["id"])})
    told = told.withColumn("anew", F.max(F.coalesce("back", F.lit(False)) | F.coalesce("other", F.lit(False))).over(all_of))
    told = told.withColumns({"p_v": F.parse_json("p_v"), "n_v": F.parse_json("n_v")})
    made = told.select("__key", F.inline(F.when(F.col("whole"), _document_commands()).otherwise(_layer_commands())))
    step = F.row_number().over(Window.partitionBy("__key").orderBy("order"))
    return made.select(F.col("__key").alias(key), step.alias("step"), "command", "target", "name", "value", "anchor")


def _parts(docs: DataFrame) -> DataFrame:
    """docs (__key, p, n) -> __key, whole, id, other, p_k, p_v, n_k, n_v: a row of each document (whole; other: it has another
    version, sprite or glyphs), and one of each layer, the last of its id on either side. Values are JSON."""
    p, n = F.col("p"), F.col("n")
    other = ~(_same(_get(p, "version"), _get(n, "version")) & _same(_get(p, "sprite"), _get(n, "sprite")) & _same(_get(p, "glyphs"), _get(n, "glyphs")))

    def item(side: str, k: Column, v: Column, whole: bool = False) -> Column:
        layer_id = F.lit(None).cast("string") if whole else _text(_get(v, "id"))
        return F.struct(F.lit(whole).alias("whole"), F.lit(side).alias("side"), layer_id.alias("id"), k.cast("int").alias("k"), F.to_json(v).alias("v"))

    def layers(side: str) -> Column:
        return F.transform(F.coalesce(_get(F.col(side), "layers", kind="array<variant>"), F.array().cast("array<variant>")), lambda v, k: item(side, k, v))

    roots = F.array(*[item(side, F.lit(0), F.col(side), whole=True) for side in ("p", "n")])
    rows = docs.select("__key", other.alias("other"), F.inline(F.concat(roots, layers("p"), layers("n"))))
    apart = F.when(~F.col("whole") & F.col("id").isNull(), F.col("side"))  # layers without an id are never the same
    last = lambda side: F.max(F.when(F.col("side") == side, F.struct("k", "v")))
    met = rows.groupBy("__key", "whole", "id", apart.alias("apart")).agg(F.max("other").alias("other"), last("p").alias("p"), last("n").alias("n"))
    return met.select("__key", "whole", "id", "other", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("p", "n") for c in ("k", "v")])


def _command(condition: Column, phase: int, at: Column | None, sub: int, command: str, target: Column | None = None, value: Column | None = None, anchor: Column | None = None, name: Column | None = None) -> Column:
    """A command with its place among those of a document; null unless condition."""
    text = lambda v: F.lit(None).cast("string") if v is None else v.cast("string")
    order = F.struct(F.lit(phase).alias("phase"), F.coalesce(text(at), F.lit("")).alias("at"), F.lit(sub).alias("sub"), F.coalesce(text(name), F.lit("")).alias("name"))
    return F.when(condition, F.struct(order.alias("order"), F.lit(command).alias("command"), text(target).alias("target"), text(name).alias("name"), text(value).alias("value"), text(anchor).alias("anchor")))


def _document_commands() -> Column:
    """Commands of the row of a document: setStyle, or those of its sources and of what else is its own."""
    p, n, empty = F.col("p_v"), F.col("n_v"), F.create_map().cast("map<string,string>")
    own = [_command(_get(n, what).isNotNull() & ~_same(_get(p, what), _get(n, what)), k, None, 0, f"set{what.title()}", value=F.to_json(_get(n, what))) for k, what in enumerate(("transition", "light"), 1)]
    old, new = (F.coalesce(F.transform_values(_get(v, "sources", kind="map<string,variant>"), lambda _, x: F.to_json(x)), empty) for v in (p, n))
    bare = lambda v: F.to_json(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: k != "data"))

    def source(sid: Column) -> Column:
        return F.array(*source_commands(sid, F.parse_json(F.element_at(old, sid)), F.parse_json(F.element_at(new, sid))))

    def source_commands(sid: Column, pv: Column, nv: Column) -> list[Column]:
        data = (_text(_get(pv, "type")) == "geojson") & (_text(_get(nv, "type")) == "geojson") & bare(pv).eqNullSafe(bare(nv))
        differs, data = pv.isNotNull() & nv.isNotNull() & ~_same(pv, nv), F.coalesce(data, F.lit(False))
        return [
            _command(nv.isNull(), 3, sid, 0, "removeSource", sid),
            _command(differs & data, 4, sid, 0, "setSourceData", sid, F.to_json(_get(nv, "data"))),
            _command(differs & ~data, 4, sid, 0, "removeSource", sid),
            _command(pv.isNull() | (differs & ~data), 4, sid, 1, "addSource", sid, F.to_json(nv)),
        ]

    changed = F.filter(F.array_union(F.map_keys(old), F.map_keys(new)), lambda sid: ~F.element_at(old, sid).eqNullSafe(F.element_at(new, sid)))
    each = F.concat(F.array(*own), F.flatten(F.transform(changed, source)))
    return F.filter(F.when(F.col("anew"), F.array(_command(F.lit(True), 0, None, 0, "setStyle", value=F.to_json(n)))).otherwise(each), lambda c: c.isNotNull())


def _layer_commands() -> Column:
    """Commands of the row of a layer; none where the style is set anew."""
    pv, nv, sid, empty = F.col("p_v"), F.col("n_v"), F.col("id"), F.create_map().cast("map<string,string>")
    pad = lambda k: F.lpad(k.cast("string"), 9, "0")
    fresh = pv.isNull() | ~F.coalesce(_same(_get(pv, "type"), _get(nv, "type")) & _same(_get(pv, "source"), _get(nv, "source")) & _same(_get(pv, "source-layer"), _get(nv, "source-layer")), F.lit(False))
    at, there = pad(F.col("n_k")), pv.isNotNull() & nv.isNotNull()
    zooms = F.to_json(F.struct(_get(nv, "minzoom").alias("minzoom"), _get(nv, "maxzoom").alias("maxzoom")))
    stays = there & ~fresh
    each = F.array(
        _command(nv.isNull(), 5, pad(F.col("p_k")), 0, "removeLayer", sid),
        _command(there & fresh, 6, at, 0, "removeLayer", sid),
        _command(nv.isNotNull() & fresh, 6, at, 1, "addLayer", sid, F.to_json(nv), F.col("anchor")),
        _command(stays & ~(_same(_get(pv, "minzoom"), _get(nv, "minzoom")) & _same(_get(pv, "maxzoom"), _get(nv, "maxzoom"))), 6, at, 2, "setLayerZoomRange", sid, zooms),
        _command(stays & ~_same(_get(pv, "filter"), _get(nv, "filter")), 6, at, 3, "setFilter", sid, F.to_json(_get(nv, "filter"))),
    )
    for sub, part in ((4, "paint"), (5, "layout")):
        old, new = (F.coalesce(F.transform_values(_get(v, part, kind="map<string,variant>"), lambda k, x: F.to_json(x)), empty) for v in (pv, nv))
        names = F.when(stays & ~_same(_get(pv, part), _get(nv, part)), F.array_union(F.map_keys(new), F.map_keys(old))).otherwise(F.array().cast("array<string>"))

        def put(name: Column) -> Column:
            value = F.element_at(new, name)  # noqa: B023
            return _command(~F.element_at(old, name).eqNullSafe(value), 6, at, sub, f"set{part.title()}Property", sid, value, name=name)  # noqa: B023

        each = F.concat(each, F.transform(names, put))
    return F.when(~F.col("anew") & ~F.coalesce(_same(pv, nv), F.lit(False)), F.filter(each, lambda c: c.isNotNull()))


def layers_of(docs: DataFrame, key: str, column: str) -> DataFrame:
    """key, position, id and layer (JSON): a table of layers for the edits below."""
    rows = docs.select(key, F.posexplode(_get(F.try_parse_json(column), "layers", kind="array<variant>")).alias("__position", "__v"))
    return rows.select(key, F.col("__position").alias("position"), _text(_get(F.col("__v"), "id")).alias("id"), F.to_json("__v").alias("layer"))


def _changed(layers: DataFrame, layer_id: str, change) -> DataFrame:
    fields = F.try_variant_get(F.parse_json("layer"), "$", "map<string,variant>")
    return layers.withColumn("layer", F.when(F.col("id") == layer_id, F.to_json(change(fields))).otherwise(F.col("layer")))


def _put(fields: Column, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(fields, lambda k, _: k != name), F.create_map(F.lit(name), value))


def with_property(layers: DataFrame, layer_id: str, part: str, name: str, value: str) -> DataFrame:
    """One paint or layout property of a layer set to a value (JSON)."""
    none = F.from_json(F.lit("{}"), "map<string,variant>")

    def change(fields: Column) -> Column:
        inner = F.coalesce(F.try_variant_get(F.element_at(fields, part), "$", "map<string,variant>"), none)
        return _put(fields, part, F.parse_json(F.to_json(_put(inner, name, F.parse_json(F.lit(value))))))

    return _changed(layers, layer_id, change)


def with_filter(layers: DataFrame, layer_id: str, filter: str) -> DataFrame:  # noqa: A002
    return _changed(layers, layer_id, lambda fields: _put(fields, "filter", F.parse_json(F.lit(filter))))


def with_zooms(layers: DataFrame, layer_id: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """What is None stays as it is."""

    def change(fields: Column) -> Column:
        for name, v in (("minzoom", low), ("maxzoom", high)):
            fields = fields if v is None else _put(fields, name, F.parse_json(F.lit(str(v))))
        return fields

    return _changed(layers, layer_id, change)


def without_layer(layers: DataFrame, layer_id: str) -> DataFrame:
    return layers.where(~F.col("id").eqNullSafe(layer_id))


def with_layer(layers: DataFrame, key: str, layer_id: str, layer: str, before: str | None = None) -> DataFrame:
    """Each style with a new layer (JSON) below the layer `before`, on top where that is missing."""
    spot = F.coalesce(F.min(F.when(F.col("id") == before, F.col("position"))), F.max("position") + 1) if before else F.max("position") + 1
    at = layers.groupBy(key).agg(spot.cast("int").alias("__at"))
    rest = layers.join(at, key).withColumn("position", F.col("position") + (F.col("position") >= F.col("__at")).cast("int")).select(*layers.columns)
    return rest.unionByName(at.select(key, F.col("__at").alias("position"), F.lit(layer_id).alias("id"), F.lit(layer).alias("layer")))


def drawn_at(layers: DataFrame, zoom: Column | float) -> DataFrame:
    """The layers that are drawn at a zoom: visible, and within their own least and greatest zoom."""
    v, z = F.parse_json("layer"), F.lit(zoom)
    low, high = (_get(v, k, kind="double") for k in ("minzoom", "maxzoom"))
    shown = ~F.coalesce(_get(v, "layout", "visibility", kind="string") == "none", F.lit(False))
    return layers.where(shown & (low.isNull() | (z >= low)) & (high.isNull() | (z <= high)))
