"""Commands applied to style documents: an ordered fold over each document's parts, in one plan.

A document is held as its top-level values, its sources and its layers, each value as JSON text; a command changes one of
these. The commands of a document are one sorted array, so a document with all its commands is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.shared import dealt

FIELDS = "map<string,string>"
STATE = f"struct<top:{FIELDS},sources:{FIELDS},layers:array<{FIELDS}>>"


def _none(kind: str) -> Column:
    return F.from_json(F.lit("[]" if kind.startswith("array") else "{}"), kind)


def _fields(text: Column) -> Column:
    """An object's values by name, each as JSON; none where it is no object."""
    own = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    return F.coalesce(F.transform_values(own, lambda _, v: F.to_json(v)), _none(FIELDS))


def _json(fields: Column) -> Column:
    return F.to_json(F.transform_values(fields, lambda _, v: F.parse_json(v)))


def _put(fields: Column, name: Column, value: Column) -> Column:
    """fields with one set, or without it where value is null or JSON's null."""
    rest = F.map_filter(fields, lambda k, _: k != name)
    return F.when(F.coalesce(value, F.lit("null")) == "null", rest).otherwise(F.map_concat(rest, F.map_from_arrays(F.array(name), F.array(value))))


def _id(layer: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(F.element_at(layer, "id")), "$", "string")


def _state(document: Column) -> Column:
    """A document (JSON) taken apart."""
    whole = F.try_parse_json(document)
    top = F.map_filter(_fields(document), lambda k, _: ~k.isin("sources", "layers"))
    sources = _fields(F.to_json(F.try_variant_get(whole, "$.sources", "variant")))
    layers = F.transform(F.try_variant_get(whole, "$.layers", "array<variant>"), lambda v: _fields(F.to_json(v)))
    return F.struct(top.alias("top"), sources.alias("sources"), F.coalesce(layers, _none(f"array<{FIELDS}>")).alias("layers")).cast(STATE)


def _added(layers: Column, layer: Column, anchor: Column) -> Column:
    """layers with one more below the layer `anchor`, on top without it; one of the same id goes."""
    rest = F.filter(layers, lambda x: ~_id(x).eqNullSafe(_id(layer)))
    place = F.array_position(F.transform(rest, lambda x: F.coalesce(_id(x), F.lit(""))), F.coalesce(anchor, F.lit("\0"))).cast("int")
    at = F.when(place > 0, place).otherwise(F.size(rest) + 1)
    return F.concat(F.slice(rest, F.lit(1), at - 1), F.array(layer), F.slice(rest, at, F.size(rest) + 1))


def _step(state: Column, c: Column) -> Column:
    """The state after one command (command, target, name, value, anchor)."""
    what, target, value = c["command"], c["target"], c["value"]
    anew = _state(value)
    top = F.when(what == "setStyle", anew["top"])
    for command, name in (("setTransition", "transition"), ("setLight", "light")):
        top = top.when(what == command, _put(state["top"], F.lit(name), value))
    source = _fields(F.element_at(state["sources"], target))
    there = F.map_contains_key(state["sources"], target)
    sources = (
        F.when(what == "setStyle", anew["sources"])
        .when(what == "addSource", _put(state["sources"], target, value))
        .when(what == "removeSource", _put(state["sources"], target, F.lit(None).cast("string")))
        .when((what == "setSourceData") & there, _put(state["sources"], target, _json(_put(source, F.lit("data"), value))))
    )
    zooms = _fields(value)

    def edited(layer: Column) -> Column:
        part = F.when(what == "setPaintProperty", "paint").otherwise("layout")
        inner = _json(_put(_fields(F.element_at(layer, part)), c["name"], value))
        own = (
            F.when(what == "setLayerZoomRange", _put(_put(layer, F.lit("minzoom"), F.element_at(zooms, "minzoom")), F.lit("maxzoom"), F.element_at(zooms, "maxzoom")))
            .when(what == "setFilter", _put(layer, F.lit("filter"), value))
            .when(what.isin("setPaintProperty", "setLayoutProperty"), _put(layer, part, F.when(inner != "{}", inner)))
            .otherwise(layer)
        )
        return F.when(_id(layer) == target, own).otherwise(layer)

    layers = (
        F.when(what == "setStyle", anew["layers"])
        .when(what == "addLayer", _added(state["layers"], _fields(value), c["anchor"]))
        .when(what == "removeLayer", F.filter(state["layers"], lambda x: ~_id(x).eqNullSafe(target)))
        .otherwise(F.transform(state["layers"], edited))
    )
    return F.struct(top.otherwise(state["top"]).alias("top"), sources.otherwise(state["sources"]).alias("sources"), layers.alias("layers")).cast(STATE)


def style_applied(docs: DataFrame, commands: DataFrame, key: str, column: str) -> DataFrame:
    """docs (key, column: a style as JSON) after their commands (key, step, command, target, name, value, anchor, as
    styles.style_changes() gives them) in the order of step: key and column. Documents without commands come out the same
    but for the order and spacing of JSON. What is set to null goes, and with the last of its properties a layer's paint
    or layout. Commands on what isn't there change nothing; unknown ones neither. A text that is no JSON object counts as
    an empty style; commands of keys without a document are left out."""
    folded = commands.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("step", "command", "target", "name", "value", "anchor"))).alias("__commands"))
    held = dealt(docs.select(key, column), key).join(folded, key, "left").withColumn("__state", _state(F.col(column)))  # taken apart where they are dealt out
    after = F.when(F.col("__commands").isNull(), F.col("__state")).otherwise(F.aggregate("__commands", F.col("__state"), _step))
    told = held.select(key, after.alias("__state"))
    sources = F.parse_json(_json(F.col("__state.sources")))
    layers = F.parse_json(F.to_json(F.transform("__state.layers", lambda x: F.transform_values(x, lambda _, v: F.parse_json(v)))))
    values = F.transform_values("__state.top", lambda _, v: F.parse_json(v))
    parts = F.map_from_arrays(F.array(F.lit("sources"), F.lit("layers")), F.array(sources, layers))
    return told.select(key, F.to_json(F.map_concat(values, parts)).alias(column))
