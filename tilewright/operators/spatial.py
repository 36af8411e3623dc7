"""Spatial joins and feature queries.

Joins meet on the cells of a grid: an equality that Spark shuffles and, where a cell is crowded, splits. Only then are
distances or boxes compared. No step compares all rows with all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions import geo, geometry
from tilewright.functions.expressions import Scope, evaluate, where


def radius_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float, self_join: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Pairs (left_id, right_id, distance) of points (x, y) no farther apart than the radius. self_join: each pair
    once, the smaller identifier first. keep: of ax, ay, bx and by, those to keep too. Cells are two radiuses wide, so that a
    point of the right side is sent to four of them."""
    cell = lambda v: F.floor(v / (2 * radius)).cast("long")
    reach = radius * (1 + 1e-6)  # more than a difference of coordinates is rounded by
    near = lambda v: F.sequence(cell(F.col(v) - reach), cell(F.col(v) + reach))
    a = left.select(F.col(left_id).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell(F.col("x")).alias("i"), cell(F.col("y")).alias("j"))
    b = right.select(F.col(right_id).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(near("x")).alias("i"), near("y").alias("js"))
    b = b.withColumn("j", F.explode("js")).drop("js")
    square = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    met = a.join(b, ["i", "j"]).where(square <= radius * radius)
    met = met.where("a < b") if self_join else met
    return met.select("a", "b", F.sqrt(square).alias("distance"), *keep or [])


def box_join(left: DataFrame, right: DataFrame, cell: float, self_join: bool = False) -> DataFrame:
    """Pairs (a, b) of boxes (id, minx, miny, maxx, maxy) that have a point in common. A pair that shares several cells
    counts in the first of them alone. self_join: each pair once, the smaller identifier first. Both sides are dealt over
    tasks by their cells: a broadcast would leave all pairs to the few tasks that read a small file."""

    def cells(df: DataFrame, name: str) -> DataFrame:
        at = lambda v: F.floor(F.col(v) / cell).cast("long")
        df = df.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("minx", "miny", "maxx", "maxy")], at("minx").alias("i0"), at("maxx").alias("i1"), at("miny").alias("j0"), at("maxy").alias("j1"))
        df = df.withColumn("i", F.explode(F.sequence("i0", "i1"))).withColumn("j", F.explode(F.sequence("j0", "j1")))
        return df.drop("i0", "i1", "j0", "j1")

    a, b = (F.struct(*[F.col(f"{c}_{name}").alias(c) for c in ("minx", "miny", "maxx", "maxy")]) for name in "ab")
    first = (F.col("i") == F.floor(F.greatest("minx_a", "minx_b") / cell)) & (F.col("j") == F.floor(F.greatest("miny_a", "miny_b") / cell))
    met = geo.box_intersects(a, b) & first
    met = (F.col("a") < F.col("b")) & met if self_join else met
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = [cells(df, name).repartition(tasks, "i", "j") for df, name in ((left, "a"), (right, "b"))]
    return dealt[0].join(dealt[1].hint("merge"), ["i", "j"]).where(met).select("a", "b")


def nearest(points: DataFrame, key: str, targets: DataFrame, target_key: str, radius: float) -> DataFrame:
    """For each point the nearest target within the radius: key, target_key, distance."""
    found = radius_join(points, targets, key, target_key, radius)
    best = F.min(F.struct("distance", "b"))
    return found.groupBy(F.col("a").alias(key)).agg(best.alias("n")).select(key, F.col("n.b").alias(target_key), F.col("n.distance").alias("distance"))


def first_of_each(features: DataFrame, layer: str, feature_id: str, order: list[str]) -> DataFrame:
    """One feature for each layer and identifier, the first in order; features without an identifier all stay."""
    w = Window.partitionBy(layer, feature_id).orderBy(*order)
    known = features.where(F.col(feature_id).isNotNull()).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
    return known.unionByName(features.where(F.col(feature_id).isNull()))


def query_source(features: DataFrame, scope: Scope, layer_column: str, layer: str | None = None, filter: object = None) -> DataFrame:  # noqa: A002
    """The features of a source, of one of its layers or all, that pass a filter."""
    kept = features if layer is None else features.where(F.col(layer_column) == layer)
    return kept if filter is None else kept.where(where(filter, scope))


def query_layers(features: DataFrame, scope: Scope, layer_column: str, layers: list[dict], only: list[str] | None = None) -> DataFrame:
    """Each feature with each style layer (id, source-layer, filter) that draws it, in one pass over the features."""
    chosen = [x for x in layers if (only is None or x["id"] in only) and x.get("layout", {}).get("visibility") != "none"]
    hits = [F.when((F.col(layer_column) == x["source-layer"]) & where(x.get("filter"), scope), F.lit(x["id"])) for x in chosen]
    found = F.filter(F.array(*hits), lambda v: v.isNotNull()) if hits else F.array().cast("array<string>")
    return features.withColumn("layer", F.explode(found))


def style_columns(layer: dict, scope: Scope, defaults: dict[str, object]) -> dict[str, Column]:
    """A column for each paint property: the layer's expression, the default where it fails or is undefined."""
    paint = layer.get("layout", {}) | layer.get("paint", {})
    return {k: evaluate(paint[k], scope, F.lit(v)) if k in paint else F.lit(v) for k, v in defaults.items()}


# What a layer draws with where its style says nothing.
PAINT_DEFAULTS = {
    "fill": {"fill-color": "#000", "fill-opacity": 1.0},
    "line": {"line-color": "#000", "line-width": 1.0, "line-opacity": 1.0, "line-cap": "butt", "line-join": "miter"},
    "fill-extrusion": {"fill-extrusion-color": "#000", "fill-extrusion-opacity": 1.0, "fill-extrusion-height": 0.0, "fill-extrusion-base": 0.0},
    "symbol": {"text-field": "", "text-size": 16.0, "text-color": "#000", "icon-image": ""},
    "circle": {"circle-color": "#000", "circle-radius": 4.0, "circle-opacity": 1.0},
}


def line_gradient(expression: object, features: DataFrame, scope_of, key: str, at: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """The colours of a gradient along each feature: key and an array of (progress, color)."""
    each = features.withColumn("progress", F.explode(F.array(*map(F.lit, at))))
    colors = each.select(key, "progress", evaluate(expression, scope_of(each, F.col("progress"))).alias("color")).where("color IS NOT NULL")
    return colors.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("progress", "color"))).alias("stops"))


def hits(kind: Column, x: float, y: float, line: Column, reach: Column | float) -> Column:
    """Whether a feature (1 point, 2 line, 3 polygon) is met at a place: inside it, or within reach of it."""
    px, py, first = F.lit(float(x)), F.lit(float(y)), F.get(line, F.lit(0))
    return (
        F.when(kind == 1, F.hypot(first.x - px, first.y - py) <= reach)
        .when(kind == 2, geometry.distance_to_line(px, py, line) <= reach)
        .otherwise(geometry.in_polygon(px, py, F.array(line)))
    )


def bounds_of(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north"))


def collect(parts: list[DataFrame]) -> DataFrame:
    """The features of several sources together."""
    return reduce(DataFrame.unionByName, parts)


def extruded(features: DataFrame, layer: dict, scope: Scope, scale: Column | float = 1.0) -> DataFrame:
    """features with color, opacity, height and base, those that rise above their base alone."""
    made = style_columns(layer, scope, PAINT_DEFAULTS["fill-extrusion"])
    columns = {k: made[f"fill-extrusion-{k}"] for k in ("color", "opacity")} | {k: made[f"fill-extrusion-{k}"] * scale for k in ("height", "base")}
    return features.withColumns(columns).where(F.col("height") > F.col("base"))


#: What a query's place has around it, in pixels, and the units of a tile where no layer says.
REACH, EXTENT = 8.0, 4096


def local_point(px: Column, py: Column, x: Column, y: Column, tile_size: float = 512.0) -> Column:
    """A point of the view (pixels of the layer) in the units of tile x, y: px, py, the box to look for candidates, and
    the units of a pixel; null outside the tile."""
    scale = EXTENT / tile_size
    lx, ly = px - x * tile_size, py - y * tile_size
    inside = lx.between(0, tile_size) & ly.between(0, tile_size)
    box = geo.box(lx * scale - REACH * scale, ly * scale - REACH * scale, lx * scale + REACH * scale, ly * scale + REACH * scale)
    return F.when(inside, F.struct((lx * scale).alias("px"), (ly * scale).alias("py"), box.alias("box"), F.lit(scale).alias("scale")))


def local_box(x0: Column, y0: Column, x1: Column, y1: Column, x: Column, y: Column, tile_size: float = 512.0) -> Column:
    """A box of the view in the units of tile x, y, with its centre as px, py; null where it doesn't meet the tile."""
    scale = EXTENT / tile_size
    west, east = F.least(x0, x1) - x * tile_size, F.greatest(x0, x1) - x * tile_size
    north, south = F.least(y0, y1) - y * tile_size, F.greatest(y0, y1) - y * tile_size
    meets = (east >= 0) & (south >= 0) & (west <= tile_size) & (north <= tile_size)
    box = geo.box(west * scale, north * scale, east * scale, south * scale)
    return F.when(meets, F.struct(((west + east) / 2 * scale).alias("px"), ((north + south) / 2 * scale).alias("py"), box.alias("box"), F.lit(scale).alias("scale")))


def hit(kind: Column, parts: Column, query: Column, extent: Column, by_box: bool, width: Column | float = 1.0, radius: Column | float = 4.0, tile_size: float = 512.0) -> Column:
    """Whether a feature (1 point, 2 line, 3 polygon; parts of points) is met by a query of local_point or local_box, in
    its layer's own extent. A place meets a polygon that it is in, a line within half its width and 4 pixels, a point
    within its radius and 2 pixels. A box meets what has a point in it, and polygons that its centre is in."""
    own = extent / tile_size
    times = own / query["scale"]
    x, y = query.px * times, query.py * times
    inside = geometry.in_polygon(x, y, parts)
    if by_box:
        b = query.box
        vertex = F.exists(F.flatten(parts), lambda p: p.x.between(b.minx * times, b.maxx * times) & p.y.between(b.miny * times, b.maxy * times))
        return vertex | ((kind == 3) & inside)
    line = F.array_min(F.transform(parts, lambda part: geometry.distance_to_line(x, y, part))) <= (F.lit(width) / 2 + 4) * own
    point = F.exists(F.flatten(parts), lambda p: F.hypot(p.x - x, p.y - y) <= (F.lit(radius) + 2) * own)
    return F.when(kind == 1, point).when(kind == 2, line).when(kind == 3, inside).otherwise(False)


def query_region(
    features: DataFrame, scope_of: Callable[[DataFrame], Scope], layer_column: str, layers: list[dict], point: tuple[float, float] | None = None, box: tuple[float, float, float, float] | None = None,
    only: list[str] | None = None, tile_size: float = 512.0,
) -> DataFrame:
    """Features (z, x, y, extent, kind, parts, box: minx.. in the tile's units, and the columns of layers' filters) of a
    view's tiles, each with each style layer that draws it at a place or in a box (which wins) of the view; without either,
    as query_layers. Candidates are those whose own box meets the query's: comparisons that files can prune by."""
    if point is None and box is None:
        return query_layers(features, scope_of(features), layer_column, layers, only)
    x, y = F.col("x"), F.col("y")
    q = local_box(*map(F.lit, map(float, box)), x, y, tile_size) if box is not None else local_point(F.lit(float(point[0])), F.lit(float(point[1])), x, y, tile_size)
    times = F.col("extent") / EXTENT
    asked = features.withColumn("__q", q)
    b = F.col("__q.box")
    near = asked.where((F.col("box.minx") <= b.maxx * times) & (F.col("box.maxx") >= b.minx * times) & (F.col("box.miny") <= b.maxy * times) & (F.col("box.maxy") >= b.miny * times))
    drawn = query_layers(near, scope_of(near), layer_column, layers, only)
    paint = {x["id"]: x.get("paint", {}) for x in layers}

    def of(name: str, default: float) -> Column:
        value = F.lit(default)
        for layer_id, own in paint.items():
            if isinstance(own.get(name), int | float):
                value = F.when(F.col("layer") == layer_id, float(own[name])).otherwise(value)
        return value

    met = hit(F.col("kind"), F.col("parts"), F.col("__q"), F.col("extent"), box is not None, of("line-width", 1.0), of("circle-radius", 4.0), tile_size)
    return drawn.where(met).drop("__q")
