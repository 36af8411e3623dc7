"""Elevation rasters: decoding, sampling, lookup through a pyramid of tiles, shading and heat."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geo


def rgb_tenths(r: Column, g: Column, b: Column) -> Column:
    """Metres from a base of -10000 in steps of 0.1."""
    return (r * 65536 + g * 256 + b) * F.lit(0.1) - 10000


def rgb_fractions(r: Column, g: Column, b: Column) -> Column:
    """Metres with the blue channel as 256ths, above -32768."""
    return r * 256 + g + b / F.lit(256.0) - 32768


def bilinear(grid: Column, size: int, x: Column, y: Column) -> Column:
    """The height between four samples of a square grid (an array by rows); places outside take the border's."""
    x, y = (geo.clamp(v, F.lit(0.0), F.lit(float(size - 1))) for v in (x, y))
    x0, y0 = F.floor(x), F.floor(y)
    x1, y1 = F.least(x0 + 1, F.lit(size - 1)), F.least(y0 + 1, F.lit(size - 1))
    at = lambda i, j: F.get(grid, (j * size + i).cast("int"))
    top = at(x0, y0) * (1 - (x - x0)) + at(x1, y0) * (x - x0)
    return top * (1 - (y - y0)) + (at(x0, y1) * (1 - (x - x0)) + at(x1, y1) * (x - x0)) * (y - y0)


def query_elevation(points: DataFrame, tiles: DataFrame, size: int, zoom: int) -> DataFrame:
    """points (lng, lat, ...) with `elevation` from the deepest tile (z, x, y, grid) at or above zoom; null without one.
    Only the distinct tiles of the points look for ancestors: one equality join in place of one for each level."""
    lat = geo.clamp(F.col("lat"), F.lit(-85.05112878), F.lit(85.05112878))
    placed = points.withColumns({"__x": geo.tile_x(F.col("lng"), zoom).cast("long"), "__y": geo.tile_y(lat, zoom).cast("long")})
    wanted = placed.select("__x", "__y").distinct().withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(zoom))))
    up = F.pow(F.lit(2.0), zoom - F.col("z"))
    wanted = wanted.withColumns({"x": F.floor(F.col("__x") / up), "y": F.floor(F.col("__y") / up)})
    found = wanted.join(tiles.select("z", "x", "y", "grid"), ["z", "x", "y"]).groupBy("__x", "__y").agg(F.max_by(F.struct("z", "x", "y", "grid"), "z").alias("__tile"))
    side = F.pow(F.lit(2.0), F.col("__tile.z"))
    s = F.sin(F.radians(lat))
    px = ((F.col("lng") + 180) / 360 * side - F.col("__tile.x")) * size
    py = ((0.5 - 0.25 * F.ln((1 + s) / (1 - s)) / F.pi()) * side - F.col("__tile.y")) * size
    height = bilinear(F.col("__tile.grid"), size, px, py)
    return placed.join(found, ["__x", "__y"], "left").withColumn("elevation", height).select(*points.columns, "elevation")


def hillshade(pixels: DataFrame, size: int, azimuth: float = 335, altitude: float = 45, exaggeration: float = 0.5) -> DataFrame:
    """pixels (tile, px, py, height) with `light`, the share of the light from 0 to 1. Each pixel hands its height to its
    four neighbours (the border to itself) and one aggregate puts them together, so no tile is a task of its own. A pixel
    with a missing neighbour has no light."""
    az, al = math.radians(azimuth), math.radians(altitude)
    side = lambda of, dx, dy: F.struct(F.lit(of).alias("of"), geo.clamp(F.col("px") + dx, F.lit(0), F.lit(size - 1)).alias("x"), geo.clamp(F.col("py") + dy, F.lit(0), F.lit(size - 1)).alias("y"))
    border = lambda of, hit: F.when(hit, F.struct(F.lit(of).alias("of"), F.col("px").alias("x"), F.col("py").alias("y")))
    own = F.struct(F.lit("own").alias("of"), F.col("px").alias("x"), F.col("py").alias("y"))
    inner = [F.when(cond, side(of, dx, dy)) for of, dx, dy, cond in (("w", 1, 0, F.col("px") < size - 1), ("e", -1, 0, F.col("px") > 0), ("n", 0, 1, F.col("py") < size - 1), ("s", 0, -1, F.col("py") > 0))]
    edges = [border("w", F.col("px") == 0), border("e", F.col("px") == size - 1), border("n", F.col("py") == 0), border("s", F.col("py") == size - 1)]
    dealt = pixels.select("tile", "height", F.explode(F.array_compact(F.array(own, *inner, *edges))).alias("to"))
    of = lambda name: F.max(F.when(F.col("to.of") == name, F.col("height"))).alias(name)
    around = dealt.groupBy("tile", F.col("to.x").alias("px"), F.col("to.y").alias("py")).agg(*[of(k) for k in ("own", "w", "e", "n", "s")]).where("own IS NOT NULL")
    dx, dy = (F.col("e") - F.col("w")) * 0.5 * exaggeration, (F.col("s") - F.col("n")) * 0.5 * exaggeration
    lit = (-dx * (math.sin(az) * math.cos(al)) + dy * (math.cos(az) * math.cos(al)) + math.sin(al)) / F.sqrt(dx * dx + dy * dy + 1)
    return around.select("tile", "px", "py", F.col("own").alias("height"), F.when(lit.isNotNull(), F.greatest(F.lit(0.0), lit)).alias("light"))


def heat(points: DataFrame, radius: int, least: float = 0.05) -> DataFrame:
    """points (px, py, weight) -> px, py, density: each splat fades to its radius; overlapping splats cover what is left
    of the light, 1 - product(1 - alpha). Weights are clamped to least..1."""
    w = geo.clamp(F.col("weight"), F.lit(float(least)), F.lit(1.0))
    span = F.sequence(F.lit(-radius), F.lit(radius))
    spread = points.select("px", "py", w.alias("w"), F.explode(span).alias("dx")).withColumn("dy", F.explode(span))
    d = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))
    alpha = F.col("w") * (1 - d / radius)
    each = spread.where(d < radius).select((F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py"), alpha.alias("alpha"))
    full = F.max(F.when(F.col("alpha") >= 1, 1).otherwise(0)) == 1
    return each.groupBy("px", "py").agg(F.when(full, 1.0).otherwise(1 - F.exp(F.sum(F.ln(F.when(F.col("alpha") < 1, 1 - F.col("alpha")))))).alias("density"))


def decode_grid(pixels: Column, encoding: str = "tenths") -> Column:
    """The heights of a picture's pixels (bytes red, green, blue, alpha of each) by rows. encoding: tenths or fractions."""
    if encoding not in ("tenths", "fractions"):
        raise ValueError(f"no encoding {encoding}")

    @F.pandas_udf("array<double>")
    def decoded(pixels: pd.Series) -> pd.Series:
        def heights(raw: bytes | None) -> np.ndarray | None:
            if raw is None:
                return None
            r, g, b = np.frombuffer(raw, np.uint8)[: len(raw) // 4 * 4].reshape(-1, 4)[:, :3].astype(float).T
            return (r * 65536 + g * 256 + b) * 0.1 - 10000 if encoding == "tenths" else r * 256 + g + b / 256 - 32768

        return pixels.map(heights)

    return decoded(pixels)


def mesh_vertices(tiles: DataFrame, size: int, tile_size: float | None = None, resolution: int = 32, exaggeration: float = 1.0, units: float = 1.0) -> DataFrame:
    """tiles (..., grid) -> one row per vertex of a mesh of resolution * resolution cells: vertex (by rows), x, y, z and the
    normal nx, ny, nz from the heights on both sides (of one side at the border)."""
    if size < 2 or resolution < 1:
        raise ValueError("a mesh needs two samples a side and one cell")
    side, step, dem = resolution + 1, (tile_size or size) / resolution, (size - 1) / resolution
    rows = tiles.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(resolution)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(resolution))))
    height = lambda i, j: bilinear(F.col("grid"), size, i * dem, j * dem) * (exaggeration * units)
    i, j = F.col("i"), F.col("j")
    low, high = lambda v: F.greatest(v - 1, F.lit(0)), lambda v: F.least(v + 1, F.lit(resolution))
    nx = -(height(high(i), j) - height(low(i), j)) / ((high(i) - low(i)) * step)
    ny = -(height(i, high(j)) - height(i, low(j))) / ((high(j) - low(j)) * step)
    made = rows.select(*[c for c in tiles.columns if c != "grid"], (j * side + i).alias("vertex"), (i * step).alias("x"), (j * step).alias("y"), height(i, j).alias("z"), nx.alias("__nx"), ny.alias("__ny"))
    size_of = F.sqrt(F.col("__nx") * F.col("__nx") + F.col("__ny") * F.col("__ny") + 1)
    return made.withColumns({"nx": F.col("__nx") / size_of, "ny": F.col("__ny") / size_of, "nz": 1 / size_of}).drop("__nx", "__ny")


def triangle_corners(triangle: Column, resolution: int) -> Column:
    """The vertices a, b and c of a triangle of a mesh; each cell has two, one after the other."""
    cell = F.floor(triangle / 2)
    a = F.floor(cell / resolution) * (resolution + 1) + F.pmod(cell, F.lit(resolution))
    even = triangle % 2 == 0
    corner = lambda first, second: F.when(even, first).otherwise(second).cast("long")
    below = a + resolution + 1
    return F.struct(corner(a, a + 1).alias("a"), below.cast("long").alias("b"), corner(a + 1, below + 1).alias("c"))


def mesh_triangles(spark: SparkSession, resolution: int) -> DataFrame:
    """triangle, a, b, c: two triangles for each cell of a mesh, the same for every tile."""
    return spark.range(2 * resolution * resolution).select(F.col("id").alias("triangle"), triangle_corners(F.col("id"), resolution).alias("t")).select("triangle", "t.*")


# The stops of the usual ramp of a heat map.
HEAT_STOPS = ((0.4, (0, 0, 255)), (0.6, (0, 255, 255)), (0.7, (0, 255, 0)), (0.8, (255, 255, 0)), (1.0, (255, 0, 0)))


def heat_color(density: Column, stops: tuple = HEAT_STOPS) -> Column:
    """r, g, b and a of a density: one of 256 steps of a ramp between the stops; the density is the alpha."""
    step = F.floor(geo.clamp(density, F.lit(0.0), F.lit(1.0)) * 255 + 0.5)
    at = step / 255.0

    def channel(k: int) -> Column:
        value = F.lit(float(stops[-1][1][k]))
        for (low, a), (high, b) in reversed([*zip(stops, stops[1:], strict=False)]):
            value = F.when(at < high, a[k] + (b[k] - a[k]) * (at - low) / (high - low)).otherwise(value)
        return F.floor(F.when(at <= stops[0][0], float(stops[0][1][k])).otherwise(value) + 0.5).cast("int")

    return F.struct(*[channel(k).alias(c) for k, c in enumerate("rgb")], step.cast("int").alias("a"))


def shaded(light: Column, accent: tuple[int, int, int] = (255, 255, 255), shadow: tuple[int, int, int] = (0, 0, 0), opacity: float = 1.0) -> Column:
    """r, g, b and a of a light: the accent's colour where it is 1, the shadow's where it is 0."""
    mixed = [F.round(light * a + (1 - light) * s).cast("int").alias(c) for c, a, s in zip("rgb", accent, shadow, strict=True)]
    return F.struct(*mixed, F.lit(int(255 * opacity + 0.5)).alias("a"))
