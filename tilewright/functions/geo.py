"""Projections, geodesy, boxes and the tile pyramid as columns.

Boxes are structs of west, south, east, north; planar boxes of minx, miny, maxx, maxy; points structs of x and y.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The radii and limits of the projections.
EARTH_RADIUS = 6371000.0
MERCATOR_RADIUS = 6378137.0
MERCATOR_MINOR = 6356752.314245179
MAX_LATITUDE = 85.0511287798
EQUATOR = 40075017.0
TILE = 256

HALF_PI, RAD = math.pi / 2, math.pi / 180


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


# projections


def spherical_mercator(lat: Column, lng: Column) -> tuple[Column, Column]:
    s = F.sin(clamp(lat, -MAX_LATITUDE, MAX_LATITUDE) * RAD)
    return lng * (MERCATOR_RADIUS * RAD), F.ln((1 + s) / (1 - s)) * (MERCATOR_RADIUS / 2)


def from_spherical_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """lat, lng."""
    return (F.atan(F.exp(y / MERCATOR_RADIUS)) * 2 - HALF_PI) / RAD, x / (MERCATOR_RADIUS * RAD)


ECCENTRICITY = math.sqrt(1 - (MERCATOR_MINOR / MERCATOR_RADIUS) ** 2)


def elliptical_mercator(lat: Column, lng: Column) -> tuple[Column, Column]:
    phi = lat * RAD
    con = F.sin(phi) * ECCENTRICITY
    ts = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - con) / (1 + con), F.lit(ECCENTRICITY / 2))
    return lng * (RAD * MERCATOR_RADIUS), -F.ln(F.greatest(ts, F.lit(1e-10))) * MERCATOR_RADIUS


def from_elliptical_mercator(x: Column, y: Column, rounds: int = 8) -> tuple[Column, Column]:
    """lat, lng: by fixed-point rounds, each of which gains about two digits."""
    ts = F.exp(-y / MERCATOR_RADIUS)

    def closer(phi: Column, _: Column) -> Column:
        con = F.sin(phi) * ECCENTRICITY
        return HALF_PI - F.atan(ts * F.pow((1 - con) / (1 + con), F.lit(ECCENTRICITY / 2))) * 2

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), HALF_PI - F.atan(ts) * 2, closer)
    return phi / RAD, x / (MERCATOR_RADIUS * RAD)


@dataclass(frozen=True)
class Crs:
    """A projection and the transformation of its plane into pixels at zoom 0: scale * (a * x + b), scale * (c * y + d)."""

    name: str
    a: float
    b: float
    c: float
    d: float
    size: float = TILE

    def project(self, lat: Column, lng: Column) -> tuple[Column, Column]:
        if self.name in ("EPSG:3857", "EPSG:900913"):
            return spherical_mercator(lat, lng)
        return elliptical_mercator(lat, lng) if self.name == "EPSG:3395" else (lng, lat)

    def unproject(self, x: Column, y: Column) -> tuple[Column, Column]:
        if self.name in ("EPSG:3857", "EPSG:900913"):
            return from_spherical_mercator(x, y)
        return from_elliptical_mercator(x, y) if self.name == "EPSG:3395" else (y, x)

    def scale(self, zoom: Column | float) -> Column:
        return F.pow(F.lit(2.0), F.lit(zoom)) * self.size

    def to_pixel(self, lat: Column, lng: Column, zoom: Column | float) -> tuple[Column, Column]:
        x, y = self.project(lat, lng)
        return self.scale(zoom) * (x * self.a + self.b), self.scale(zoom) * (y * self.c + self.d)

    def from_pixel(self, x: Column, y: Column, zoom: Column | float) -> tuple[Column, Column]:
        return self.unproject((x / self.scale(zoom) - self.b) / self.a, (y / self.scale(zoom) - self.d) / self.c)


_MERCATOR = 0.5 / (math.pi * MERCATOR_RADIUS)
EPSG3857 = Crs("EPSG:3857", _MERCATOR, 0.5, -_MERCATOR, 0.5)
EPSG900913 = Crs("EPSG:900913", _MERCATOR, 0.5, -_MERCATOR, 0.5)
EPSG3395 = Crs("EPSG:3395", _MERCATOR, 0.5, -_MERCATOR, 0.5)
EPSG4326 = Crs("EPSG:4326", 1 / 180, 1.0, -1 / 180, 0.5)
SIMPLE = Crs("Simple", 1.0, 0.0, -1.0, 0.0, 1.0)


def to_sphere(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    """A point of the unit sphere: x to the right at longitude 90, y to the north, z to longitude 0."""
    flat = F.cos(lat * RAD)
    return flat * F.sin(lng * RAD), F.sin(lat * RAD), flat * F.cos(lng * RAD)


def from_sphere(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.asin(clamp(y, -1.0, 1.0)) / RAD, F.atan2(x, z) / RAD


def globe_share(zoom: Column, low: float = 5.5, high: float = 6.0) -> Column:
    """1 on the globe, 0 on the map, smoothly between."""
    t = clamp((zoom - low) / (high - low), 0.0, 1.0)
    return 1 - t * t * (3 - 2 * t)


# geodesy


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres along a great circle."""
    a = F.pow(F.sin((lat2 - lat1) * (RAD / 2)), F.lit(2)) + F.cos(lat1 * RAD) * F.cos(lat2 * RAD) * F.pow(F.sin((lng2 - lng1) * (RAD / 2)), F.lit(2))
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * EARTH_RADIUS)


def wrap(x: Column, low: float = -180.0, high: float = 180.0) -> Column:
    """Into [low, high): high itself stays."""
    return F.when(x == high, x).otherwise(F.pmod(x - low, F.lit(high - low)) + low)


def square_around(lat: Column, lng: Column, metres: Column | float) -> Column:
    """The box of a square of so many metres."""
    half = F.lit(metres) * 180 / EQUATOR
    across = half / F.cos(lat * RAD)
    return F.struct((lng - across).alias("west"), (lat - half).alias("south"), (lng + across).alias("east"), (lat + half).alias("north"))


def rounded(x: Column, places: int = 6) -> Column:
    """Half of the last place goes up."""
    return F.floor(x * 10.0**places + 0.5) / 10.0**places


# boxes: closed on every edge


def box_intersects(a: Column, b: Column) -> Column:
    return (b.minx <= a.maxx) & (b.maxx >= a.minx) & (b.miny <= a.maxy) & (b.maxy >= a.miny)


def box_overlaps(a: Column, b: Column) -> Column:
    """More than an edge in common."""
    return (b.minx < a.maxx) & (b.maxx > a.minx) & (b.miny < a.maxy) & (b.maxy > a.miny)


def box_contains(a: Column, b: Column) -> Column:
    return (b.minx >= a.minx) & (b.maxx <= a.maxx) & (b.miny >= a.miny) & (b.maxy <= a.maxy)


def box_holds(a: Column, x: Column, y: Column) -> Column:
    return (x >= a.minx) & (x <= a.maxx) & (y >= a.miny) & (y <= a.maxy)


def box(minx: object, miny: object, maxx: object, maxy: object) -> Column:
    return F.struct(*[F.lit(x).cast("double").alias(k) for k, x in (("minx", minx), ("miny", miny), ("maxx", maxx), ("maxy", maxy))])


def box_area(a: Column) -> Column:
    return (a.maxx - a.minx) * (a.maxy - a.miny)


def box_common_area(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a.maxx, b.maxx) - F.greatest(a.minx, b.minx)) * F.greatest(zero, F.least(a.maxy, b.maxy) - F.greatest(a.miny, b.miny))


def box_padded(a: Column, share: float) -> Column:
    dx, dy = F.abs(a.maxx - a.minx) * share, F.abs(a.maxy - a.miny) * share
    return box(a.minx - dx, a.miny - dy, a.maxx + dx, a.maxy + dy)


def box_text(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.concat_ws(",", west, south, east, north)


# tiles


def tile_x(lng: Column, zoom: Column | int) -> Column:
    return F.floor((lng + 180) / 360 * F.pow(F.lit(2.0), F.lit(zoom))).cast("int")


def tile_y(lat: Column, zoom: Column | int) -> Column:
    r = lat * RAD
    return F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * F.pow(F.lit(2.0), F.lit(zoom))).cast("int")


def clamp_tile(t: Column, zoom: Column | int) -> Column:
    return clamp(t, 0, (F.pow(F.lit(2.0), F.lit(zoom)) - 1).cast("int"))


def tile_west(x: Column, zoom: Column | int) -> Column:
    return x / F.pow(F.lit(2.0), F.lit(zoom)) * 360 - 180


def tile_north(y: Column, zoom: Column | int) -> Column:
    return F.atan(F.sinh((1 - y * 2 / F.pow(F.lit(2.0), F.lit(zoom))) * math.pi)) / RAD


def tile_cover(boxes: DataFrame, low: int, high: int) -> DataFrame:
    """All tiles z, x, y over each row's west, south, east, north, for each zoom: rows are made by sequences alone."""
    z = F.col("z")
    west, east = F.least("west", "east"), F.greatest("west", "east")
    south, north = F.least("south", "north"), F.greatest("south", "north")
    at = lambda tile, v: clamp_tile(tile(clamp(v, -MAX_LATITUDE, MAX_LATITUDE) if tile is tile_y else v, z), z)
    zooms = boxes.withColumn("z", F.explode(F.sequence(F.lit(low), F.lit(high))))
    across = zooms.withColumn("x", F.explode(F.sequence(at(tile_x, west), at(tile_x, east))))
    return across.withColumn("y", F.explode(F.sequence(at(tile_y, north), at(tile_y, south))))


def ancestors(tiles: DataFrame, most: int, first: int = 0) -> DataFrame:
    """Each tile's ancestors up to `most` levels above (up = 0: itself)."""
    up = F.col("up")
    each = tiles.withColumn("up", F.explode(F.sequence(F.lit(first), F.least(F.lit(most), F.col("z")))))
    return each.withColumns({"az": F.col("z") - up, "ax": F.call_function("shiftright", F.col("x"), up), "ay": F.call_function("shiftright", F.col("y"), up)})


def children(tiles: DataFrame, down: int = 1) -> DataFrame:
    n = 1 << down
    return tiles.withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("z", "x", "y", (F.col("z") + down).alias("cz"), (F.col("x") * n + F.col("dx")).alias("cx"), (F.col("y") * n + F.col("dy")).alias("cy"))


def tile_url(template: str, z: Column, x: Column, y: Column, subdomains: str = "abc", tms: bool = False, ratio: str = "") -> Column:
    """The template's {z} {x} {y} {-y} {s} {r} filled in; any other key is an error."""
    import re

    flipped = F.call_function("shiftleft", F.lit(1), z) - 1 - y
    values = {"z": z, "x": x, "y": flipped if tms else y, "-y": flipped, "s": F.element_at(F.array(*map(F.lit, subdomains)), F.pmod(F.abs(x + y), F.lit(len(subdomains))) + 1), "r": F.lit(ratio)}
    parts = re.split(r"\{ *([\w-]+) *\}", template)
    if unknown := {k for k in parts[1::2] if k not in values}:
        raise ValueError(f"no value for {sorted(unknown)}")
    return F.concat(*[values[p].cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def wms_box(west: Column, south: Column, east: Column, north: Column, crs: str, version: float) -> Column:
    """The BBOX of a map request: from version 1.3 on, latitude comes first for EPSG:4326."""
    return F.concat_ws(",", *([south, west, north, east] if version >= 1.3 and crs == "EPSG:4326" else [west, south, east, north]))


def bounds_zoom(width: Column, height: Column, view_width: float, view_height: float, zoom: float, low: float, high: float, snap: float = 1.0) -> Column:
    """The greatest zoom at which a box of that many pixels at `zoom` fits the view."""
    scale = F.least(view_width / width, view_height / height)
    at = F.log2(scale) + zoom
    at = F.floor((at + 1e-9) / snap) * snap if snap else at
    return clamp(at, low, high)


# boxes as values: planar ones, and through planar() those of west, south, east, north


def planar(b: Column) -> Column:
    """A box of west, south, east, north with the planar names."""
    return box(b.west, b.south, b.east, b.north)


def geographic(b: Column) -> Column:
    return F.struct(b.minx.alias("west"), b.miny.alias("south"), b.maxx.alias("east"), b.maxy.alias("north"))


def box_margin(a: Column) -> Column:
    return (a.maxx - a.minx) + (a.maxy - a.miny)


def box_union(a: Column, b: Column) -> Column:
    """The smallest box around two; one that is null adds nothing."""
    each = [(F.least, "minx"), (F.least, "miny"), (F.greatest, "maxx"), (F.greatest, "maxy")]
    return F.when(a.isNotNull() | b.isNotNull(), F.struct(*[pick(a[k], b[k]).alias(k) for pick, k in each]))


def box_enlarged_area(a: Column, b: Column) -> Column:
    return box_area(box_union(a, b))


def box_centre(a: Column) -> Column:
    return F.struct(((a.minx + a.maxx) / 2).alias("x"), ((a.miny + a.maxy) / 2).alias("y"))


def box_size(a: Column) -> Column:
    return F.struct((a.maxx - a.minx).alias("x"), (a.maxy - a.miny).alias("y"))


def box_corners(a: Column) -> Column:
    """Top left, top right, bottom left and bottom right, y downwards."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(at(a.minx, a.miny), at(a.maxx, a.miny), at(a.minx, a.maxy), at(a.maxx, a.maxy))


def box_equals(a: Column, b: Column, margin: float = 0.0) -> Column:
    """Whether no side is farther apart than the margin (1e-9 is usual for degrees)."""
    return F.greatest(*[F.abs(a[k] - b[k]) for k in ("minx", "miny", "maxx", "maxy")]) <= margin


def box_valid(a: Column) -> Column:
    return a.isNotNull() & a.minx.isNotNull() & a.miny.isNotNull() & a.maxx.isNotNull() & a.maxy.isNotNull()


def box_ring(a: Column) -> Column:
    """South-west, north-west, north-east and south-east corners, y upwards."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(at(a.minx, a.miny), at(a.minx, a.maxy), at(a.maxx, a.maxy), at(a.maxx, a.miny))


def latlng_equals(lat1: Column, lng1: Column, lat2: Column, lng2: Column, margin: float = 1e-9) -> Column:
    return F.greatest(F.abs(lat1 - lat2), F.abs(lng1 - lng2)) <= margin


def bounds_shifted(b: Column) -> Column:
    """A box of west, south, east, north moved by whole turns, so that its centre's longitude is in [-180, 180)."""
    centre = (b.west + b.east) / 2
    shift = wrap(centre) - centre
    return F.struct((b.west + shift).alias("west"), b.south.alias("south"), (b.east + shift).alias("east"), b.north.alias("north"))


# points as values


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def point_add(a: Column, b: Column) -> Column:
    return _xy(a.x + b.x, a.y + b.y)


def point_subtract(a: Column, b: Column) -> Column:
    return _xy(a.x - b.x, a.y - b.y)


def point_times(a: Column, n: Column | float) -> Column:
    return _xy(a.x * n, a.y * n)


def point_over(a: Column, n: Column | float) -> Column:
    return _xy(a.x / n, a.y / n)


def point_scaled(a: Column, b: Column) -> Column:
    """Each coordinate times its own factor."""
    return _xy(a.x * b.x, a.y * b.y)


def point_unscaled(a: Column, b: Column) -> Column:
    return _xy(a.x / b.x, a.y / b.y)


def point_rounded(a: Column) -> Column:
    """To whole numbers, halves upwards."""
    return _xy(F.floor(a.x + 0.5), F.floor(a.y + 0.5))


def point_floor(a: Column) -> Column:
    return _xy(F.floor(a.x), F.floor(a.y))


def point_ceil(a: Column) -> Column:
    return _xy(F.ceil(a.x), F.ceil(a.y))


def point_cut(a: Column) -> Column:
    """Without the places after the point."""
    return _xy(*[F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)) for v in (a.x, a.y)])


def point_distance(a: Column, b: Column) -> Column:
    return F.hypot(b.x - a.x, b.y - a.y)


def point_equals(a: Column, b: Column) -> Column:
    return (a.x == b.x) & (a.y == b.y)


def point_covers(a: Column, b: Column) -> Column:
    """Whether b is no farther from the origin on either axis."""
    return (F.abs(b.x) <= F.abs(a.x)) & (F.abs(b.y) <= F.abs(a.y))


# tiles in view


def tile_range(minx: Column, miny: Column, maxx: Column, maxy: Column, size: int = TILE) -> Column:
    """The first and last tiles that a box of pixels meets."""
    first = lambda v: F.floor(v / size).cast("int")
    last = lambda v: (F.ceil(v / size) - 1).cast("int")
    return F.struct(first(minx).alias("x0"), first(miny).alias("y0"), last(maxx).alias("x1"), last(maxy).alias("y1"))


def visible_tiles(views: DataFrame) -> DataFrame:
    """views with x0, y0, x1, y1 -> one row per tile x, y with its distance from the centre of the range; order by it
    (then y, x) to load the centre first."""
    rows = views.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1")))
    return rows.withColumn("from_centre", F.hypot(F.col("x") - (F.col("x0") + F.col("x1")) / 2, F.col("y") - (F.col("y0") + F.col("y1")) / 2))


def tile_bounds(x: Column, y: Column, z: Column | int) -> Column:
    """west, south, east, north of a tile."""
    return F.struct(tile_west(x, z).alias("west"), tile_north(y + 1, z).alias("south"), tile_west(x + 1, z).alias("east"), tile_north(y, z).alias("north"))


def tile_key(x: Column, y: Column, z: Column | int) -> Column:
    return F.concat_ws(":", x, y, F.lit(z))


def key_tile(key: Column) -> Column:
    parts = F.split(key, ":")
    return F.struct(*[parts[k].cast("int").alias(c) for k, c in enumerate("xyz")])


def wrap_tile(v: Column, z: Column | int) -> Column:
    """A column or row of tiles beyond the world is that of another turn."""
    return F.pmod(v, F.pow(F.lit(2.0), F.lit(z)).cast("int"))


def is_valid_tile(x: Column, y: Column, z: Column | int, wraps_x: bool = True, wraps_y: bool = False, within: Column | None = None) -> Column:
    """Whether a tile is of the world (on the axes that don't wrap) and, with `within`, has more than an edge in common
    with that box of west, south, east, north."""
    n = F.pow(F.lit(2.0), F.lit(z))
    good = F.lit(True)
    for v, wraps in ((x, wraps_x), (y, wraps_y)):
        good = good if wraps else good & (v >= 0) & (v < n)
    return good if within is None else good & box_overlaps(planar(within), planar(tile_bounds(wrap_tile(x, z) if wraps_x else x, y, z)))


def native_zoom(z: Column, low: int | None = None, high: int | None = None) -> Column:
    """The zoom whose tiles stand in for those of z."""
    z = z if low is None else F.greatest(z, F.lit(low))
    return z if high is None else F.least(z, F.lit(high))


def retained(wanted: DataFrame, loaded: DataFrame, up: int = 5, down: int = 2) -> DataFrame:
    """The loaded tiles (z, x, y, active, loaded) that stand in for wanted tiles (z, x, y) that aren't there yet: ancestors
    up to the nearest active one; where none is active, descendants, none below an active one."""
    have = loaded.where("active OR loaded").select("z", "x", "y", "active")
    of = lambda c: have.select(*[F.col(k).alias(f"{c}{k}") for k in ("z", "x", "y")], "active")
    above = ancestors(wanted.select("z", "x", "y").distinct(), up, 1).join(of("a"), ["az", "ax", "ay"])
    nearest = above.groupBy("z", "x", "y").agg(F.min(F.when(F.col("active"), F.col("up"))).alias("nearest"))
    kept = above.join(nearest, ["z", "x", "y"]).where(F.col("nearest").isNull() | (F.col("up") <= F.col("nearest")))
    out = kept.select(F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    alone = wanted.select("z", "x", "y").distinct().join(nearest.where("nearest IS NOT NULL"), ["z", "x", "y"], "left_anti")
    step = alone
    for _ in range(down):
        below = children(step).select(F.col("cz").alias("z"), F.col("cx").alias("x"), F.col("cy").alias("y"))
        met = below.join(have, ["z", "x", "y"], "left")
        out = out.union(met.where("active IS NOT NULL").select("z", "x", "y"))
        step = met.where("active IS NULL OR NOT active").select("z", "x", "y")
    return out.distinct()
