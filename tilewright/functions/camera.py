"""The view's geometry as columns: turning, tilting, flights, limits, easing and scales. Points are structs of x and y."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions import geo

# The field of view, how much a flight zooms out, and the overshoot of ease-out-back.
FIELD_OF_VIEW = 36.87
FLIGHT_CURVE = 1.42
OVERSHOOT = 1.70158


def rotated(p: Column, degrees: Column, origin: Column) -> Column:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    dx, dy = p.x - origin.x, p.y - origin.y
    return F.struct((origin.x + dx * c - dy * s).alias("x"), (origin.y + dx * s + dy * c).alias("y"))


def _tilt(pitch: Column, height: float) -> tuple[Column, Column, float]:
    return F.sin(F.radians(pitch)), F.cos(F.radians(pitch)), height / 2 / math.tan(math.radians(FIELD_OF_VIEW) / 2)


def pitched(p: Column, pitch: Column, height: float) -> Column:
    """Where a point of the ground plane, from the view's centre, is seen under a tilt; on the horizon it stays."""
    s, c, h = _tilt(pitch, height)
    depth = h - p.y * s
    seen = F.struct((p.x * h / depth).alias("x"), (p.y * h * c / depth).alias("y"))
    return F.when((pitch == 0) | (F.abs(depth) < 1e-6), F.struct(p.x.alias("x"), p.y.alias("y"))).otherwise(seen)


def unpitched(p: Column, pitch: Column, height: float) -> Column:
    """The point of the ground plane that is seen at p."""
    s, c, h = _tilt(pitch, height)
    depth = c * h + p.y * s
    ground = F.struct((p.x * h * c / depth).alias("x"), (p.y * h / depth).alias("y"))
    return F.when((pitch == 0) | (F.abs(depth) < 1e-6), F.struct(p.x.alias("x"), p.y.alias("y"))).otherwise(ground)


def bearing_between(start: Column, end: Column, t: Column) -> Column:
    """On the shorter way around, from 0 to 360."""
    return F.pmod(start + (F.pmod(end - start + 540, F.lit(360.0)) - 180) * t, F.lit(360.0))


def rebound(left: Column, right: Column) -> Column:
    """How far to move so that neither side is over its limit; the middle where both can't be helped."""
    zero = F.lit(0)
    return F.when(left + right > 0, F.floor(left - right + 0.5) / 2).otherwise((F.greatest(zero, F.ceil(left)) - F.greatest(zero, F.floor(right))).cast("double"))


def limited_centre(centre: Column, width: float, height: float, limits: Column) -> Column:
    """The centre, in pixels, of the view nearest to `centre` that doesn't leave the box `limits`; moves of one pixel are
    not made."""
    dx = rebound(limits.minx - (centre.x - width / 2), -(limits.maxx - (centre.x + width / 2)))
    dy = rebound(limits.miny - (centre.y - height / 2), -(limits.maxy - (centre.y + height / 2)))
    near = (F.abs(dx) <= 1) & (F.abs(dy) <= 1)
    return F.struct(F.when(near, centre.x).otherwise(centre.x + dx).alias("x"), F.when(near, centre.y).otherwise(centre.y + dy).alias("y"))


def flight(width0: Column, width1: Column, distance: Column, share: Column) -> Column:
    """A flight between views of two widths: the whole length S of the path in its own measure, and after `share` of it
    the view's width w and the distance u from the start, all in pixels of the start."""
    curve2 = FLIGHT_CURVE**2
    far = F.when(distance == 0, 1.0).otherwise(distance)

    def at(end: bool) -> Column:
        own = width1 if end else width0
        b = (width1 * width1 - width0 * width0 + (-1 if end else 1) * curve2 * curve2 * far * far) / (own * (2 * curve2) * far)
        root = F.sqrt(b * b + 1) - b
        return F.when(root < 1.5e-8, -18.0).otherwise(F.ln(root))

    r0 = at(False)
    length = (at(True) - r0) / FLIGHT_CURVE
    here = r0 + length * share * FLIGHT_CURVE
    return F.struct(length.alias("S"), (width0 * F.cosh(r0) / F.cosh(here)).alias("w"), (width0 * (F.cosh(r0) * F.tanh(here) - F.sinh(r0)) / curve2).alias("u"))


def eased(name: str, t: Column) -> Column:
    """linear, outBack, or in, out or inOut with Quad, Cubic or Quart; t from 0 to 1."""
    if name == "linear":
        return t
    if name == "outBack":
        back = t - 1
        return 1 + back * back * back * (OVERSHOOT + 1) + back * back * OVERSHOOT
    powers = {"Quad": 2, "Cubic": 3, "Quart": 4}
    kind = next((k for k in powers if name.endswith(k)), None)
    if kind is None or name.removesuffix(kind) not in ("in", "out", "inOut"):
        raise ValueError(f"no easing {name}")
    n, side = powers[kind], name.removesuffix(kind)
    if side == "in":
        return F.pow(t, F.lit(n))
    if side == "out":
        return 1 - F.pow(1 - t, F.lit(n))
    return F.when(t < 0.5, F.pow(t, F.lit(n)) * 2 ** (n - 1)).otherwise(1 - F.pow(t * -2 + 2, F.lit(n)) / 2)


def cubic_bezier(x1: float, y1: float, x2: float, y2: float, t: Column, rounds: int = 10) -> Column:
    """The height of the curve from (0, 0) to (1, 1) where its x is t, by Newton's steps."""
    across = lambda s, a, b: ((s * (3 * a - 3 * b + 1) + (3 * b - 6 * a)) * s + 3 * a) * s
    steep = lambda s: (s * (3 * (3 * x1 - 3 * x2 + 1)) + 2 * (3 * x2 - 6 * x1)) * s + 3 * x1

    def closer(s: Column, _: Column) -> Column:
        off = across(s, x1, x2) - t
        return F.when((F.abs(off) < 1e-5) | (F.abs(steep(s)) < 1e-6), s).otherwise(s - off / steep(s))

    found = across(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), t.cast("double"), closer), y1, y2)
    return F.when(t <= 0, 0.0).when(t >= 1, 1.0).otherwise(found)


def round_number(x: Column) -> Column:
    """The greatest of 1, 2, 3, 5 and 10 times a power of ten that is not above x (of at least 1)."""
    power = F.pow(F.lit(10.0), F.length(F.floor(x).cast("string")) - 1)
    d = x / power
    return power * F.when(d >= 10, 10).when(d >= 5, 5).when(d >= 3, 3).when(d >= 2, 2).otherwise(1)


def _text(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def metric_scale(metres: Column, width: float = 100.0) -> Column:
    """The label of a scale bar for a view whose `width` pixels are so many metres, and the bar's width."""
    n = round_number(metres)
    label = F.when(n < 1000, F.concat(_text(n), F.lit(" m"))).otherwise(F.concat(_text(n / 1000), F.lit(" km")))
    return F.struct(label.alias("label"), F.floor(n / metres * width + 0.5).cast("int").alias("pixels"))


def imperial_scale(metres: Column, width: float = 100.0) -> Column:
    feet = metres * 3.2808399
    far = feet > 5280
    whole = F.when(far, feet / 5280).otherwise(feet)
    n = round_number(whole)
    return F.struct(F.concat(_text(n), F.when(far, " mi").otherwise(" ft")).alias("label"), F.floor(n / whole * width + 0.5).cast("int").alias("pixels"))


def circle_pixels(lat: Column, lng: Column, metres: Column, zoom: float) -> Column:
    """The ellipse that a circle of so many metres is on the map: its centre x, y and half axes rx, ry in pixels."""
    to_pixel = lambda a, b: geo.EPSG3857.to_pixel(a, b, zoom)
    high = metres / geo.EARTH_RADIUS / geo.RAD
    x, top = to_pixel(lat + high, lng)
    _, bottom = to_pixel(lat - high, lng)
    y = (top + bottom) / 2
    lat2, _ = geo.EPSG3857.from_pixel(x, y, zoom)
    inner = (F.cos(high * geo.RAD) - F.sin(lat * geo.RAD) * F.sin(lat2 * geo.RAD)) / (F.cos(lat * geo.RAD) * F.cos(lat2 * geo.RAD))
    wide = F.acos(inner) / geo.RAD
    wide = F.when(F.isnan(wide) | wide.isNull() | (wide == 0), high / F.cos(lat * geo.RAD)).otherwise(wide)
    left, _ = to_pixel(lat2, lng - wide)
    return F.struct(x.alias("x"), y.alias("y"), (x - left).alias("rx"), (y - top).alias("ry"))
