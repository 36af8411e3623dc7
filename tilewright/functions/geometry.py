"""Planar geometry over arrays of points (structs of x and y) and of rings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def point(x: object, y: object) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), whose value is computed once however often `of` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def edges(line: Column) -> Column:
    """Neighbouring points of a line as structs of a and b."""
    return F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda k: F.struct(F.get(line, k - 1).alias("a"), F.get(line, k).alias("b")))


def sides(ring: Column) -> Column:
    """The edges of a ring, the one that closes it first."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get(ring, F.pmod(k + n - 1, n)).alias("a"), F.get(ring, k).alias("b")))


def total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, e: s + of(e))


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings: a hole is outside."""

    def crossed(e: Column) -> Column:
        a, b = e.a, e.b
        rise = F.when(b.y == a.y, 1.0).otherwise(b.y - a.y)
        return ((a.y > y) != (b.y > y)) & (x < (b.x - a.x) * (y - a.y) / rise + a.x)

    parity = lambda odd, ring: F.aggregate(sides(ring), odd, lambda s, e: s != crossed(e))
    return F.aggregate(rings, F.lit(False), parity)


def closest_on_segment(x: Column, y: Column, a: Column, b: Column) -> Column:
    """The point of a segment that is nearest to (x, y)."""
    dx, dy = b.x - a.x, b.y - a.y
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a.x) * dx + (y - a.y) * dy) / size))).otherwise(0.0)
    return F.struct((a.x + t * dx).alias("x"), (a.y + t * dy).alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(b.x - a.x, b.y - a.y)


def distance_to_segment(x: Column, y: Column, a: Column, b: Column) -> Column:
    near = closest_on_segment(x, y, a, b)
    return F.hypot(x - near.x, y - near.y)


def distance_to_line(x: Column, y: Column, line: Column) -> Column:
    return F.array_min(F.transform(edges(line), lambda e: distance_to_segment(x, y, e.a, e.b)))


def closest_on_line(x: Column, y: Column, line: Column) -> Column:
    """distance and point (x, y) of a line's nearest point; the first of several."""
    near = lambda e: closest_on_segment(x, y, e.a, e.b)
    found = F.transform(edges(line), lambda e: F.struct(F.hypot(x - near(e).x, y - near(e).y).alias("distance"), near(e).x.alias("x"), near(e).y.alias("y")))
    return F.aggregate(found, F.get(found, F.lit(0)), lambda best, e: F.when(e.distance < best.distance, e).otherwise(best))


def line_length(line: Column) -> Column:
    return F.when(F.size(line) > 1, total(edges(line), lambda e: distance(e.a, e.b))).otherwise(0.0)


def line_middle(line: Column) -> Column:
    """The point at half a line's length."""
    half = line_length(line) / 2
    start = F.struct(F.lit(0.0).alias("gone"), F.get(line, F.lit(0)).x.alias("x"), F.get(line, F.lit(0)).y.alias("y"), (half == 0).alias("done"))

    def walk(s: Column, e: Column) -> Column:
        d = distance(e.a, e.b)
        here = ~s.done & (s.gone + d > half)
        t = F.when(here, (half - s.gone) / d).otherwise(0.0)
        return F.struct(
            (s.gone + d).alias("gone"),
            F.when(here, e.a.x + (e.b.x - e.a.x) * t).when(s.done, s.x).otherwise(e.b.x).alias("x"),
            F.when(here, e.a.y + (e.b.y - e.a.y) * t).when(s.done, s.y).otherwise(e.b.y).alias("y"),
            (s.done | here).alias("done"),
        )

    return F.when(F.size(line) > 1, F.aggregate(edges(line), start, walk, lambda s: F.struct(s.x.alias("x"), s.y.alias("y")))).otherwise(F.get(line, F.lit(0)))


def signed_area(ring: Column) -> Column:
    """Twice over: positive where a ring with y downwards is an outer one."""
    return total(sides(ring), lambda e: (e.a.x - e.b.x) * (e.b.y + e.a.y))


def centroid(ring: Column) -> Column:
    """The centre of area; of a ring without area its first point."""
    cross = lambda e: e.b.y * e.a.x - e.a.y * e.b.x
    area = total(sides(ring), lambda e: cross(e) * 3)
    x, y = total(sides(ring), lambda e: (e.a.x + e.b.x) * cross(e)), total(sides(ring), lambda e: (e.a.y + e.b.y) * cross(e))
    first = F.get(ring, F.lit(0))
    return F.when(area == 0, F.struct(first.x.alias("x"), first.y.alias("y"))).otherwise(F.struct((x / area).alias("x"), (y / area).alias("y")))


def mean_point(line: Column) -> Column:
    n = F.size(line)
    return F.struct((total(line, lambda p: p.x) / n).alias("x"), (total(line, lambda p: p.y) / n).alias("y"))


def bounds(line: Column) -> Column:
    xs, ys = F.transform(line, lambda p: p.x), F.transform(line, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def closed(ring: Column) -> Column:
    """With the first point again at the end, unless it is there."""
    first = F.get(ring, F.lit(0))
    return F.when(F.element_at(ring, -1) == first, ring).otherwise(F.concat(ring, F.array(first)))


def opened(ring: Column) -> Column:
    return F.when((F.size(ring) > 1) & (F.element_at(ring, -1) == F.get(ring, F.lit(0))), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def affine(p: Column, a: float, b: float, c: float, d: float, scale: Column | float = 1.0) -> Column:
    return F.struct(((p.x * a + b) * scale).alias("x"), ((p.y * c + d) * scale).alias("y"))


def clip_ring(ring: Column, minx: float, miny: float, maxx: float, maxy: float) -> Column:
    """A ring cut to a box, edge by edge: left, top, right, bottom."""

    def cut(points: Column, edge: Column) -> Column:
        of = lambda p: F.when(edge.across, p.x).otherwise(p.y)
        inside = lambda p: F.when(edge.above, of(p) >= edge.at).otherwise(of(p) <= edge.at)

        def step(e: Column) -> Column:
            a, b = e.a, e.b
            t = F.try_divide(edge.at - of(a), of(b) - of(a))
            met = F.struct((a.x + (b.x - a.x) * t).alias("x"), (a.y + (b.y - a.y) * t).alias("y"))
            return F.filter(F.array(F.when(inside(a) != inside(b), met), F.when(inside(b), b)), lambda p: p.isNotNull())

        return F.flatten(F.transform(F.filter(sides(points), lambda e: e.b.isNotNull()), step))

    of_box = [(True, minx, True), (False, miny, True), (True, maxx, False), (False, maxy, False)]
    each = [F.struct(F.lit(x).alias("across"), F.lit(float(v)).alias("at"), F.lit(up).alias("above")) for x, v, up in of_box]
    return F.aggregate(F.array(*each), ring.cast(POINTS), lambda points, edge: F.when(F.size(points) > 0, cut(points, edge)).otherwise(points))


def clip_segment(a: Column, b: Column, minx: float, miny: float, maxx: float, maxy: float) -> Column:
    """The part of a segment in a box as a struct of a and b, null if none is: parameters in and out of each edge."""
    dx, dy = b.x - a.x, b.y - a.y
    enter, leave, out = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for start, d, low, high in ((a.x, dx, minx, maxx), (a.y, dy, miny, maxy)):
        t0, t1 = F.try_divide(low - start, d), F.try_divide(high - start, d)
        enter.append(F.when(d != 0, F.least(t0, t1)).otherwise(0.0))
        leave.append(F.when(d != 0, F.greatest(t0, t1)).otherwise(1.0))
        out = out | ((d == 0) & ((start < low) | (start > high)))
    t0, t1 = F.greatest(*enter), F.least(*leave)
    at = lambda t: F.struct((a.x + dx * t).alias("x"), (a.y + dy * t).alias("y"))
    own = lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))
    ends = F.when(t0 == 0, own(a)).otherwise(at(t0)), F.when(t1 == 1, own(b)).otherwise(at(t1))  # an end inside stays exactly
    return F.when(~out & (t0 <= t1), F.struct(ends[0].alias("a"), ends[1].alias("b")))


def _simplified(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points stay: points nearer than the tolerance to the last kept one go, then those that the line through
    their neighbours passes within the tolerance."""
    near, last = [0], 0
    for k in range(1, len(xy)):
        if ((xy[k] - xy[last]) ** 2).sum() > tolerance**2:
            near.append(k)
            last = k
    if last != len(xy) - 1:
        near.append(len(xy) - 1)
    kept, todo, p = {0, len(near) - 1}, [(0, len(near) - 1)], xy[near]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        d, rest = p[high] - p[low], p[low + 1 : high] - p[low]
        size = (d**2).sum()
        t = np.clip(rest @ d / size, 0, 1) if size else np.zeros(len(rest))
        off = ((rest - t[:, None] * d) ** 2).sum(axis=1)
        far = int(off.argmax())
        if off[far] > tolerance**2:
            kept.add(low + 1 + far)
            todo += [(low, low + 1 + far), (low + 1 + far, high)]
    return p[sorted(kept)]


def simplify(line: Column, tolerance: float) -> Column:
    """A line with fewer points, none of the others farther than the tolerance from it; all stay at tolerance 0."""
    if not tolerance:
        return line

    @F.pandas_udf(POINTS)
    def simplified(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in lines:
            yield batch.map(lambda v: [{"x": x, "y": y} for x, y in _simplified(np.array([(p["x"], p["y"]) for p in v]), tolerance).tolist()] if v is not None and len(v) else v)

    return simplified(line)


def clipped_line(line: Column, minx: float, miny: float, maxx: float, maxy: float) -> Column:
    """The parts of a line in a box: segments are cut one by one, and a new part begins where the line left the box."""
    pieces = F.transform(edges(line), lambda e: F.struct(e.b.alias("end"), clip_segment(e.a, e.b, minx, miny, maxx, maxy).alias("cut")))
    start = F.struct(F.array().cast(f"array<{POINTS}>").alias("parts"), F.array().cast(POINTS).alias("open"))

    def walk(s: Column, p: Column) -> Column:
        a, b = p.cut.a, p.cut.b
        held = F.when(F.size(s.open) > 0, F.concat(s.open, F.array(b))).otherwise(F.array(a, b))
        leaves = (b.x != p.end.x) | (b.y != p.end.y)
        missed = F.struct(F.when(F.size(s.open) > 0, F.concat(s.parts, F.array(s.open))).otherwise(s.parts).alias("parts"), F.array().cast(POINTS).alias("open"))
        met = F.struct(F.when(leaves, F.concat(s.parts, F.array(held))).otherwise(s.parts).alias("parts"), F.when(leaves, F.array().cast(POINTS)).otherwise(held).alias("open"))
        return F.when(p.cut.isNull(), missed).otherwise(met)

    done = F.aggregate(pieces, start, walk, lambda s: F.when(F.size(s.open) > 0, F.concat(s.parts, F.array(s.open))).otherwise(s.parts))
    return F.when(F.size(line) > 1, done).otherwise(F.array().cast(f"array<{POINTS}>"))


def drawn_line(line: Column, minx: float, miny: float, maxx: float, maxy: float, tolerance: float = 0.5, clip: bool = True) -> Column:
    """What is drawn of a line in a view: its parts in the box, each simplified; nothing where their boxes don't meet."""
    own = bounds(line)
    meets = (own.minx <= maxx) & (own.maxx >= minx) & (own.miny <= maxy) & (own.maxy >= miny)
    nothing = F.array().cast(f"array<{POINTS}>")
    parts = clipped_line(line, minx, miny, maxx, maxy) if clip else F.array(line.cast(POINTS))
    return F.when(meets, simplify_parts(parts, tolerance)).otherwise(nothing)


def drawn_rings(rings: Column, minx: float, miny: float, maxx: float, maxy: float, weight: float = 0.0) -> Column:
    """What is drawn of a polygon's rings in a view that is grown by the stroke's weight; rings outside are left out."""
    box = (minx - weight, miny - weight, maxx + weight, maxy + weight)
    return F.filter(F.transform(rings, lambda r: clip_ring(r, *box)), lambda r: F.size(r) > 0)


def simplify_parts(parts: Column, tolerance: float) -> Column:
    """Each part of a line simplified."""

    @F.arrow_udf(f"array<{POINTS}>")
    def fewer(lines: pa.Array) -> pa.Array:
        def one(part: list[dict]) -> list[dict]:
            xy = np.array([(p["x"], p["y"]) for p in part]).reshape(-1, 2)
            return [{"x": x, "y": y} for x, y in (_simplified(xy, tolerance) if tolerance and len(xy) > 2 else xy).tolist()]

        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        return pa.array([None if parts is None else [one(part) for part in parts] for parts in lines.to_pylist()], kind)

    return fewer(parts)


def tessellated(line: Column) -> Column:
    """Two vertices for each point of a line, on either side: x, y, the normal nx, ny (of the mean direction of the
    segments that meet there) and side 1 or -1. A line of less than two points has none."""

    def unit(x: Column, y: Column) -> Column:
        size = lambda d: F.when(F.hypot(d.x, d.y) == 0, 1.0).otherwise(F.hypot(d.x, d.y))
        return bound(F.struct(x.alias("x"), y.alias("y")), lambda d: bound(size(d), lambda s: F.struct((d.x / s).alias("x"), (d.y / s).alias("y"))))

    def strip(v: Column, along: Column) -> Column:
        """along: the directions of the segments."""
        zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        way = lambda k: F.coalesce(F.get(along, k), zero)
        side = lambda p, d, s: F.struct(p.x.alias("x"), p.y.alias("y"), (d.y * -s).alias("nx"), (d.x * s).alias("ny"), F.lit(s).alias("side"))
        mean = lambda k: bound(F.struct(way(k - 1).alias("come"), way(k).alias("go")), lambda w: unit(w.come.x + w.go.x, w.come.y + w.go.y))
        return F.flatten(F.transform(v, lambda p, k: bound(mean(k), lambda d: F.array(side(p, d, 1), side(p, d, -1)))))

    made = bound(line, lambda v: bound(F.transform(edges(v), lambda e: unit(e.b.x - e.a.x, e.b.y - e.a.y)), lambda along: strip(v, along)))
    return F.when(F.size(line) > 1, made).otherwise(F.array().cast("array<struct<x:double,y:double,nx:double,ny:double,side:int>>"))


def projected_rings(rings: Column, crs: object, zoom: float, reach: float = 0.0) -> Column:
    """Rings of x (longitude) and y (latitude) in whole pixels, and the box of all of them grown by `reach`."""

    def pixel(p: Column) -> Column:
        x, y = crs.to_pixel(p.y, p.x, zoom)
        return F.struct(F.floor(x + 0.5).cast("double").alias("x"), F.floor(y + 0.5).cast("double").alias("y"))

    made = F.transform(rings, lambda r: F.transform(r, pixel))
    b = bounds(F.flatten(made))
    box = F.struct((b.minx - reach).alias("minx"), (b.miny - reach).alias("miny"), (b.maxx + reach).alias("maxx"), (b.maxy + reach).alias("maxy"))
    return F.struct(made.alias("rings"), box.alias("box"))
