"""Vector tiles as DataFrames: features to tile bytes and back."""

from __future__ import annotations

import itertools
import json
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geometry

POINT, LINE, POLYGON = 1, 2, 3
MOVE, DRAW, CLOSE = 1, 2, 7
#: Features of one encoded part; a tile with more is several parts, each a tile by itself (readers may join their bytes).
PART = 20_000
#: Features that a reading task holds at once.
READ_ROWS = 2_000
FEATURE = "layer string, extent int, id long, kind int, properties map<string,string>, typed string, parts array<array<struct<x:int,y:int>>>, error string"


def varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def block(tag: int, data: bytes) -> bytes:
    return varint(tag << 3 | 2) + varint(len(data)) + data


def number(tag: int, n: int) -> bytes:
    return varint(tag << 3) + varint(n)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(tag, value) of a message: integers for varints, bytes for the rest. Truncated bytes raise ValueError."""
    at = 0

    def whole() -> int:
        nonlocal at
        n = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("truncated or overlong varint")
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        key = whole()
        kind = key & 7
        if kind == 0:
            yield key >> 3, whole()
            continue
        size = {1: 8, 5: 4}.get(kind) or (whole() if kind == 2 else -1)
        if kind not in (1, 2, 5) or at + size > len(data):
            raise ValueError(f"field of wire type {kind} doesn't fit")
        yield key >> 3, data[at : at + size]
        at += size


def packed(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    if shift:
        raise ValueError("truncated packed field")
    return out


def draw(kind: int, parts: list) -> bytes:
    """The commands of points, lines or rings (rings without their repeated first point)."""
    out, x, y = [], 0, 0

    def go(points: list) -> None:
        nonlocal x, y
        for px, py in points:
            out.extend((zigzag(px - x), zigzag(py - y)))
            x, y = px, py

    if kind == POINT:
        parts = [[p for part in parts for p in part]]
    for part in parts:
        first = part if kind == POINT else part[:1]
        out.append(len(first) << 3 | MOVE)
        go(first)
        if kind != POINT and len(part) > 1:
            out.append((len(part) - 1) << 3 | DRAW)
            go(part[1:])
        if kind == POLYGON:
            out.append(1 << 3 | CLOSE)
    return b"".join(map(varint, out))


def drawn(data: bytes) -> list[list[tuple[int, int]]]:
    """Parts of a geometry; closed rings repeat their first point. Unknown commands raise ValueError."""
    codes, at, x, y, parts = packed(data), 0, 0, 0, []
    while at < len(codes):
        command, times = codes[at] & 7, codes[at] >> 3
        at += 1
        if command == CLOSE:
            if parts and parts[-1]:
                parts[-1].append(parts[-1][0])
            continue
        if command not in (MOVE, DRAW):
            raise ValueError(f"unknown command {command}")
        if at + 2 * times > len(codes) or (command == DRAW and not parts):
            raise ValueError("truncated geometry")
        for _ in range(times):
            dx, dy = codes[at : at + 2]
            at += 2
            x, y = x + (dx >> 1 ^ -(dx & 1)), y + (dy >> 1 ^ -(dy & 1))
            if command == MOVE:
                parts.append([])
            parts[-1].append((x, y))
    return parts


def value_bytes(v: object) -> bytes:
    """A property's value as a message: text, a truth value, a whole number (negative ones zigzag), or the shorter of the two
    kinds of floating numbers that holds it. Lists and objects become JSON text, as do whole numbers beyond 64 bits."""
    if isinstance(v, bool):
        return number(7, v)
    if isinstance(v, int) and -(1 << 63) <= v < 1 << 64:
        return number(5, v) if v >= 0 else number(6, zigzag(v))
    if isinstance(v, float):
        short = abs(v) < 3e38 and struct.unpack("<f", struct.pack("<f", v))[0] == v
        return varint(2 << 3 | 5) + struct.pack("<f", v) if short else varint(3 << 3 | 1) + struct.pack("<d", v)
    return block(1, (v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)).encode())


def encode_layer(name: str, extent: int, features: list[tuple[int | None, int, dict[str, object], list]]) -> bytes:
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    body = []
    for key, kind, properties, parts in features:
        tags = b"".join(varint(keys.setdefault(k, len(keys))) + varint(values.setdefault(value_bytes(v), len(values))) for k, v in properties.items() if v is not None)
        body.append(block(2, (number(1, key) if key is not None and key >= 0 else b"") + block(2, tags) + number(3, kind) + block(4, draw(kind, parts))))
    return block(3, number(15, 2) + block(1, name.encode()) + b"".join(body) + b"".join(block(3, k.encode()) for k in keys) + b"".join(block(4, v) for v in values) + number(5, extent))


def value(data: bytes) -> str | float | int | bool | None:
    """A property's value."""
    for tag, v in fields(data):
        match tag:
            case 1:
                return v.decode("utf-8", "replace")
            case 2:
                return struct.unpack("<f", v)[0]
            case 3:
                return struct.unpack("<d", v)[0]
            case 4 | 5:
                return v - (1 << 64) if tag == 4 and v >> 63 else v
            case 6:
                return v >> 1 ^ -(v & 1)
            case 7:
                return bool(v)
    return None


def value_text(v: object) -> str | None:
    """A value as text: numbers as Python writes them, booleans as true and false, nothing as null."""
    return str(v).lower() if isinstance(v, bool) else v if v is None else str(v)


def decode_layer(data: bytes) -> Iterator[tuple]:
    name, extent, keys, values, raw = None, 4096, [], [], []
    for tag, v in fields(data):
        match tag:
            case 1:
                name = v.decode("utf-8", "replace")
            case 2:
                raw.append(v)
            case 3:
                keys.append(v.decode("utf-8", "replace"))
            case 4:
                values.append(value(v))
            case 5:
                extent = v
    if name is None:
        return
    for one in raw:
        key, kind, tags, parts, error = None, 0, [], [], None
        try:
            for tag, v in fields(one):
                match tag:
                    case 1:
                        key = v - (1 << 64) if v >> 63 else v
                    case 2:
                        tags = packed(v)
                    case 3:
                        kind = v
                    case 4:
                        parts = drawn(v)
            properties = {keys[k]: values[w] for k, w in zip(tags[::2], tags[1::2], strict=False)}
        except (ValueError, IndexError) as bad:
            properties, error = {}, str(bad)
        typed = json.dumps({k: None if v != v or v in (float("inf"), -float("inf")) else v for k, v in properties.items()}, ensure_ascii=False)
        properties = {k: value_text(v) for k, v in properties.items()}
        yield name, extent, key, kind, properties, typed, parts, error


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """read_tiles() of one task's batches, handed on READ_ROWS features at a time, however many a tile holds."""

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k, place in enumerate(zip(*[batch[c].to_pylist() for c in ("z", "x", "y")], strict=True)):
            try:
                for tag, v in fields(batch["data"][k].as_py() or b""):
                    if tag == 3:
                        for feature in decode_layer(v):
                            yield *place, *feature
            except ValueError as bad:
                yield *place, *[None] * 7, str(bad)

    for batch in batches:
        found = each(batch)
        while out := [*itertools.islice(found, READ_ROWS)]:
            columns = [*zip(*out, strict=True)]
            arrays = [pa.array(c, t) for c, t in zip(columns[:9], READ_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, parts_array(columns[9]), pa.array(columns[10], pa.string())], ["z", "x", "y", *[c.split()[0] for c in FEATURE.split(", ")]])


def read_tiles(tiles: DataFrame) -> DataFrame:
    """tiles (z, x, y, data) -> one row per feature: z, x, y, layer, extent, id, kind, properties (as
    text), typed (properties as a JSON object, with numbers, booleans and null), parts, error.

    Layers without a name are left out; of layers that share a name in one tile all features come. Bytes that don't
    parse give one row with `error`, or one for the feature they belong to. Null and empty data give no rows."""

    return tiles.select("z", "x", "y", "data").mapInArrow(read_batches, f"z int, x int, y int, {FEATURE}")


READ_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string()]


def parts_array(features: tuple) -> pa.Array:
    """Parts of many features as one array, from flat lists of their coordinates."""
    parts = [part for f in features for part in f or ()]
    flat = np.array([p for part in parts for p in part], np.int32).reshape(-1, 2)
    points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"])
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), points)
    whole = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(f or ()) for f in features]]), pa.int32()), inner)
    return whole if all(f is not None for f in features) else pc.if_else(pa.array([f is not None for f in features]), whole, pa.scalar(None, whole.type))


def points_of(parts: pa.ListArray) -> Iterator[list[list[tuple[int, int]]]]:
    """The parts of each feature of a batch, from the flat arrays below them."""
    inner = parts.values
    x, y = (inner.values.field(c).to_pylist() for c in "xy")
    outer, ends = parts.offsets.to_pylist(), inner.offsets.to_pylist()
    return ([[*zip(x[ends[k] : ends[k + 1]], y[ends[k] : ends[k + 1]], strict=True)] for k in range(a, b)] for a, b in zip(outer, outer[1:], strict=False))


def write_tiles(features: DataFrame, extent: int = 4096) -> DataFrame:
    """features (z, x, y, layer, id, kind, parts, and properties or typed) -> z, x, y, part, data. typed: a JSON object, whose
    numbers and truth values are written as such; else properties, a map of text. Null values are left out. Parts have
    about PART features, so that no tile, however full, is one task's work; polygons' rings come without their repeated
    first point."""
    size = features.groupBy("z", "x", "y").agg(F.ceil(F.count(F.lit(1)) / PART).alias("__parts"))
    dealt = features.join(size, ["z", "x", "y"]).withColumn("part", F.pmod(F.xxhash64("id", "parts"), "__parts").cast("int"))

    names = ["z", "x", "y", "part", "data"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def made(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [()] * 5, kinds, strict=True)], names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, layer, held, data = None, None, [], b""
        for batch in batches:
            done = []
            flat = zip(*[batch[c].to_pylist() for c in ("z", "x", "y", "part", "layer", "id", "kind", "properties")], points_of(batch["parts"]), strict=True)
            for z, x, y, part, name, key, kind, properties, parts in flat:
                own = (z, x, y, part)
                if held and (own != tile or name != layer):
                    data += encode_layer(layer, extent, held)
                    held = []
                if tile is not None and own != tile:
                    done.append((*tile, data))
                    data = b""
                tile, layer = own, name
                told = json.loads(properties or "{}") if typed else dict(properties or ())
                held.append((None if key is None else int(key), int(kind), told, parts))
            yield made(done)
        if tile is not None:
            yield made([(*tile, data + encode_layer(layer, extent, held))])

    typed = "typed" in features.columns
    place = ["z", "x", "y", "part"]
    columns = dealt.select(*place, "layer", F.col("id").cast("string").alias("id"), "kind", F.col("typed" if typed else "properties").alias("properties"), "parts")
    return columns.repartition(*place).sortWithinPartitions(*place, "layer", "id").mapInArrow(encode, "z int, x int, y int, part int, data binary")


def feature_box(parts: Column) -> Column:
    """The box of a feature's parts in the tile's units; null without points."""
    return geometry.bounds(F.flatten(parts))


def polygons(parts: Column) -> Column:
    """Rings as polygons, each an outer ring (positive area, y downwards) and the holes after it; rings without area and
    holes before any outer ring are left out."""
    kind = "array<array<array<struct<x:{0},y:{0}>>>>"
    none = F.array().cast(kind.format("int"))

    def add(found: Column, ring: Column) -> Column:
        area = geometry.signed_area(ring)
        last = F.element_at(found, -1)
        grown = F.concat(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), F.array(F.concat(last, F.array(ring))))
        return F.when(area > 0, F.concat(found, F.array(F.array(ring)))).when((area < 0) & (F.size(found) > 0), grown).otherwise(found)

    return F.aggregate(parts, none, add)


def to_geojson(features: DataFrame) -> DataFrame:
    """read_tiles() rows with `geojson`, the feature as GeoJSON text in degrees. Unknown kinds are points at 0, 0."""
    size = F.col("extent") * F.pow(F.lit(2.0), F.col("z"))

    def spot(p: Column) -> Column:
        up = 180 - (p.y + F.col("y") * F.col("extent")) * 360 / size
        return F.array((p.x + F.col("x") * F.col("extent")) * 360 / size - 180, F.atan(F.exp(up * math.pi / 180)) * (360 / math.pi) - 90)

    line = lambda part: F.transform(part, spot)
    parts, kind = F.col("parts"), F.col("kind")
    points, shapes = F.flatten(parts), polygons(parts)
    text = lambda name, c: F.concat(F.lit(f'{{"type":"{name}","coordinates":'), F.to_json(c), F.lit("}"))
    one = lambda c: F.get(c, F.lit(0))
    geometry_text = (
        F.when((kind == POINT) & (F.size(points) == 1), text("Point", spot(one(points))))
        .when(kind == POINT, text("MultiPoint", line(points)))
        .when((kind == LINE) & (F.size(parts) == 1), text("LineString", line(one(parts))))
        .when(kind == LINE, text("MultiLineString", F.transform(parts, line)))
        .when((kind == POLYGON) & (F.size(shapes) == 1), text("Polygon", F.transform(one(shapes), line)))
        .when(kind == POLYGON, text("MultiPolygon", F.transform(shapes, lambda p: F.transform(p, line))))
        .otherwise(F.lit('{"type":"Point","coordinates":[0,0]}'))
    )
    key = F.when(F.col("id").isNotNull(), F.concat(F.lit(',"id":'), F.col("id").cast("string"))).otherwise("")
    values = F.coalesce("typed", F.lit("{}"))
    return features.withColumn("geojson", F.concat(F.lit('{"type":"Feature"'), key, F.lit(',"geometry":'), geometry_text, F.lit(',"properties":'), values, F.lit("}")))
