"""Text and JSON values as columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.geometry import POINTS


def split_words(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def strip_html(text: Column) -> Column:
    """Without what stands between < and >; nothing else is decoded. Null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", "")


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with each {key} replaced; a key without a value is an error when the plan is made, a null value one
    when it runs."""
    import re

    parts = re.split(r"\{ *([\w-]+) *\}", template)
    if lacking := {k for k in parts[1::2] if k not in values}:
        raise ValueError(f"no value for {sorted(lacking)}")
    value = lambda k: F.coalesce(values[k].cast("string"), F.raise_error(F.lit(f"no value for {k}")).cast("string"))
    return F.concat(*[value(p) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def json_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts hold equal values, whatever the order of keys and the white space; a text that is missing
    equals only one that is missing."""
    same = lambda x: F.to_json(F.parse_json(x))
    return same(a).eqNullSafe(same(b))


def is_flat(coordinates: Column) -> Column:
    """Whether coordinates (JSON) are a list of positions, not of lists of them."""
    first = F.get_json_object(coordinates, "$[0][0]")
    return F.coalesce(~first.startswith("["), F.lit(True))


def flattened_rings(rings: Column) -> Column:
    """Rings as one list of coordinates x0, y0, x1, y1, ... and, for each ring but the first, the place of its first
    point."""
    points = F.flatten(rings)
    coordinates = F.flatten(F.transform(points, lambda p: F.array(p.x, p.y)))
    sums = F.aggregate(
        rings, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts")), lambda s, r: F.struct((s.n + F.size(r)).alias("n"), F.concat(s.starts, F.array(s.n)).alias("starts"))
    )
    return F.struct(coordinates.alias("vertices"), F.slice(sums.starts, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))).alias("holes"))


def _decoded(texts: pa.Array, precision: int) -> pa.ListArray:
    """Each text's points, all texts at once."""
    n, texts = len(texts), texts.fill_null("")
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64) - 63
    row = np.repeat(np.arange(n), pc.utf8_length(texts).to_numpy())[codes >= 0]
    codes = codes[codes >= 0]
    ends = codes < 32
    starts = np.flatnonzero(np.r_[True, ends[:-1] | (row[1:] != row[:-1])][: len(codes)])
    sizes = np.diff(np.r_[starts, len(codes)])
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    bits = (codes & 31) << (place * 5 % 64)
    whole = ends[starts + sizes - 1]  # a text may break off within a number
    numbers, of = (np.bitwise_or.reduceat(bits, starts) if len(starts) else bits)[whole], row[starts][whole]
    numbers = (numbers >> 1) ^ -(numbers & 1)
    counts = np.bincount(of, minlength=n)
    pairs, first = counts // 2, np.r_[0, np.cumsum(counts)[:-1]][:n]
    numbers = numbers[np.arange(len(numbers)) - first[of] < 2 * pairs[of]].reshape(-1, 2)
    offsets = np.r_[0, np.cumsum(pairs)]
    walked = np.vstack([np.zeros((1, 2), np.int64), np.cumsum(numbers, axis=0)])
    lat, lng = ((walked[1:] - np.repeat(walked[offsets[:-1]], pairs, axis=0)) / 10.0**precision).T
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(lng), pa.array(lat)], ["x", "y"]))


def decoded_polylines(encoded: Column, precision: int = 5) -> Column:
    """The points (x: longitude, y: latitude) of each of an array of encoded polylines: numbers of five bits a character,
    the least first, each added to the one before; null gives none."""

    @F.arrow_udf(f"array<{POINTS}>")
    def decoded(lists: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), _decoded(lists.flatten(), precision), mask=lists.is_null())

    return decoded(encoded)


def decoded_polyline(encoded: Column, precision: int = 5) -> Column:
    """The same of one polyline."""
    return F.get(decoded_polylines(F.array(encoded), precision), F.lit(0))
