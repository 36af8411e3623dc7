"""Placing symbols without overlaps, their boxes, and the layout of sprites."""

from __future__ import annotations

import bisect
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.operators.clusters import greedy_owners
from tilewright.operators.shared import written


#: Boxes that are settled first; each later range of the order has twice as many.
FIRST_BOXES = 2_000
#: Pairs that share a cell within one range; a range with more is halved.
RANGE_PAIRS = 4_000_000


def _celled(boxes: DataFrame, cell: float) -> DataFrame:
    """A row for each cell (i, j) of a grid that a box meets."""
    at = lambda v: F.floor(F.col(v) / cell).cast("long")
    return boxes.withColumn("i", F.explode(F.sequence(at("minx"), at("maxx")))).withColumn("j", F.explode(F.sequence(at("miny"), at("maxy"))))


def _refuses(old: str, new: str) -> Column:
    """Whether a placed box refuses a new one: they have a point in common, and the new one's priority isn't greater."""
    o, n = (lambda c, at=at: F.col(f"{at}.{c}") for at in (old, new))
    meet = (o("minx") <= n("maxx")) & (o("maxx") >= n("minx")) & (o("miny") <= n("maxy")) & (o("maxy") >= n("miny"))
    return meet & (o("priority").isNull() | n("priority").isNull() | (o("priority") >= n("priority")))


def _settled(boxes: DataFrame, cell: float) -> DataFrame:
    """The boxes that find a place among themselves, by their pairs."""
    own = _celled(boxes, cell)
    first = (F.col("b.i") == F.floor(F.greatest("a.minx", "b.minx") / cell)) & (F.col("b.j") == F.floor(F.greatest("a.miny", "b.miny") / cell))
    met = own.alias("a").join(own.alias("b"), F.expr("a.i = b.i AND a.j = b.j AND a.seq < b.seq")).where(first & _refuses("a", "b"))
    pairs = met.select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), F.col("b.minx").alias("bx"))
    owners = greedy_owners(boxes.select(F.col("seq").alias("idx"), F.col("minx").alias("x")), pairs)
    return boxes.join(owners.where("idx = owner").select(F.col("idx").alias("seq")), "seq", "left_semi")


def placed(boxes: DataFrame, cell: float | None = None, first: int = FIRST_BOXES, most: int = RANGE_PAIRS) -> DataFrame:
    """The boxes (seq, minx, miny, maxx, maxy, priority) that find a place when they come in the order of seq: a box is
    refused if it has a point in common with one placed before, unless both have a priority and its own is greater. What
    is placed stays. seq: integers, each once.

    The order is taken in ranges, each twice as long as all before. A range's boxes first look for what refuses them among
    those already placed, cell by cell, and end at the first one that does; only those that are left are compared with each
    other (see greedy_owners). In a crowded place few are left, so pairs grow with what is placed and not with all that
    overlaps. A range whose boxes still share cells `most` times is halved. cell: the side of the grid's cells, by default
    the mean side of the boxes.
    """
    columns = [F.col(c).cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy", "priority")]
    rows = written(boxes.select(F.col("seq").cast("long").alias("seq"), *columns), "boxes")
    side = (F.col("maxx") - F.col("minx") + F.col("maxy") - F.col("miny")) / 2
    n, mean, low, high = rows.agg(F.count("seq"), F.avg(side), F.min("seq"), F.max("seq")).first()
    if not n:
        return boxes.where("false")
    cell = cell or mean or 1.0
    shares = [first * 2**k / n for k in range(64) if first * 2**k < n]
    cuts = rows.agg(F.percentile_approx("seq", shares, int(min(10_000_000, 16 * n / first + 100)))).first()[0] if shares else []
    edges = [low - 1, *sorted({*cuts} - {high}), high]
    todo = [*zip(edges, edges[1:], strict=False)][::-1]
    kept: DataFrame | None = None
    while todo:
        begin, end = todo.pop()
        mine = rows.where((F.col("seq") > begin) & (F.col("seq") <= end))
        if kept is not None:
            refused = _celled(mine, cell).alias("new").join(_celled(kept, cell).alias("old"), F.expr("new.i = old.i AND new.j = old.j") & _refuses("old", "new"), "left_semi")
            mine = written(mine.join(refused.select("seq").distinct(), "seq", "left_anti"), "left")
        crowd = _celled(mine, cell).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
        middle = mine.agg(F.percentile_approx("seq", 0.5)).first()[0] if crowd > most else None
        if middle is not None and begin < middle < end:
            todo += [(middle, end), (begin, middle)]
            continue
        new = written(_settled(mine, cell), "placed")
        kept = new if kept is None else kept.union(new)
    return boxes.join(kept.select(F.col("seq")), "seq", "left_semi")


def text_size(text: Column, advances: dict[str, float], height: float, other: float) -> Column:
    """width and height of a line of text: the sum of its letters' advances (`other` for letters without one)."""
    known = F.create_map(*[F.lit(x) for pair in advances.items() for x in pair]) if advances else F.create_map().cast("map<string,double>")
    wide = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0.0), lambda s, c: s + F.coalesce(F.element_at(known, c), F.lit(other)))
    return F.struct(wide.alias("width"), F.when(F.length(text) > 0, F.lit(height)).otherwise(0.0).alias("height"))


def symbol_box(x: Column, y: Column, text: Column, text_size_at_24: Column, size: Column, icon: Column) -> Column:
    """The box of a symbol at (x, y): text of the measured size (that of 24 pixels) centred above it, an icon of so many
    pixels around it. Null where there is neither."""
    scale = size / 24
    w, h = text_size_at_24.width * scale, text_size_at_24.height * scale
    written = F.length(text) > 0
    of_text = F.when(written, F.struct((x - w / 2).alias("minx"), (y - h).alias("miny"), (x + w / 2).alias("maxx"), y.alias("maxy")))
    of_icon = F.when(icon.isNotNull(), F.struct((x - icon / 2).alias("minx"), (y - icon / 2).alias("miny"), (x + icon / 2).alias("maxx"), (y + icon / 2).alias("maxy")))
    return geo.box_union(of_text, of_icon)


def _stretch(ws: list[int], hs: list[int], width: int) -> list[tuple[int | None, int, int, int | None, int]]:
    """What a stretch of sprites makes of the row that it finds: (m, before, down, x, row) for each place where that row may
    end. A row begun up to x ends at the first with m > width - x, none at all where m is null. before: the height that the
    stretch gives to that row; down: the rows after it, to the last; x and row: where that one ends (what is added to x,
    where no row ended)."""
    at = [0, *itertools.accumulate(ws)]
    ends: dict[int, tuple[int, int, int]] = {}

    def after(first: int) -> tuple[int, int, int]:
        begun = []
        while first not in ends:
            last = max(first + 1, bisect.bisect_right(at, at[first] + width) - 1)
            tall = max(hs[first:last])
            if last >= len(ws):
                ends[first] = 0, at[-1] - at[first], tall
            else:
                begun.append((first, tall))
                first = last
        down, x, row = ends[first]
        for first, tall in reversed(begun):
            down += tall
            ends[first] = down, x, row
        return ends[begun[0][0] if begun else first]

    out, tall = [], 0
    for k, h in enumerate(hs):
        if at[k + 1] > (out[-1][0] if out else -1):
            out.append((at[k + 1], tall, *after(k)))
        if at[k + 1] > width:
            return out
        tall = max(tall, h)
    return [*out, (None, tall, 0, at[-1], tall)]


def shelves(sprites: DataFrame, atlas: str, order: str, width: int) -> DataFrame:
    """Places of sprites (atlas, order, id, w, h) in sheets of the given width, in order: side by side, and from the left
    again below the tallest of the row when one doesn't fit. w and h: not below 0. What comes after a sprite without w has no
    x. A sheet is dealt over tasks by stretches of its order: each first tells where it would end, whatever row it finds
    (there are no more answers than sprites in a row); then all know where they begin."""
    tasks = int(sprites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = lambda c: F.when(F.col(c) < 0, F.raise_error(F.lit(f"a sprite whose {c} is below 0")).cast("int")).otherwise(F.col(c).cast("int")).alias(c)
    rows = sprites.select(F.col(atlas).alias("sheet"), F.col(order).alias("k"), "id", whole("w"), whole("h"))
    placed_by = ["sheet", "k", "id", "w", "h"]
    dealt = written(rows.repartitionByRange(tasks, *placed_by).withColumn("part", F.spark_partition_id()), "sprites")
    sheet, own = (rows.schema[c].dataType.simpleString() for c in ("sheet", "id"))

    def told(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("k", "id", "w", "h")])
        ws, hs = part["w"].to_pylist(), [h or 0 for h in part["h"].to_pylist()]
        cut = ws.index(None) if None in ws else len(ws)
        ends = [(m, before, down, x, row, cut < len(ws)) for m, before, down, x, row in _stretch(ws[:cut], hs[:cut], width)]
        columns = [pa.array(c, t) for c, t in zip(zip(*ends, strict=True), [pa.int64()] * 5 + [pa.bool_()], strict=True)]
        first = pa.array([0] * len(ends))
        return pa.table([part["sheet"].combine_chunks().take(first), part["part"].combine_chunks().take(first), *columns], ["sheet", "part", "m", "before", "down", "ends_x", "ends_row", "lost"])

    def begun(one: pa.Table) -> pa.Table:
        parts: dict[int, list] = {}
        for part, *end in zip(*[one[c].to_pylist() for c in ("part", "m", "before", "down", "ends_x", "ends_row", "lost")], strict=True):
            parts.setdefault(part, []).append(end)
        x, y, row, out = 0, 0, 0, []
        for part in sorted(parts):
            out.append((part, x, y, row))
            if x is None:
                continue
            m, before, down, ends_x, ends_row, lost = min((e for e in parts[part] if e[0] is None or e[0] > width - x), key=lambda e: (e[0] is None, e[0]))
            x, y, row = (x + ends_x, y, max(row, ends_row)) if m is None else (ends_x, y + max(row, before) + down, ends_row)
            x = None if lost else x
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32()] + [pa.int64()] * 3, strict=True)]
        return pa.table([one["sheet"].combine_chunks().take(pa.array([0] * len(out))), *columns], ["sheet", "part", "x", "y", "row"])

    def put(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("k", "id", "w", "h")])
        x, y, row = (part[c][0].as_py() for c in ("x", "y", "row"))
        xs, ys = [], []
        for w, h in zip(part["w"].to_pylist(), part["h"].to_pylist(), strict=True):
            if x is not None and w is not None and x + w > width:
                x, y, row = 0, y + row, 0
            xs.append(x)
            ys.append(y)
            x, row = None if x is None or w is None else x + w, max(row, h or 0)
        return pa.table([part["sheet"], part["id"], pa.array(xs, pa.int32()), pa.array(ys, pa.int32()), part["w"], part["h"]], ["sheet", "id", "x", "y", "w", "h"])

    ends = dealt.groupBy("sheet", "part").applyInArrow(told, f"sheet {sheet}, part int, m long, before long, down long, ends_x long, ends_row long, lost boolean")
    starts = ends.groupBy("sheet").applyInArrow(begun, f"sheet {sheet}, part int, x long, y long, row long").withColumnsRenamed({"sheet": "s", "part": "p"})
    met = dealt.join(starts, F.col("sheet").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).drop("s", "p")
    done = met.groupBy("sheet", "part").applyInArrow(put, f"sheet {sheet}, id {own}, x int, y int, w int, h int")
    return done.withColumnRenamed("sheet", atlas)
