"""Work grows with the input: rows of a size that a step of quadratic work would not finish, against plain versions."""

import math
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.functions import colors, geometry, text
from tilewright.functions.expressions import Scope, evaluate
from tilewright.operators import clusters, spatial, symbols
from tilewright.sources import services, vector_tiles
from tilewright.streaming import events


def encoded(points, precision=5):
    out, before = [], (0, 0)
    for lat, lng in ((round(y * 10**precision), round(x * 10**precision)) for x, y in points):
        for v in (lat - before[0], lng - before[1]):
            v = ~(v << 1) if v < 0 else v << 1
            while v >= 32:
                out.append(chr((32 | v & 31) + 63))
                v >>= 5
            out.append(chr(v + 63))
        before = lat, lng
    return "".join(out)


def test_long_polylines_and_those_that_break_off(spark):
    rng = random.Random(5)
    lines = [[(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(n)] for n in (3000, 1, 2, 7)]
    texts = [encoded(v) for v in lines]
    rows = [(0, [texts[0], texts[1]]), (1, []), (2, None), (3, [None, "", texts[2] + "_", "_", texts[3] + "?", texts[3]])]
    began = time.monotonic()
    got = {r.k: r.p for r in spark.createDataFrame(rows, "k int, t array<string>").select("k", text.decoded_polylines(F.col("t")).alias("p")).collect()}
    assert time.monotonic() - began < 30
    assert got[1] == [] and got[2] is None and [len(v) for v in got[0] + got[3]] == [3000, 1, 0, 0, 2, 0, 7, 7]
    for want, found in zip([lines[0], lines[1], lines[2], lines[3]], [got[0][0], got[0][1], got[3][2], got[3][5]], strict=True):
        assert [v for p in found for v in (p.x, p.y)] == pytest.approx([v for p in want for v in p], abs=1e-5)


def test_a_long_route_is_decoded_once(spark):
    line = encoded([(k / 100, k / 200) for k in range(3000)]).replace("\\", "\\\\")
    step = '{"distance":{"value":1},"polyline":{"points":"%s"}}' % line
    answers = spark.createDataFrame([('{"status":"OK","routes":[{"legs":[{"steps":[%s,%s]}]}]}' % (step, step),)], "a string")
    began = time.monotonic()
    [r] = services.google_routes(answers, "a").collect()
    assert time.monotonic() - began < 30
    assert [len(s.geometry) for s in r.steps] == [3000, 3000] and len(r.geometry) == 6000 and r.geometry[-1].x == 29.99


def test_the_first_stop_is_handed_on_as_it_stands(spark):
    rows = spark.createDataFrame([(0.0,), (-1.0,), (50.0,), (100.0,)], "value double")
    color = evaluate(["interpolate", ["linear"], ["get", "value"], 0, "black", 100, "white"], Scope.of(rows, ["value"]))
    assert [r.v for r in rows.select(color.alias("v")).collect()] == ["black", "black", "rgba(128,128,128,1)", "white"]


def hit_pairs(places, features):
    """By distances in Python: (x, y), (id, kind, parts, width, radius)."""

    def off(x, y, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)

    def odd(x, y, parts):
        sides = [(v[k - 1], v[k]) for v in parts for k in range(len(v))]
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in sides) % 2

    for x, y in places:
        for k, kind, parts, width, radius in features:
            pairs = [(a, b) for v in parts for a, b in zip(v, v[1:], strict=False)]
            if (kind == 1 and any(math.hypot(p[0] - x, p[1] - y) <= radius + 2 for v in parts for p in v)) or (kind == 2 and any(off(x, y, a, b) <= width / 2 + 4 for a, b in pairs)) or (kind == 3 and odd(x, y, parts)):
                yield x, y, k


def test_hits_of_pieces_count_once_and_cells_hold_few_candidates(spark):
    rng = random.Random(11)
    walk = lambda n, step: [(x := rng.uniform(0, 400), y := rng.uniform(0, 400))] + [(x := x + rng.uniform(-step, step), y := y + rng.uniform(-step, step)) for _ in range(n - 1)]  # noqa: E731, F841
    features = [(k, k % 3 + 1, [walk(k % 7 + (k % 3 == 2) * 3, 90) for _ in range(k % 4)], float(k % 9), float(k % 5)) for k in range(60)]
    features += [(60, 2, [[(5.0, 5.0)]], 1.0, 4.0), (61, 2, [[(0.0, 0.0), (0.0, 0.0), (300.0, 300.0), (0.0, 0.0)]], 1.0, 4.0), (62, 3, [[]], 1.0, 4.0), features[4], (63, 9, [[(5.0, 5.0)]], 1.0, 4.0)]
    places = [(rng.uniform(-50, 450), rng.uniform(-50, 450)) for _ in range(300)] + [(5.0, 5.0), (0.0, 0.0)]
    rows = [(k, kind, [[{"x": x, "y": y} for x, y in v] for v in parts], w, r) for k, kind, parts, w, r in features]
    shapes = spark.createDataFrame(rows, "id long, kind int, parts array<array<struct<x:double,y:double>>>, width double, radius double")
    spots = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "event_id long, x double, y double")
    want = sorted(hit_pairs(places, features))
    assert sorted(map(tuple, events.hit_features(spots, shapes).select("x", "y", "id").collect())) == want and len(want) > 200
    told = {r.event_id: (r.n_hits, r.features) for r in events.with_hits(spots, shapes, most=2).collect()}
    assert told == {e: (len(ids), ids[:2]) for e, p in enumerate(places) if (ids := sorted(k for x, y, k in want if (x, y) == p))}


def test_a_line_meets_the_cells_along_it_alone(spark):
    line = spark.createDataFrame([(1, 2, [[{"x": 0.0, "y": 0.0}, {"x": 6400.0, "y": 6400.0}]])], "id long, kind int, parts array<array<struct<x:double,y:double>>>")
    assert events._pieces(line, 64.0, ["id"]).count() < 500  # its box has ten thousand


def test_boxes_of_a_small_file_are_dealt_over_tasks(spark):
    rng = random.Random(2)
    boxes = [(k, x := rng.randrange(400), y := rng.randrange(400), x + rng.randrange(150), y + rng.randrange(150)) for k in range(120)]  # noqa: F841
    df = spark.createDataFrame(boxes, "id long, minx long, miny long, maxx long, maxy long").coalesce(1)
    met = spatial.box_join(df, df, 64.0, self_join=True)
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    assert sorted(map(tuple, met.collect())) == want and len(want) > 300
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_crowded_points_are_settled_in_ranges(spark, monkeypatch):
    rng = random.Random(9)
    spots = [(k * 3, rng.choice([0.1, 0.5]) + rng.random() * 0.03, 0.2 + rng.random() * 0.03) for k in range(600)] + [(k * 3 + 1, 0.7, 0.7) for k in range(300)]
    owners, free = {}, sorted(spots)
    for k, x, y in sorted(spots):
        if k not in owners:
            taken = [p[0] for p in free if p[0] not in owners and (p[1] - x) * (p[1] - x) + (p[2] - y) * (p[2] - y) <= 0.02 * 0.02]
            owners |= dict.fromkeys(taken, k)
    points = spark.createDataFrame(spots, "idx long, x double, y double")
    seen, real = [], clusters.greedy_owners
    monkeypatch.setattr(clusters, "greedy_owners", lambda of, pairs: seen.append(pairs.count()) or real(of, pairs))
    got = clusters.owners_within(points, 0.02, 500)
    assert dict(map(tuple, got.collect())) == owners and got.count() == len(spots)
    assert len(seen) > 2 and sum(seen) < 15_000  # all pairs are more than 80,000


@pytest.mark.parametrize("wide", [40, 120])
def test_long_sheets_are_filled_by_stretches(spark, wide):
    rng = random.Random(wide)
    sheets = ["a", None, *["b"] * 4]
    sprites = [(rng.choice(sheets), k // 2, k, rng.randrange(wide) if k != 59_000 else None, rng.choice([None, *range(30)])) for k in range(60_000)]
    want, rows = {}, {}
    for sheet, _, k, w, h in sprites:
        x, y, tall = rows.get(sheet, (0, 0, 0))
        if x is not None and w is not None and x + w > 100:
            x, y, tall = 0, y + tall, 0
        want[k] = sheet, x, y, w, h
        rows[sheet] = None if x is None or w is None else x + w, y, max(tall, h or 0)
    df = spark.createDataFrame(sprites, "sheet string, k int, id int, w int, h int").repartition(3)
    began = time.monotonic()
    made = symbols.shelves(df, "sheet", "k", 100).collect()
    assert time.monotonic() - began < 20
    assert {r.id: (r.sheet, r.x, r.y, r.w, r.h) for r in made} == want and len(made) == len(sprites)


def test_colors_are_parsed_once_a_row(spark):
    css = ["red", " #0F08", "#abc", "#a1b2c3", "#abcde", "rgb(10% 20% 30% / 0.5)", "RGBA(1, 2, 3, 50%)", "rgb(1,2)", "nothing", "", None, "transparent"]
    df = spark.createDataFrame([(c,) for c in css], "c string")
    got = [r.v for r in df.select(colors.color_channels(F.col("c")).alias("v")).collect()]
    assert got == [None if c is None or colors.parse_color(c) is None else pytest.approx(colors.parse_color(c)) for c in css]
    color = evaluate(["to-color", ["match", ["get", "c"], "a", "red", "b", "#0f08", "rgb(10% 20% 30% / 0.5)"]], Scope.of(df, ["c"]))
    plan = df.select(color.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 150


def test_full_tiles_are_read_in_small_batches(monkeypatch):
    monkeypatch.setattr(vector_tiles, "READ_ROWS", 70, raising=False)
    tile = vector_tiles.encode_layer("a", 4096, [(k, 2, {"k": k}, [[(k, 1), (2, k)]]) for k in range(100)])
    data = [tile, None, tile + tile, tile + b"\x1a\x7f", b""]
    batch = pa.RecordBatch.from_pydict({"z": [6] * 5, "x": [*range(5)], "y": [0] * 5, "data": pa.array(data, pa.binary())})
    made = [*vector_tiles.read_batches(iter([batch, batch.slice(1, 1)]))]
    assert max(b.num_rows for b in made) == 70
    rows = [(r["x"], r["id"]) for b in made for r in b.to_pylist()]
    assert rows == [(x, k) for x, n in ((0, 1), (2, 2), (3, 1)) for _ in range(n) for k in range(100)] + [(3, None)]


def test_strips_of_lines_take_each_direction_once(spark):
    line = [(0.0, 0.0), (3.0, 4.0), (3.0, 4.0), (3.0, 9.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in line],), ([{"x": 1.0, "y": 1.0}],), (None,)], "v array<struct<x:double,y:double>>")
    made = df.select(geometry.tessellated(F.col("v")).alias("s"))
    got = [[(p.x, p.y, round(p.nx, 6) + 0, round(p.ny, 6) + 0, p.side) for p in r.s] for r in made.collect()]
    along = [(0.6, 0.8), (0.6, 0.8), (0.0, 1.0), (0.0, 1.0)]
    assert got == [[(x, y, round(-s * dy, 6) + 0, round(s * dx, 6) + 0, s) for (x, y), (dx, dy) in zip(line, along, strict=True) for s in (1, -1)], [], []]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("HYPOT") < 10


def test_points_at_the_radius_meet_through_four_cells(spark):
    spots = [(k, k % 20 * 0.05, k // 20 * 0.05) for k in range(200)] + [(200 + k, -0.1 * k, 7.3) for k in range(9)]
    df = spark.createDataFrame(spots, "id long, x double, y double")
    met = spatial.radius_join(df, df, "id", "id", 0.05, self_join=True)
    want = [(a[0], b[0]) for a in spots for b in spots if a[0] < b[0] and (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]) <= 0.05 * 0.05]
    assert sorted((r.a, r.b) for r in met.collect()) == sorted(want) and len(want) > 100
    assert "sequence(" in met._jdf.queryExecution().optimizedPlan().toString()  # not nine cells for each point
