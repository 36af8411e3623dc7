"""Known values and brute force for what SQL can't express or states in another way."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright import catalog
from tilewright.functions import elevation, geo, geometry
from tilewright.operators import clusters
from tilewright.sources import geojson, vector_tiles
from tilewright.streaming import state


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def line(*points):
    return F.array(*[geometry.point(float(x), float(y)) for x, y in points])


def test_every_query_has_sql_or_a_test():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"simplify_lines", "clip_polygons", "cluster_levels", "tiles_retained", "icon_shelves", "throttled_calls", "lines_drawn", "cluster_tile"}


def test_distances_and_projections(spark):
    far = geo.haversine(F.lit(36.12), F.lit(-86.67), F.lit(33.94), F.lit(-118.40))
    x, y = geo.spherical_mercator(F.lit(50.0), F.lit(30.0))
    ex, ey = geo.elliptical_mercator(F.lit(50.0), F.lit(30.0))
    got = one(spark, far, x, y, ex, ey, *[geo.wrap(F.lit(float(v))) for v in (190, 380, -190)])
    assert 2886444.43 < got[0] < 2886444.45
    assert got[1] == pytest.approx(3339584.7238, abs=1e-3) and got[2] == pytest.approx(6446275.84102, abs=1e-3)
    assert got[3] == pytest.approx(3339584, abs=1) and got[4] == pytest.approx(6413524, abs=1)
    assert got[5:] == (-170, 20, 170)


def test_segments_and_rings(spark):
    a, b = geometry.point(0.0, 10.0), geometry.point(10.0, 0.0)
    near = geometry.closest_on_segment(F.lit(0.0), F.lit(0.0), a, b)
    cut = geometry.clip_segment(geometry.point(0.0, 0.0), geometry.point(15.0, 15.0), 5.0, 0.0, 15.0, 10.0)
    ring = geometry.clip_ring(line((5, 5), (15, 10), (10, 15)), 0.0, 0.0, 10.0, 10.0)
    got = one(spark, geometry.distance_to_segment(F.lit(0.0), F.lit(0.0), a, b), near, cut, ring)
    assert got[0] == pytest.approx(math.sqrt(200) / 2) and (got[1].x, got[1].y) == (5, 5)
    assert [(p.x, p.y) for p in got[2]] == [(5, 5), (10, 10)]
    assert {(p.x, p.y) for p in got[3]} == {(7.5, 10), (5, 5), (10, 7.5), (10, 10)}


def test_simplify_keeps_ends_and_stays_near(spark):
    rng = random.Random(3)
    points = [(k, rng.uniform(0, 4)) for k in range(60)]
    kept = [(p.x, p.y) for p in one(spark, geometry.simplify(line(*points), 1.0))[0]]
    assert kept[0] == points[0] and kept[-1] == points[-1] and 2 < len(kept) < 60 and set(kept) <= {*points}


def test_tile_bytes(spark):
    ring = [(10, 20), (110, 20), (110, 120), (10, 120)]
    layer = vector_tiles.encode_layer("water", 4096, [(42, 3, {"name": "Ocean"}, [ring]), (None, 1, {}, [[(1, 2), (3, -4)]])])
    truncated = vector_tiles.block(3, vector_tiles.block(1, b"bad") + vector_tiles.block(2, vector_tiles.number(3, 2) + vector_tiles.block(4, vector_tiles.varint(9) + b"\x02")))
    tiles = spark.createDataFrame([(0, 0, 0, layer), (0, 0, 1, truncated), (0, 0, 2, b"\xff"), (0, 0, 3, b""), (0, 0, 4, None)], "z int, x int, y int, data binary")
    got = {(r.y, r.id): r for r in vector_tiles.read_tiles(tiles).collect()}
    assert {*got} == {(0, 42), (0, None), (1, None), (2, None)}
    assert [(p.x, p.y) for p in got[0, 42].parts[0]] == [*ring, ring[0]] and got[0, 42].properties == {"name": "Ocean"}
    assert [(p.x, p.y) for part in got[0, None].parts for p in part] == [(1, 2), (3, -4)]
    assert got[1, None].error and got[2, None].error
    assert vector_tiles.read_tiles(tiles.where("false")).count() == 0


def test_write_tiles(spark):
    rows = [(1, x, 0, layer, k, 1, {"k": str(k)}, [[(k, -k)]]) for x in range(3) for layer in ("a", "b") for k in range(5)]
    df = spark.createDataFrame(rows, "z int, x int, y int, layer string, id long, kind int, properties map<string,string>, parts array<array<struct<x:int,y:int>>>")
    made = vector_tiles.write_tiles(df)
    assert made.count() == 3 and vector_tiles.write_tiles(df.where("false")).count() == 0
    back = {(r.x, r.layer, r.id, r.properties["k"], r.parts[0][0].y) for r in vector_tiles.read_tiles(made).collect()}
    assert back == {(x, layer, k, str(k), -k) for x in range(3) for layer in ("a", "b") for k in range(5)}


def test_geojson(spark):
    spot = {"type": "Point", "coordinates": [1, 2]}
    feature = {"type": "Feature", "id": 7, "properties": {"a": "b"}, "geometry": spot}
    docs = [json.dumps(x) for x in (spot, feature, {"type": "FeatureCollection", "features": [feature, feature]}, {"other": 1})] + ["", None]
    got = geojson.read_features(spark.createDataFrame([(d,) for d in docs], "doc string"), "doc").collect()
    assert len(got) == 4 and {r.coordinates for r in got} == {"[1,2]"} and {r.kind for r in got} == {1}


def greedy(points, radius, zooms, min_points):
    """Levels of clusters by one pass in order at each zoom; a cluster keeps its origin's index."""
    level = [(k, x, y, 1) for k, x, y in points]
    out = {zooms[0] + 1: level}
    for z in zooms:
        r, free, made = radius / (512 * 2**z), {p[0] for p in level}, []
        for i, x, y, n in level:
            if i not in free:
                continue
            free.discard(i)
            near = [p for p in level if p[0] in free and (p[1] - x) ** 2 + (p[2] - y) ** 2 <= r * r]
            free -= {p[0] for p in near}
            whole = [(i, x, y, n), *near]
            total = sum(p[3] for p in whole)
            if near and total >= min_points:
                made.append((i, sum(p[1] * p[3] for p in whole) / total, sum(p[2] * p[3] for p in whole) / total, total))
            else:
                made += whole
        level = sorted(made)
        out[z] = level
    return out


@pytest.mark.parametrize("min_points", [2, 4])
def test_clusters(spark, min_points):
    rng = random.Random(42)
    rows = [(k, rng.uniform(10, 40), rng.uniform(20, 50), 1.0) for k in range(120)] + [(200, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, lng double, lat double, w double")
    x, y = clusters.unit_mercator(F.col("lng"), F.col("lat"))
    points = [tuple(r) for r in df.where("lng IS NOT NULL").select("k", x, y).orderBy("k").collect()]
    levels = clusters.cluster(df, "k", min_points=min_points, max_zoom=3, min_zoom=2, sums={"w": F.col("w")}).cache()
    for z, want in greedy(points, clusters.RADIUS, [3, 2], min_points).items():
        got = sorted((r.idx, r.x, r.y, r.n) for r in levels.where(f"zoom = {z}").collect())
        assert [(g[0], g[3]) for g in got] == [(w[0], w[3]) for w in want]
        assert [v for g in got for v in g[1:3]] == pytest.approx([v for w in want for v in w[1:3]])
    top = levels.where("zoom = 2 AND cluster_id % 32 = 3").first()
    assert clusters.children(levels, top.cluster_id).agg(F.sum("n")).first()[0] == top.n == top.w
    assert clusters.cluster(df.where("false"), "k", max_zoom=1).count() == 0
    assert clusters.in_box(levels, 2, -180, -85, 180, 85).agg(F.sum("n")).first()[0] == 120


def test_elevation(spark):
    rgb = lambda f, *c: f(*map(F.lit, c))
    grid = F.array(*map(F.lit, (0.0, 10.0, 20.0, 30.0)))
    at = lambda x, y: elevation.bilinear(grid, 2, F.lit(x), F.lit(y))
    got = one(spark, rgb(elevation.rgb_tenths, 0, 0, 0), rgb(elevation.rgb_tenths, 0, 1, 0), rgb(elevation.rgb_fractions, 128, 0, 1), at(0.5, 0.5), at(-5.0, -5.0), at(999.0, 999.0))
    assert [*got] == pytest.approx([-10000, -9974.4, 1 / 256, 15, 0, 30])


def test_state_and_cache(spark):
    changes = spark.createDataFrame([("a", 1, "hover", 1.0), ("a", 2, "hover", None), ("a", 3, "on", 2.0), ("b", 1, "on", None)], "id string, t int, name string, v double")
    assert [tuple(r) for r in state.merged_state(changes, ["id"], ["t"], "name", "v").collect()] == [("a", {"on": 2.0})]
    cached = spark.createDataFrame([("c", k, 4, k) for k in range(3)], "cache string, key int, bytes int, added_at int")
    assert {r.key for r in state.evicted(cached, ["cache"], "key", max_entries=2).collect()} == {1, 2}
    assert {r.key for r in state.evicted(cached, ["cache"], "key", max_bytes=5).collect()} == {2}
    assert {r.key for r in state.live(cached, F.lit(2), 1).collect()} == {1, 2}


def test_windows_on_a_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{k % 10}:00", "click", float(k)) for k in range(20)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/events")
    running = state.tumbling(stream, "ts", "5 minutes", "event_type").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    assert {(r.n, r.total) for r in spark.table("windows").collect()} == {(10, sum(k for k in range(20) if k % 10 < 5)), (10, sum(k for k in range(20) if k % 10 > 4))}
