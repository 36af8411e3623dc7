"""What SQL can't express, against one pass in order, and known values of the parts beside the queries."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import camera, elevation, geo, geometry, text
from tilewright.operators import clusters, spatial, styles, symbols, tables
from tilewright.plans import map_queries
from tilewright.sources import geojson, services, vector_tiles
from tilewright.streaming import events

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def line(*points):
    return F.array(*[geometry.point(float(x), float(y)) for x, y in points])


def test_symbols_are_placed_as_in_order(spark):
    rng = random.Random(5)
    rows = []
    for k in range(150):
        x, y = rng.uniform(0, 256), rng.uniform(0, 256)
        rows.append((k, x, y, x + rng.uniform(2, 40), y + rng.uniform(2, 40), rng.choice([None, 1.0, 2.0, 3.0])))
    kept = []
    for b in rows:
        over = [o for o in kept if not (b[3] < o[1] or b[1] > o[3] or b[4] < o[2] or b[2] > o[4])]
        if all(o[5] is not None and b[5] is not None and o[5] < b[5] for o in over):
            kept.append(b)
    boxes = spark.createDataFrame(rows, "seq int, minx double, miny double, maxx double, maxy double, priority double").repartition(3)
    assert {r.seq for r in symbols.placed(boxes).collect()} == {b[0] for b in kept}
    assert 10 < len(kept) < 150 and symbols.placed(boxes.where("false")).count() == 0


def test_rounds_over_many_tasks_settle_the_same(spark, monkeypatch):
    monkeypatch.setattr(clusters, "TASK_PAIRS", 20)
    points = spark.createDataFrame([(k, k * 0.6) for k in range(60)], "idx long, x double")
    pairs = points.alias("p").join(points.alias("q"), F.expr("p.idx + 1 = q.idx")).select(F.col("p.idx").alias("a"), F.col("q.idx").alias("b"), F.col("q.x").alias("bx"))
    assert {r.idx: r.owner for r in clusters.greedy_owners(points, pairs).collect()} == {k: k // 2 * 2 for k in range(60)}


def test_shelves_fill_in_order(spark):
    rows = {r.id: (r.x, r.y, r.w, r.h) for r in map_queries.icon_shelves(spark, SF).collect()}
    by_brand = {}
    for r in spark.read.parquet(f"{SF}/part.parquet").orderBy("p_partkey").collect():
        x, y, tall = by_brand.get(r.p_brand, (0, 0, 0))
        w, h = r.p_size % 30 + 5, r.p_size % 17 + 3
        if x + w > 256:
            x, y, tall = 0, y + tall, 0
        assert rows[r.p_partkey] == (x, y, w, h)
        by_brand[r.p_brand] = x + w, y, max(tall, h)


def throttle(calls, span):
    out, until, queued = [], float("-inf"), None
    for at, v in [*calls, (float("inf"), None)]:
        while queued is not None and at >= until:
            out.append((queued, until))
            queued, until = None, until + span
        if v is None:
            break
        if at >= until:
            out.append((v, at))
            until = at + span
        else:
            queued = v
    return out


def test_throttled_calls(spark):
    rows = sorted((r.user_id, r.event_id * 37 % 100_003 / 10, r.event_id) for r in spark.read.parquet(f"{SF}/events.parquet").collect())
    want = {(u, v, at) for u in {r[0] for r in rows} for v, at in throttle([(at, v) for w, at, v in rows if w == u], 60.0)}
    assert {(r.user_id, r.event_id, r.fired_at) for r in map_queries.throttled_calls(spark, SF).collect()} == want


def test_stream_of_calls(spark, tmp_path):
    calls = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "key string, at int, value string").select("key", F.timestamp_seconds("at").alias("time"), "value")
    calls.write.parquet(f"{tmp_path}/calls")
    stream = spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/calls")
    query = events.throttled_stream(stream, "key", "time", "value", 60_000).writeStream.format("memory").queryName("calls").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(15)  # timeouts by the clock never come to an end
    query.stop()
    assert {(r.key, r.value) for r in spark.table("calls").collect()} >= {("b", "z")} and {r.key for r in spark.table("calls").collect()} == {"a", "b"}


def test_retained_tiles(spark):
    rows = [(2, 1, 1, True, True), (3, 2, 2, False, True), (4, 5, 5, False, True), (6, 40, 40, True, True), (7, 82, 82, True, True), (7, 80, 80, True, True), (6, 42, 42, False, True)]
    loaded = spark.createDataFrame(rows, "z int, x int, y int, active boolean, loaded boolean")
    wanted = spark.createDataFrame([(5, 10, 10), (5, 20, 20), (5, 21, 21)], "z int, x int, y int")
    got = {tuple(r) for r in geo.retained(wanted, loaded).collect()}
    assert got == {(2, 1, 1), (3, 2, 2), (4, 5, 5), (6, 40, 40), (6, 42, 42), (7, 82, 82)}


def clip(a, b, box):
    """Part of a segment in a box by halving away what is outside, edge by edge."""
    (ax, ay), (bx, by) = a, b
    t0, t1 = 0.0, 1.0
    for p, q in ((ax - bx, ax - box[0]), (bx - ax, box[2] - ax), (ay - by, ay - box[1]), (by - ay, box[3] - ay)):
        if p == 0:
            if q < 0:
                return None
        elif p < 0:
            t0 = max(t0, q / p)
        else:
            t1 = min(t1, q / p)
    return None if t0 > t1 else ((ax + (bx - ax) * t0, ay + (by - ay) * t0), (ax + (bx - ax) * t1, ay + (by - ay) * t1))


def test_clipped_lines(spark):
    rng = random.Random(8)
    box = (20.0, 20.0, 80.0, 70.0)
    lines = [[(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    rows = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in v]) for k, v in enumerate(lines)], f"id int, line {geometry.POINTS}")
    got = {r.id: [[(p.x, p.y) for p in part] for part in r.parts] for r in rows.select("id", geometry.drawn_line(F.col("line"), *box, 0.0).alias("parts")).collect()}
    for k, points in enumerate(lines):
        parts, open_ = [], []
        for a, b in zip(points, points[1:], strict=False):
            cut = clip(a, b, box)
            if cut is None:
                continue
            open_ += [cut[1]] if open_ else [*cut]
            if math.dist(cut[1], b) > 1e-12:
                parts.append(open_)
                open_ = []
        parts += [open_] if open_ else []
        assert [[pytest.approx(p) for p in part] for part in parts] == got[k]
    whole = one(spark, geometry.drawn_line(line((0, 0), (1, 0.01), (2, 0)), -9, -9, 9, 9).alias("a"), geometry.drawn_rings(F.array(line((5, 5), (15, 10), (10, 15)), line((50, 50), (60, 50), (60, 60))), 0, 0, 10, 10).alias("b"))
    assert [(p.x, p.y) for p in whole[0][0]] == [(0, 0), (2, 0)] and len(whole[1]) == 1


def test_clusters_leaves_and_tiles(spark):
    rng = random.Random(4)
    points = [(k, rng.uniform(-179, 179), rng.uniform(-60, 60), float(k)) for k in range(80)] + [(100 + k, 179.9 - k / 50, 10.0, 1.0) for k in range(3)]
    df = spark.createDataFrame(points, "k long, lng double, lat double, w double")
    levels = clusters.cluster(df, "k", max_zoom=2, reduced={"top": (F.col("w"), F.max)}).cache()
    top = levels.where("zoom = 0 AND cluster_id IS NOT NULL").orderBy(F.desc("n")).first()
    own = clusters.leaves(levels, top.cluster_id, None).collect()
    assert len(own) == top.n and max(r.top for r in own) == top.top
    assert [r.idx for r in clusters.leaves(levels, top.cluster_id, 3, 2).collect()] == [r.idx for r in own][2:5]
    assert levels.where(F.col("cluster_id") == top.cluster_id).select(clusters.expansion_zoom(F.col("cluster_id"))).first()[0] == top.cluster_id % 32
    inside = [(r.x, r.y) for r in levels.where("zoom = 1").collect()]
    pad = clusters.RADIUS / clusters.EXTENT
    for x, y in ((0, 0), (1, 1)):
        near = sum(any((x - pad) / 2 <= px + s <= (x + 1 + pad) / 2 for s in (-1, 0, 1)) and (y - pad) / 2 <= py <= (y + 1 + pad) / 2 for px, py in inside)
        assert clusters.tile(levels, 1, x, y).count() == near
    told = clusters.described(levels, "top").where("cluster_id IS NOT NULL").select("n", "cluster_properties.*").first()
    assert told.cluster and told.point_count == told.n and told.point_count_abbreviated == str(told.n)


def test_tile_features_as_geojson(spark):
    outer, hole, second = [(0, 0), (100, 0), (100, 100), (0, 100)], [(20, 20), (20, 40), (40, 40), (40, 20)], [(200, 200), (300, 200), (300, 300)]
    value = lambda v: vector_tiles.block(4, v)
    import struct

    typed = [value(vector_tiles.block(1, b"Oslo")), value(bytes([3 << 3 | 1]) + struct.pack("<d", 1.5)), value(vector_tiles.number(7, 1)), value(vector_tiles.number(6, vector_tiles.zigzag(-3)))]
    feature = vector_tiles.number(1, 7) + vector_tiles.block(2, bytes([0, 0, 1, 1, 2, 2, 3, 3])) + vector_tiles.number(3, 3) + vector_tiles.block(4, vector_tiles.draw(3, [outer, hole, second]))
    layer = vector_tiles.number(15, 2) + vector_tiles.block(1, b"land") + vector_tiles.block(2, feature) + b"".join(vector_tiles.block(3, k) for k in (b"s", b"d", b"b", b"n")) + b"".join(typed)
    point = vector_tiles.encode_layer("p", 4096, [(None, 1, {}, [[(1024, 2048)]]), (None, 0, {}, [])])
    tiles = spark.createDataFrame([(0, 0, 0, vector_tiles.block(3, layer) + point)], "z int, x int, y int, data binary")
    made = {(r.layer, r.kind): json.loads(r.geojson) for r in vector_tiles.to_geojson(vector_tiles.read_tiles(tiles)).collect()}
    land = made["land", 3]
    assert land["id"] == 7 and land["properties"] == {"s": "Oslo", "d": 1.5, "b": True, "n": -3}
    assert land["geometry"]["type"] == "MultiPolygon" and [len(p) for p in land["geometry"]["coordinates"]] == [2, 1]
    assert made["p", 1]["geometry"] == {"type": "Point", "coordinates": [pytest.approx(-90), pytest.approx(0)]}
    assert made["p", 0]["geometry"] == {"type": "Point", "coordinates": [0, 0]}


def test_geojson_of_all_kinds(spark):
    shapes = [("Point", [1, 2]), ("MultiPoint", [[1, 2], [3, 4]]), ("LineString", [[1, 2], [3, 4]]), ("MultiLineString", [[[1, 2], [3, 4]]]), ("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]]]), ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]]])]
    whole = {"type": "GeometryCollection", "geometries": [{"type": k, "coordinates": c} for k, c in shapes]}
    docs = [json.dumps(whole), json.dumps({"type": "Feature", "id": 5, "properties": {"a": "b"}, "geometry": whole}), json.dumps([{"type": "Feature", "properties": None, "geometry": None}]), "nonsense", None, '{"type":"Oval","coordinates":[1]}']
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "doc int, text string")
    got = geojson.read_features(rows, "text").withColumn("parts", geojson.typed_parts(F.col("geometry_type"), F.col("coordinates"))).collect()
    assert [r.geometry_type for r in got if r.doc == 0] == [k for k, _ in shapes] and all(r.id == "5" and r.properties == {"a": "b"} for r in got if r.doc == 1)
    assert [[len(part) for part in r.parts] for r in got if r.doc == 0] == [[1], [1, 1], [2], [2], [4], [4]]
    assert [r.kind for r in got if r.doc == 5] == [None]
    with pytest.raises(Exception, match="Oval"):
        geojson.read_features(rows, "text", strict=True).collect()
    p = line((1, 2), (3, 4))
    none = F.create_map().cast("map<string,string>")
    made = one(spark, geojson.points_feature(p, none, F.lit(1)), geojson.lines_feature(F.array(p), none, F.lit(1)), geojson.polygons_feature(F.array(F.array(line((0, 0), (1, 0), (1, 1)))), none, F.lit(1)))
    assert [json.loads(x)["geometry"]["type"] for x in made] == ["MultiPoint", "MultiLineString", "MultiPolygon"] and len(json.loads(made[2])["geometry"]["coordinates"][0][0]) == 4
    ends = one(spark, geojson.coords_to_latlng(F.lit("[10,20,30]")), geojson.latlng_to_coords(geojson.coords_to_latlng(F.lit("[10.12345678,20]"))))
    assert tuple(ends[0]) == (20, 10, 30) and ends[1] == [10.123457, 20]
    some = spark.createDataFrame([(1, geojson_point(k)) for k in range(3)], "g int, f string")
    both = [geojson.collections(some, "f", "g", kind=k).first().document for k in ("FeatureCollection", "GeometryCollection")]
    assert len(json.loads(both[0])["features"]) == len(json.loads(both[1])["geometries"]) == 3


def geojson_point(k):
    return json.dumps({"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [k, k]}})


def test_elevation_parts(spark):
    pixels = bytes([0, 1, 0, 255, 1, 134, 160, 255])
    rows = spark.createDataFrame([(1, pixels), (2, None)], "k int, pixels binary")
    got = {r.k: r for r in rows.select("k", elevation.decode_grid(F.col("pixels")).alias("a"), elevation.decode_grid(F.col("pixels"), "fractions").alias("b")).collect()}
    assert got[1].a == pytest.approx([-9974.4, 0]) and got[1].b == pytest.approx([1 - 32768, 256 + 134 + 160 / 256 - 32768]) and got[2].a is None
    with pytest.raises(ValueError, match="mesh"):
        elevation.mesh_vertices(rows, 1)
    small = spark.createDataFrame([(0, 0, 0, [1.0])], "z int, x int, y int, grid array<double>")
    with pytest.raises(Exception, match="grid"):
        tables.checked_tiles(small, 2).collect()
    assert tables.terrain("dem", 2)["exaggeration"] == 2
    for bad in (("", 1), ("dem", -1), ("dem", float("nan"))):
        with pytest.raises(ValueError, match="terrain|exaggeration"):
            tables.terrain(*bad)


def test_views(spark):
    z = lambda t: camera.cubic_bezier(0.25, 0.1, 0.25, 1, F.lit(t))
    got = one(spark, z(0.5), z(0.0), z(2.0), camera.imperial_scale(F.lit(100.0)).label, camera.imperial_scale(F.lit(5000.0)).label, camera.pitched(geometry.point(3, 4), F.lit(0), 600.0))
    assert got[0] == pytest.approx(0.802, abs=1e-3) and got[1:3] == (0, 1) and got[3:5] == ("300 ft", "3 mi") and tuple(got[5]) == (3, 4)
    with pytest.raises(ValueError, match="easing"):
        camera.eased("inFoo", F.lit(0))
    words = one(spark, text.filled("{a}-{b}", {"a": F.lit(1), "b": F.lit("x")}), text.is_flat(F.lit("[[1,2],[3,4]]")), text.is_flat(F.lit("[[[1,2]]]")), text.decoded_polyline(F.lit("")), text.decoded_polyline(F.lit(None).cast("string")))
    assert words[0] == "1-x" and words[1] and not words[2] and words[3] == words[4] == []
    with pytest.raises(ValueError, match="value"):
        text.filled("{c}", {})


def test_what_a_style_draws(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 0.0)], "id int, h double")
    from tilewright.functions.expressions import Scope

    layer = {"id": "x", "paint": {"fill-extrusion-height": ["get", "h"]}}
    assert [r.height for r in spatial.extruded(rows, layer, Scope.of(rows, ["h"]), 2.0).collect()] == [10.0]
    doc = json.dumps({"version": 8, "sources": {}, "layers": [{"id": "a", "type": "background"}, {"id": "b", "type": "background", "layout": {"visibility": "none"}}, {"id": "c", "type": "background", "minzoom": 6}]})
    layers = styles.layers_of(spark.createDataFrame([(1, doc)], "k int, doc string"), "k", "doc")
    assert [r.id for r in styles.drawn_at(layers, 5).orderBy("position").collect()] == ["a"]
    assert [r.id for r in styles.without_layer(layers, "a").orderBy("position").collect()] == ["b", "c"]
    bad = spark.createDataFrame([(1, "[]"), (2, None), (3, "{}"), (4, '{"version":8,"sources":[],"layers":{},"center":[1],"sprite":3}')], "k int, doc string")
    found = {}
    for r in styles.style_issues(bad, "k", "doc").collect():
        found.setdefault(r.k, set()).add(r.path)
    assert found == {1: {""}, 2: {""}, 3: {"version", "sources", "layers"}, 4: {"sources", "layers", "center", "sprite"}}


def test_collections(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "url string, n int")
    assert tables.cleared(rows).count() == 0 and tables.sized(rows).first().entries == 2
    gone = spark.createDataFrame([("B",)], "other string")
    assert [r.url for r in tables.removed(rows, gone, same=F.upper("url") == F.col("other")).collect()] == ["a"]
    cache = spark.createDataFrame([("a", "old", "t", 0)], "url string, data string, mime string, added_at long")
    fetched = spark.createDataFrame([("a", "new", "t"), ("b", "new", "t")], "url string, data string, mime string")
    read = lambda **b: {r.url: (r.data, r.from_cache) for r in tables.read_through(rows, cache, fetched, F.lit(10), **b).collect()}
    assert read() == {"a": ("old", True), "b": ("new", False)}
    assert read(ttl=5)["a"] == ("new", False) and read(force=True)["a"] == ("new", False)
    services.register("places", "own", lambda df, column: df.select(F.upper(column).alias("text")))
    assert services.read("places", rows, "url", "own").first().text == "A"
