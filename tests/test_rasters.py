"""Pictures as sources: written, pruned, decoded and looked up."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import elevation
from tilewright.sources import rasters


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_pictures_go_there_and_back(spark, tmp_path, channels):
    rng = np.random.default_rng(channels)
    pixels = {(z, x, y): rng.integers(0, 256, 5 * 4 * channels, np.uint8).tobytes() for z, x, y in [(0, 0, 0), (2, 1, 3), (2, 3, 1), (2, 3, 2)]}
    tiles = spark.createDataFrame([(*k, bytearray(p)) for k, p in pixels.items()] + [(5, 0, 0, None)], "z int, x int, y int, pixels binary")
    index = rasters.write_pictures(tiles.repartition(3), str(tmp_path), 5, channels).collect()
    assert {(r.z, r.x, r.y) for r in index} == set(pixels) and all(r.bytes > 50 for r in index)
    for named in (True, False):
        got = rasters.read_pictures(spark, str(tmp_path), named=True) if named else rasters.read_pictures(spark, _plain(tmp_path, channels), [0, 2], named=False)
        for r in got.collect():
            data = np.frombuffer(r.data, np.uint8).reshape(-1, channels)
            order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[channels]
            assert (r.width, r.height, r.channels) == (5, 4, channels)
            assert data[:, order].tobytes() == pixels[r.z, r.x, r.y]
        assert got.count() == 4


def _plain(home, channels):
    import shutil

    base = home.parent / f"plain-{channels}"
    for file in home.glob("z=*/x=*/*.png"):
        to = base / file.parent.parent.name[2:] / file.parent.name[2:]
        to.mkdir(parents=True, exist_ok=True)
        shutil.copy(file, to / file.name)
    (base / "7" / "1").mkdir(parents=True, exist_ok=True)
    (base / "7" / "1" / "1.png").write_bytes(b"not asked for")
    return str(base)


@pytest.mark.parametrize(("encoding", "step"), [("tenths", 0.1), ("fractions", 1 / 256)])
def test_heights_keep_to_a_step(spark, tmp_path, encoding, step):
    rng = random.Random(3)
    grids = {x: [rng.uniform(-9000, 9000) for _ in range(16)] for x in range(6)}
    tiles = spark.createDataFrame([*grids.items()], "x int, grid array<double>").withColumns({"z": F.lit(1), "y": F.lit(0), "pixels": rasters.encode_heights(F.col("grid"), encoding)})
    rasters.write_pictures(tiles, str(tmp_path), 4).collect()
    got = rasters.picture_heights(rasters.read_pictures(spark, str(tmp_path)), encoding).collect()
    assert {r.x for r in got} == set(grids) and {r["size"] for r in got} == {4}
    for r in got:
        assert max(abs(a - b) for a, b in zip(r.grid, grids[r.x], strict=True)) <= step / 2 + 1e-9
    for bad in (lambda: rasters.encode_heights(F.col("grid"), "other"), lambda: rasters.picture_heights(tiles, "other")):
        with pytest.raises(ValueError):
            bad()


def test_folders_are_pruned_and_bad_files_told(spark, tmp_path):
    pixels = bytearray(bytes(2 * 2 * 3))
    rasters.write_pictures(spark.createDataFrame([(z, x, 0, pixels) for z in range(3) for x in range(2)], "z int, x int, y int, pixels binary"), str(tmp_path), 2).collect()
    (tmp_path / "z=2" / "x=1" / "9.png").write_bytes(b"no picture")
    found = rasters.read_pictures(spark, str(tmp_path))
    assert {(r.z, r.y) for r in found.where("data IS NULL").collect()} == {(2, 9)}
    assert rasters.picture_heights(found).count() == 6
    for file in tmp_path.glob("z=0/x=*/*.png"):
        file.chmod(0o600)
    some = rasters.read_pictures(spark, str(tmp_path), [1]).where("x = 1")
    text = plan(some)
    assert "PartitionFilters: [" in text and "z#" in text.split("PartitionFilters")[1] and "x#" in text.split("PartitionFilters")[1]
    scan = some.inputFiles() if some.count() == 1 else []
    assert len(scan) >= 1 and some.first().z == 1


def test_pictures_answer_lookups(spark, tmp_path):
    grid = [float(10 * (k % 4)) for k in range(16)]
    tiles = spark.createDataFrame([(1, 1, 0, grid)], "z int, x int, y int, grid array<double>").withColumn("pixels", rasters.encode_heights(F.col("grid")))
    rasters.write_pictures(tiles, str(tmp_path), 4).collect()
    heights = rasters.picture_heights(rasters.read_pictures(spark, str(tmp_path)))
    points = spark.createDataFrame([(90.0, 45.0), (-90.0, 45.0)], "lng double, lat double")
    got = {r.lng: r.elevation for r in elevation.query_elevation(points, heights, 4, 6).collect()}
    assert got[-90.0] is None and abs(got[90.0] - 20) < 1e-6


def test_covering_takes_the_deepest(spark):
    have = spark.createDataFrame([(0, 0, 0), (2, 1, 1), (4, 5, 5)], "z int, x int, y int")
    wanted = spark.createDataFrame([(4, 5, 5), (4, 6, 5), (4, 0, 0), (1, 1, 1)], "z int, x int, y int").withColumn("share", F.lit("clash")).drop("share")
    got = {(r.z, r.x): (r.of_z, r.left, r.top, r.share) for r in rasters.covering(wanted, have, 4).collect()}
    assert got == {(4, 5): (4, 0.0, 0.0, 1.0), (4, 6): (2, 0.5, 0.25, 0.25), (4, 0): (0, 0.0, 0.0, 0.0625), (1, 1): (0, 0.5, 0.5, 0.5)}
    assert rasters.covering(wanted, have.where("z = 4"), 3).where("of_z IS NOT NULL").count() == 0


def test_tiles_keep_kinds_of_properties(spark):
    import json
    import struct

    from tilewright.sources import vector_tiles

    told = {"a": 1, "b": -7, "c": 0.5, "d": 0.1, "e": True, "f": False, "g": "é", "h": [1, 2], "i": 2**63, "j": -(2**63), "k": 2**70, "l": 1.0, "m": None, "n": 0, "o": "1"}
    rows = [(0, 0, 0, "l", 1, 1, json.dumps(told), [[(3, -4)]]), (0, 0, 0, "l", 2, 2, None, [[(0, 0), (5, 5)], [(1, 1), (2, 2)]]), (0, 0, 0, "m", None, 1, "{}", [])]
    features = spark.createDataFrame(rows, "z int, x int, y int, layer string, id long, kind int, typed string, parts array<array<struct<x:int,y:int>>>")
    got = {(r.layer, r.id): r for r in vector_tiles.read_tiles(vector_tiles.write_tiles(features)).collect()}
    back = json.loads(got["l", 1].typed)
    want = told | {"h": "[1, 2]", "k": str(2**70)}
    del want["m"]
    assert back == {**want} and {k: type(v) for k, v in back.items()} == {k: type(v) for k, v in want.items()}
    assert [[tuple(p) for p in part] for part in got["l", 2].parts] == [[(0, 0), (5, 5)], [(1, 1), (2, 2)]] and got["l", 2].properties == {}
    assert got["m", None].parts == [] and all(r.error is None for r in got.values())
    assert len(vector_tiles.value_bytes(0.5)) == 5 and len(vector_tiles.value_bytes(0.1)) == 9 and struct.unpack("<f", vector_tiles.value_bytes(0.5)[1:])[0] == 0.5


def test_collections_within_collections_are_opened(spark):
    import json

    from tilewright.sources import geojson

    point = lambda x: {"type": "Point", "coordinates": [x, 0]}
    deep = {"type": "GeometryCollection", "geometries": [point(9)]}
    for k in range(10):
        deep = {"type": "GeometryCollection", "geometries": [point(k), deep, {"type": "LineString", "coordinates": [[k, 0], [1, 1]]}]}
    docs = [json.dumps({"type": "Feature", "id": "a", "properties": {"p": 1}, "geometry": deep}), json.dumps(deep), json.dumps({"type": "GeometryCollection", "geometries": []}), json.dumps(point(3))]
    got = geojson.read_features(spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, doc string"), "doc").collect()
    of = {k: [r for r in got if r.k == k] for k in range(4)}
    want = sorted(["[9,0]", *[f"[{k},0]" for k in range(10)], *[f"[[{k},0],[1,1]]" for k in range(10)]])
    for k in (0, 1):
        assert sorted(r.coordinates.replace(" ", "") for r in of[k]) == want and {r.kind for r in of[k]} == {1, 2}
    assert {r.id for r in of[0]} == {"a"} and of[2] == [] and [r.geometry_type for r in of[3]] == ["Point"]
