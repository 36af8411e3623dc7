"""Boxes in files: searches open only files that meet, and give what all comparisons give."""

import random

from pyspark.sql import functions as F

from tilewright.operators.box_store import BoxStore, cells

BOX = "id long, minx double, miny double, maxx double, maxy double"


def some(rng, ids):
    out = []
    for k in ids:
        x, y = rng.uniform(0, 1000), rng.uniform(0, 500)
        out.append((k, x, y, x + rng.uniform(0, 20), y + rng.uniform(0, 9)))
    return out


def meeting(rows, w, s, e, n):
    return {r[0] for r in rows if r[1] <= e and r[3] >= w and r[2] <= n and r[4] >= s}


def test_cells_are_even(spark):
    rows = some(random.Random(1), range(3000))
    sizes = [r["count"] for r in cells(spark.createDataFrame(rows, BOX), 100).groupBy("strip", "row").count().collect()]
    assert 28 <= len(sizes) <= 36 and max(sizes) <= 130 and sum(sizes) == 3000
    assert [r["count"] for r in cells(spark.createDataFrame(rows[:40], BOX), 100).groupBy("strip", "row").count().collect()] == [40]


def test_searches_open_few_files(spark, tmp_path):
    rng = random.Random(2)
    rows = some(rng, range(2000))
    store = BoxStore(spark, str(tmp_path), per_file=50)
    assert store.search(0, 0, 9, 9) is None and store.all() is None
    store.insert(spark.createDataFrame([*rows, (9999, None, 1.0, 2.0, 3.0)], BOX))
    total = store.manifest().count()
    assert total >= 40 and store.manifest().agg(F.sum("n")).first()[0] == 2000
    for _ in range(8):
        w, s = rng.uniform(0, 950), rng.uniform(0, 450)
        found = store.search(w, s, w + 40, s + 30)
        assert {r.id for r in found.collect()} == meeting(rows, w, s, w + 40, s + 30)
        assert len(found.inputFiles()) <= total / 4
    assert store.search(5000, 0, 6000, 10) is None
    asked = spark.createDataFrame([(1, 100.0, 100.0, 130.0, 120.0), (2, 105.0, 90.0, 110.0, 101.0)], BOX)
    pairs = store.search_many(asked, 50.0)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, k) for k in meeting(rows, 100, 100, 130, 120)} | {(2, k) for k in meeting(rows, 105, 90, 110, 101)}
    assert len(pairs.inputFiles()) <= total / 4 + 1


def test_inserts_removals_and_merges(spark, tmp_path):
    rng = random.Random(3)
    first, second = some(rng, range(300)), some(rng, range(300, 420))
    store = BoxStore(spark, str(tmp_path), per_file=30)
    store.insert(spark.createDataFrame(first, BOX))
    before = set(store.files())
    store.insert(spark.createDataFrame(second, BOX))
    assert before < set(store.files()) and store.manifest().select("layout").distinct().count() == 2
    far = max(first, key=lambda r: r[1])[0]
    store.remove(spark.createDataFrame([(far,), (-5,)], "id long"))
    assert len(before - set(store.files())) == 1  # one file is rewritten
    want = {r[0] for r in first + second} - {far}
    assert {r.id for r in store.all().collect()} == want
    store.merge()
    assert store.manifest().select("layout").distinct().count() == 1 and {r.id for r in store.all().collect()} == want
    assert {r.id for r in store.search(0, 0, 300, 300).collect()} == meeting([r for r in first + second if r[0] != far], 0, 0, 300, 300)
    store.remove(spark.createDataFrame([(k,) for k in want], "id long"))
    assert store.all() is None
