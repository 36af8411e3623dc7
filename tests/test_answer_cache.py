"""Captured answers as a data source: parts, pushed conditions, what counts after failures."""

import datetime

import pytest
from pyspark.sql import functions as F

from tilewright.operators import tables
from tilewright.sources import answer_cache


def rows(spark, items):
    base = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(u, bytearray(d), m, base + datetime.timedelta(seconds=t)) for u, d, m, t in items], "url string, data binary, mime string, added_at timestamp")


def put(df, path, mode="append", **options):
    df.write.format("answer_cache").option("path", path).options(**options).mode(mode).save()


def get(spark, path):
    return spark.read.format("answer_cache").option("path", path).load()


def test_entries_come_back_the_last_of_each_url(spark, tmp_path):
    answer_cache.register(spark)
    path = f"file://{tmp_path}/cache"
    assert get(spark, path).count() == 0
    items = [(f"u{k}", b"d%d" % k, "image/png", k) for k in range(60)]
    put(rows(spark, items).repartition(3), path, parts=8)
    put(rows(spark, [("u3", b"new", "text/x", 100), ("u4", b"old", "text/x", -5), (None, b"n", None, 0), ("é", b"", None, 1)]), path, parts=99)
    want = {u: (d, m) for u, d, m, _ in items} | {"u3": (b"new", "text/x"), None: (b"n", None), "é": (b"", None)}
    assert {r.url: (bytes(r.data), r.mime) for r in get(spark, path).collect()} == want
    assert answer_cache.manifest_of(path)["parts"] == 8 and answer_cache.manifest_of(path)["version"] == 2
    put(rows(spark, [("z", b"1", "m", 0)]), path, "overwrite")
    assert [r.url for r in get(spark, path).collect()] == ["z"]


def test_conditions_choose_parts(spark, tmp_path):
    answer_cache.register(spark)
    path = str(tmp_path / "cache")
    put(rows(spark, [(f"u{k}", b"x", "m", k) for k in range(200)]), path, parts=16)
    one = get(spark, path).where("url = 'u7' AND mime = 'm'")
    assert one.rdd.getNumPartitions() == 1 and [r.url for r in one.collect()] == ["u7"]
    some = get(spark, path).where(F.col("url").isin("u1", "u2", "gone"))
    assert some.rdd.getNumPartitions() <= 3 and sorted(r.url for r in some.collect()) == ["u1", "u2"]
    assert get(spark, path).rdd.getNumPartitions() == 16
    assert get(spark, path).where("url = 'u1' AND url = 'u2'").count() == 0


def test_failed_writes_leave_nothing(spark, tmp_path):
    answer_cache.register(spark)
    path = str(tmp_path / "cache")
    put(rows(spark, [("a", b"1", "m", 0)]), path)
    bad = rows(spark, [("b", b"2", "m", 0), ("c", b"3", "m", 0)]).withColumn("mime", F.when(F.col("url") == "c", F.raise_error(F.lit("no"))).otherwise(F.col("mime")))
    with pytest.raises(Exception):
        put(bad, path)
    assert [r.url for r in get(spark, path).collect()] == ["a"] and answer_cache.manifest_of(path)["version"] == 1


def test_it_stands_behind_requests(spark, tmp_path):
    answer_cache.register(spark)
    path = str(tmp_path / "cache")
    put(rows(spark, [("a", b"kept", "m", 0), ("b", b"stale", "m", -500)]), path)
    cache = get(spark, path).withColumn("added_at", F.unix_seconds("added_at"))
    fetched = spark.createDataFrame([("b", bytearray(b"new"), "m"), ("c", bytearray(b"c"), "m")], "url string, data binary, mime string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string")
    now = F.lit(int(datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).timestamp()) + 10)
    got = {r.url: (r.data and bytes(r.data), r.from_cache) for r in tables.read_through(asked, cache, fetched, now, ttl=60).collect()}
    assert got == {"a": (b"kept", True), "b": (b"new", False), "c": (b"c", False), "d": (None, None)}
