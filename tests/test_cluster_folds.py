"""Values of clusters put together by a function that minds the order; leaves at any depth."""

import random

from pyspark.sql import functions as F

from tilewright.operators import clusters


def points(spark, n):
    rng = random.Random(n)
    rows = [(k, rng.uniform(-170, 170) if k % 3 else rng.uniform(10, 11), rng.uniform(-60, 60) if k % 3 else rng.uniform(5, 6), f"{k},") for k in range(n)]
    return spark.createDataFrame(rows, "k long, lng double, lat double, name string")


def test_folds_take_members_in_order(spark):
    join = lambda a, b: {"names": a["names"] + b["names"], "last": b["last"]}  # noqa: E731  associative, not commutative
    value = F.struct(F.col("name").alias("names"), F.col("k").alias("last"))
    levels = clusters.cluster(points(spark, 90), "k", max_zoom=3, folded={"put": (value, join)}, sums={"ks": F.col("k")}).collect()
    members = {}
    for r in levels:
        if r.parent is not None and r.zoom == r.parent % 32:
            members.setdefault(r.parent, []).append(r)
    made = [r for r in levels if r.cluster_id is not None]
    assert len(members) > 10
    for r in made:
        own = sorted(members[r.cluster_id], key=lambda m: (m.idx != r.cluster_id // 32, m.idx))
        assert r.put.names == "".join(m.put.names for m in own) and r.put["last"] == own[-1].put["last"]
        assert r.ks == sum(m.ks for m in own)


def test_a_large_group_is_put_together_from_stretches(spark):
    rows = spark.range(5000).select((F.col("id") % 7 == 0).cast("int").alias("g"), F.col("id").alias("at"), F.col("id").cast("string").alias("v"))
    got = {r.g: r.v for r in clusters.reduced_in_order(rows.repartition(5), "g", ["at"], "v", lambda a, b: f"{a} {b}").collect()}
    assert got == {g: " ".join(str(k) for k in range(5000) if (k % 7 == 0) == g) for g in (0, 1)}
    empty = clusters.reduced_in_order(rows.where("false"), "g", ["at"], "v", lambda a, b: a)
    assert empty.collect() == []


def test_leaves_of_many_clusters(spark):
    levels = clusters.cluster(points(spark, 70), "k", max_zoom=4).cache()
    wanted = levels.where("cluster_id IS NOT NULL").select("cluster_id").distinct()
    got = {}
    for r in clusters.all_leaves(levels, wanted).collect():
        got.setdefault(r.of_cluster, set()).add(r.idx)
    sizes = {r.cluster_id: r.n for r in levels.where("cluster_id IS NOT NULL").collect()}
    assert {c: len(v) for c, v in got.items()} == sizes and len(sizes) > 10
    assert max(sizes.values()) > 20
