import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import bloom, components
from tilewright.llm.components import connected_components
from tilewright.llm.exact_dedup import exact_dedup, merge_round
from tilewright.llm.line_dedup import line_dedup


def test_exact_dedup_keeps_one_of_each_text(spark, docs, texts, empty):
    groups = defaultdict(list)
    for k, x in texts:
        groups[x or ""].append(k)
    for keep, best in (("smallest", min), ("largest", max)):
        got = {r["doc_id"]: r for r in exact_dedup(docs, keep=keep).collect()}
        assert len(got) == len(texts)
        for k, x in texts:
            own = groups[x or ""]
            r = got[k]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (best(own), len(own), k == best(own))
            assert r["text_sha256"] == hashlib.sha256((x or "").encode()).hexdigest()
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_with_nulls_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup(rows).collect())
    assert got == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


def test_exact_dedup_over_many_runs(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', concat('t', id % 700)) AS text").repartition(40)
    got = exact_dedup(rows).where("kept").count()
    assert got == 1 + len({k % 700 for k in range(4000) if k % 3})


def test_exact_dedup_merges_sorted_runs(spark):
    """A round sorts once and merges by a window; the optimizer puts no aggregate in its place."""
    runs = spark.range(100).selectExpr("CAST(id % 4 AS INT) AS node", "unhex(sha2(CAST(id % 30 AS STRING), 256)) AS digest", "3 AS n_bytes", "id % 30 AS second", "id AS keep_id", "1L AS group_size")
    runs = runs.groupBy("node", "digest", "n_bytes", "second").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    level = merge_round(merge_round(runs, "largest"), "largest")
    assert {(r["second"], r["keep_id"], r["group_size"]) for r in level.collect()} == {(k, k + 90 if k < 10 else k + 60, 4 if k < 10 else 3) for k in range(30)}
    plan = level._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("HashAggregate")]  # of the runs themselves
    assert above.count("Window ") == above.count("Sort ") == 2


def brute_lines(texts, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for k, x in texts:
        for line in (x or "").split("\n"):
            held[key(line)].add(k)
    out = {}
    for k, x in texts:
        lines = (x or "").split("\n")
        kept = [y for y in lines if len(key(y)) < least or len(held[key(y)]) < 2 or min(held[key(y)]) == k]
        out[k] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_line_dedup(docs, texts, empty):
    done = line_dedup(docs)
    assert done.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in done.collect()} == brute_lines(texts)
    assert line_dedup(empty).count() == 0


def test_line_dedup_with_null_and_repeated_identifiers(spark):
    line = "one line of enough length"
    rows = spark.createDataFrame([(None, line), (3, line), (3, line), (2, line + "\n" + line)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_dropped"]) for r in line_dedup(rows).collect())
    assert got == [(0, 0), (2, 0), (3, 1), (3, 1)]


def test_twice_seen_filter_has_no_false_negatives(spark):
    import pandas as pd

    random = np.random.default_rng(0)
    hashes = random.integers(0, 2**63, 4000).astype(np.uint64)
    rows = np.concatenate([hashes, hashes[:500], hashes[:200]])
    frame = spark.createDataFrame(pd.DataFrame({"h": rows.view(np.int64)})).repartition(5)
    bits = bloom.bits_for(len(rows))

    def fill(batches):
        seen = bloom.SeenTwice(bits)
        for batch in batches:
            seen.add(batch["h"].to_numpy().view(np.uint64))
        yield pd.DataFrame(seen.segments(), columns=["segment", "once", "twice"])

    twice = bloom.twice_seen(frame.mapInPandas(fill, "segment long, once binary, twice binary"), bits)
    hit = bloom.holds(twice, bloom.probes(hashes, bits))
    assert hit[:500].all()
    assert hit[500:].mean() < 0.05


@pytest.mark.parametrize("at_once", [components.TASK_EDGES, 0])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "TASK_EDGES", at_once)
    random = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, k) == top(k) for k in root)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_over_ranges_of_hashes_and_at_the_least_length(spark, monkeypatch):
    monkeypatch.setattr(bloom, "ranges_for", lambda n, each=24: 3)
    texts = [(k, "\n".join(f"line number {j}" for j in range(k % 7, k % 7 + 9)) + "\n" + x) for k, x in enumerate(["ééééééééé", "éééééééééé", "ééééééééé ", "éééééééééé\t"] * 10)]
    done = line_dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in done.collect()} == brute_lines(texts)
