"""Hits of crowded places, whole: against the SQL of the queries over small tables of their own."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tilewright import catalog
from tilewright.streaming import events

SHAPES = "id int, kind int, parts array<array<struct<x:double,y:double>>>"


def tables(folder, clicks=(), parts=(), customers=(), suppliers=()):
    """The tables that clicks and their features come from, with these keys."""
    keys = lambda name, ids: (name, pa.array([*ids], pa.int64()))
    made = {
        "events": [keys("event_id", clicks), ("event_type", pa.array(["click"] * len(clicks), pa.string()))],
        "part": [keys("p_partkey", [k for k, _ in parts]), ("p_brand", pa.array(["b"] * len(parts), pa.string())), ("p_size", pa.array([s for _, s in parts], pa.int32()))],
        "customer": [keys("c_custkey", customers)], "supplier": [keys("s_suppkey", suppliers)],
    }
    for name, columns in made.items():
        pq.write_table(pa.table(dict(columns)), folder / f"{name}.parquet")
    return str(folder)


def same(spark, name, folder):
    """Whether a query gives the rows of its SQL, and how many there are."""
    con = duckdb.connect()
    for t in ("events", "part", "customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = sorted(con.execute(catalog.ORACLES[name]).fetchall())
    return sorted(map(tuple, catalog.QUERIES[name](spark, folder).collect())) == want, len(want)


def test_an_event_has_all_its_hits(spark, tmp_path):
    ring = [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)]]
    shapes = spark.createDataFrame([(k, 3, ring) for k in range(1500)], SHAPES)
    spots = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 5.0), (3, 50.0, 5.0), (4, None, 5.0)], "event_id int, x double, y double")
    told = {r.event_id: r for r in events.with_hits(spots, shapes).collect()}
    assert told.keys() == {1, 2} and all((r.n_hits, r.features) == (1500, [*range(1500)]) and (r.first, r.last) == (0, 1499) for r in told.values())
    assert [len(r.features) for r in events.with_hits(spots, shapes, most=3).collect()] == [3, 3]
    folder = tables(tmp_path, clicks=[0, 4096, 7, 7, 5], parts=[(7, 20), (9, 50)], customers=range(300), suppliers=[k * 4096 for k in range(1200)])
    assert same(spark, "layer_events", folder) == (True, 3)


def test_pairs_at_the_very_edge_are_those_of_the_sql(spark, tmp_path):
    folder = tables(tmp_path, clicks=range(4096), customers=[435160, 670640, 535580, 654400])  # lines of slopes 3:4 and 5:12
    assert same(spark, "layer_events", folder)[0]


def test_a_stream_of_crowded_places_is_kept_in_blocks(spark, tmp_path, monkeypatch):
    folder = tables(tmp_path, clicks=[*range(0, 300 * 4096, 4096), 7, 9, 9], parts=[(7, 20), (9, 50)], customers=range(50), suppliers=[k * 4096 for k in range(1200)])
    kept, real = [], events.pairs
    monkeypatch.setattr(events, "pairs", lambda blocks: kept.append(blocks) or real(blocks))
    equal, n = same(spark, "stream_layer_events", folder)
    assert equal and n >= 300 * 1200
    [blocks] = kept
    rows = blocks.selectExpr("size(places) AS p", "size(features) AS f").collect()
    assert max(r.p for r in rows) <= 100 and max(r.f for r in rows) <= 1000 and len(rows) < 30


def test_a_stream_without_clicks_gives_no_rows(spark, tmp_path):
    assert same(spark, "stream_layer_events", tables(tmp_path, suppliers=[0])) == (True, 0)
