"""Queries take whole tables: their rows are those of the SQL, and no key is left out."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_features import greedy

from tilewright import catalog
from tilewright.operators import clusters
from tilewright.sources.views import CLUMP, event_clumps

SF = "/root/testdata/sf0.001"


def sql(text):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con.execute(text).fetchall()


def rows(spark, name):
    return sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()))


def test_tile_cover_takes_all_customers(spark):
    got = rows(spark, "tile_cover")
    assert got == sorted(sql(catalog.ORACLES["tile_cover"]))
    assert {r[0] for r in got} == {r[0] for r in sql("SELECT c_custkey FROM customer")}


def test_clusters_take_all_events_at_all_zooms(spark, monkeypatch):
    real, calls = clusters.cluster, []
    monkeypatch.setattr(clusters, "cluster", lambda points, *a, **b: calls.append((points, b)) or real(points.limit(0), *a, max_zoom=0))
    catalog.QUERIES["cluster_conservation"](spark, SF)
    monkeypatch.undo()
    assert sql(catalog.ORACLES["cluster_conservation"] + " ORDER BY 1") == [(z, 1000) for z in range(clusters.MAX_ZOOM + 2)]
    levels = [(r.zoom, r.idx, r.x, r.y, r.n) for r in catalog.QUERIES["cluster_levels"](spark, SF).collect()]
    [(points, options)] = calls
    assert points.count() == 1000 and not {"max_zoom", "min_zoom"} & set(options)
    x, y = clusters.unit_mercator(F.col("lng"), F.col("lat"))
    points = [tuple(r) for r in event_clumps(spark, SF).select("event_id", x, y).orderBy("event_id").collect()]
    for z, want in greedy(points, clusters.RADIUS, [*range(16, -1, -1)], 2).items():
        got = sorted(r[1:] for r in levels if r[0] == z)
        assert [(g[0], g[3]) for g in got] == [(w[0], w[3]) for w in want]
        assert [v for g in got for v in g[1:3]] == pytest.approx([v for w in want for v in w[1:3]])


@pytest.mark.parametrize("name", ["dem_pyramid_lookup", "line_gradient", "heat_density", "radius_join"])
def test_all_events_take_part(spark, name):
    assert rows(spark, name) == sorted(sql(catalog.ORACLES[name]))
    if name == "radius_join":
        spots = sql(f"SELECT event_id, lng, lat FROM ({CLUMP})")
        assert {r[:2] for r in rows(spark, name)} == {(a, b) for a, x, y in spots for b, u, v in spots if a < b and (x - u) * (x - u) + (y - v) * (y - v) <= 0.0025}
    elif name == "heat_density":
        near = {(i, j) for i in range(-4, 5) for j in range(-4, 5) if i * i + j * j < 16}
        assert {r[:2] for r in rows(spark, name)} == {(k * 37 % 256 + i, k * 53 % 256 + j) for (k,) in sql("SELECT event_id FROM events") for i, j in near}
    else:
        assert [r[0] for r in rows(spark, name)] == [r[0] for r in sql("SELECT event_id FROM events ORDER BY 1")]


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    for before in ("", "import sys; sys.modules['tilewright.llm'] = None; "):
        code = before + "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 150)"
        done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True)
        assert done.stdout.strip() == "True", done.stderr
