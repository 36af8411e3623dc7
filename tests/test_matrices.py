"""Matrices of services against the SQL of their query."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tilewright import catalog


def test_matrices_of_any_key_are_those_of_the_sql(spark, tmp_path):
    keys = [None, 0, 1, -7, 7, 7, 10**7, 10**15 + 1, 2**53 + 1, 2**62 + 12345, 2**63 - 1]
    pq.write_table(pa.table({"c_custkey": pa.array(keys, pa.int64())}), tmp_path / "customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    got, want = catalog.QUERIES["travel_matrices"](spark, str(tmp_path)).collect(), con.execute(catalog.ORACLES["travel_matrices"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) == 33
