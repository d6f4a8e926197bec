"""Queries against their SQL twins on small tables of special shape."""

import duckdb
import pytest

from railweave import catalog


@pytest.mark.parametrize("step", [1, 50])
def test_barrier_with_regions_missing_and_with_none(spark, tmp_path, step):
    con = duckdb.connect()
    tables = {
        "region": "SELECT range AS r_regionkey, 'R' || range AS r_name FROM range(3)",
        "nation": "SELECT range AS n_nationkey, 'N' || range AS n_name, range AS n_regionkey FROM range(3)",
        "supplier": f"SELECT range * {step} AS s_suppkey, 'S' || range AS s_name, range AS s_nationkey FROM range(3)",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["b17_barrier_waiting"](spark, str(tmp_path)).collect()]
    assert got == con.execute(catalog.SQL["b17_barrier_waiting"]).fetchall() == [("R1,R2", False) if step == 1 else ("", True)]
