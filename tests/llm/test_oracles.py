"""Every query of this subpackage that has SQL, next to that SQL in DuckDB."""

import duckdb
import pytest

from chorus.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    exact = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(exact, got.select(columns).collect()), key=str) == sorted(map(exact, want), key=str)
