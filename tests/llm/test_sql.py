"""The operators' queries against their DuckDB SQL, on the smallest data."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    out = queries.queries()[name](spark, SF)
    columns = sorted(out.columns)
    assert columns == sorted(want.columns)
    got = sorted(tuple(map(str, r)) for r in out.select(*columns).collect())
    assert got == sorted(tuple("None" if v is None or v != v else str(v) for v in r) for r in want[columns].itertuples(index=False))
