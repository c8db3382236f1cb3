"""Every registered query against its DuckDB statement."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract
from nearfield.plans import oracles, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.registered(), oracles.statements()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return con


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).columns == ["q", "rank", "id", "dist"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    got, want = (df[cols].sort_values(cols).reset_index(drop=True) for df in (got, want))
    for c in cols:
        a, b = got[c].to_numpy(), want[c].to_numpy()
        assert np.allclose(a, b, atol=1e-9) if a.dtype == float else (a == b).all(), c
