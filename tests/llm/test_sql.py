"""Every text query with SQL gives the rows DuckDB gives for it."""

import duckdb
import pytest

from flowlucid.llm.queries import text_queries
from flowlucid.llm.sql import text_sql

from ..conftest import SMALL
from ..test_oracle import normal


@pytest.mark.parametrize("name", sorted(text_sql()))
def test_text_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = text_queries()[name](spark, SMALL)
    expected = con.execute(text_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(got.columns) == sorted(columns)
    assert normal(got.collect(), got.columns) == normal(expected.fetchall(), columns)
