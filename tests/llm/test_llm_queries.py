"""Queries that SQL expresses, against DuckDB."""

import pytest

from pagelode.llm import queries
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, agree, name):
    agree(queries.QUERIES[name](spark, SF), duck.execute(queries.ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    key = "vec_id" if name.startswith("op8") else "doc_id"
    table = "embeddings" if key == "vec_id" else "documents"
    frame = queries.QUERIES[name](spark, SF)
    assert key in frame.columns
    assert frame.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
