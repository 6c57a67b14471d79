"""Corpus queries that SQL can express, against DuckDB on the given tables; the others run over them."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import DATA, connect, same

from tracklake.llm import queries, sql

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_same_as_duckdb(spark, name):
    same(queries.QUERIES[name](spark, DATA), connect(), sql.ORACLES[name])


#: What a query has a row for, where it is not a document.
OF = {"op12_url_filters": ("pages", "page_id"), "op13_conversation_repair": ("conversations", "conv_id")}


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - sql.ORACLES.keys()))
def test_one_row_each(spark, name):
    table, key = OF.get(name, ("documents", "doc_id"))
    assert queries.QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").select(key).distinct().count()
