"""Every query with SQL of its own, against DuckDB."""

import os
import sys

import duckdb
import pytest

import __spark_entry__
from siltstone.plans import catalog

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DIR), duck.sql(catalog.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r) for r in got.select(*columns).collect()) == order(duck.sql(f"SELECT {', '.join(columns)} FROM want").fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "n_chars", "text"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_training_data(monkeypatch):
    """Whatever keeps the training-data operators from being imported, the store's queries stay."""
    monkeypatch.setitem(sys.modules, "siltstone.llm", None)
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES) == set(__spark_entry__.oracle_sql())
