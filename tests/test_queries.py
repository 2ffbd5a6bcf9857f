"""Every registered query of the engine against its oracle SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from twinweave.plans.registry import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert df.columns
        return
    cursor = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = [df.columns.index(c) for c in columns]
    assert sorted((tuple(r[i] for i in order) for r in got), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_entry_imports_without_the_training_data_operators(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
