from __future__ import annotations

import functools
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from kinfold.plans import driver_queries, driver_sql, merge_queries, reader_queries

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module", autouse=True)
def merged_once():
    """Records are merged once for all queries that start from them."""
    real = {module: module.merged for module in (driver_queries, merge_queries)}
    for module, fn in real.items():
        module.merged = functools.cache(fn)
    yield
    for module, fn in real.items():
        module.merged = fn


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


ORACLE = driver_sql.ORACLE_SQL | reader_queries.ORACLE_SQL | merge_queries.ORACLE_SQL


@pytest.mark.parametrize("name", list(ORACLE))
@needs_data
def test_query_equals_sql(spark, duck, name):
    df = driver_queries.QUERIES[name](spark, SMALL)
    wanted = duck.execute(ORACLE[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, wanted.fetchall())


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_is_importable_without_a_session():
    code = "import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 0)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code, root], capture_output=True, text=True, timeout=120).stdout.strip() == "True"
