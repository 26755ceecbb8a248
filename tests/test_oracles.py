"""Every registered query against its SQL oracle, and what its plan must not contain."""

from __future__ import annotations

import datetime
import decimal
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from paywarden.plans import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels
conversations""".split()

#: Single-task and row-by-row operators of a physical plan.
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonRDD"]


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    yield connection
    connection.close()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return str(value.normalize() + 0)
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def table(rows):
    return sorted(tuple(plain(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    rows = contract.queries()[name](spark, FOLDER)
    columns = sorted(rows.columns)
    got = table(rows.select(*[f"`{c}`" for c in columns]).collect())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in UNWANTED if node in plan]
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = oracle.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == table([row[i] for i in order] for row in result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(contract.oracle_sql())
