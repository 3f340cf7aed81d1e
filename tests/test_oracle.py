"""Every registered query that has SQL gives the rows that DuckDB gives for it."""

from __future__ import annotations

import datetime
import decimal

import pytest

import __spark_entry__ as entry
from tesserine.queries import registry

from .conftest import SMALL


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6f}"
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_equal_those_of_sql(name, spark, duck):
    df = registry.QUERIES[name](spark, SMALL)
    found = duck.execute(registry.ORACLE_SQL[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_queries_without_sql_run(name, spark):
    assert registry.QUERIES[name](spark, SMALL).collect() is not None


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["name", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
