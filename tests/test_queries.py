"""Registered queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidegate.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, bool) or isinstance(v, str):
            return str(v)
        return repr(float(v))

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, tables, name):
    found = entry.queries()[name](spark, SF)
    expected = tables.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    rows = canonical(found.columns, [tuple(r) for r in found.collect()])
    assert rows == canonical(expected.columns, expected.fetchall())


def test_checks_of_faulty_reports_answer_both_ways(spark):
    """No check of a report with faults passes or fails throughout, but those named here."""
    one_sided = {"minimum_rows"}
    small = "/root/testdata/sf0.01"
    for name in [n for n in catalog.QUERIES if n.startswith("faulty_")]:
        both = catalog.QUERIES[name](spark, small).select("check", "passed").distinct().groupBy("check").count()
        assert {r["check"] for r in both.collect() if r["count"] < 2} <= one_sided, name


def test_entry(spark):
    assert entry.entry(spark).count() == 3
