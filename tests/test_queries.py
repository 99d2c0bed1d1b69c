"""Every registered query gives the rows of its plain-SQL counterpart; optional ones are tested beside their folder."""

from collections import Counter

import pytest

import __spark_entry__ as registry
from keysweep.catalog.queries import QUERIES

NAMES = sorted(QUERIES)


def test_every_query_has_sql():
    assert set(NAMES) <= set(registry.queries())
    assert set(NAMES) <= set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, sf_dir, name):
    frame = registry.queries()[name](spark, sf_dir)
    rows = frame.collect()
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = result.fetchall()
    got = Counter(tuple(row[c] for c in columns) for row in rows)
    assert got == Counter(expected)
    assert rows or name == "scan_raw_tables"


def test_entry_returns_rows(spark):
    assert registry.entry(spark).count() > 0
