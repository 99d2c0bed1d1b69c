"""Registered queries of the package: the rows of their SQL where there is some, else their columns over whole tables."""

from collections import Counter

import pytest

import __spark_entry__ as registry
from keysweep.llm.queries import QUERIES, SQL

#: Columns that a query returns at least.
COLUMNS = {
    "op2": "doc_id n_words n_removed kept_sha256", "op4": "doc_id keep_id group_size kept text_sha256",
    "op6": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op7": "doc_id fingerprint component_id",
    "op8": "doc_id n_bytes n_removed n_spans kept_sha256", "op9": "doc_id size text_crc32 law shard slot grown_shard",
}


def test_registered():
    assert set(SQL) <= set(QUERIES) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    got = Counter(tuple(row[c] for c in columns) for row in frame.collect())
    assert got == Counter(result.fetchall()) and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_columns(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    assert set(COLUMNS.get(name.split("_")[0], "doc_id").split()) <= set(frame.columns)
    assert frame.count() > 0
