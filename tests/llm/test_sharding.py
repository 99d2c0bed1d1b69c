import zlib

import numpy as np
import pytest

from keysweep.llm import sharding
from keysweep.llm.sharding import permute, shards


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_and_its_inverse(n):
    index = np.arange(n)
    placed = permute(index, n, key=9)
    assert sorted(placed.tolist()) == index.tolist()
    assert permute(placed, n, key=9, back=True).tolist() == index.tolist()
    if n >= 64:
        assert placed.tolist() != index.tolist() != permute(index, n, key=10).tolist()
        assert placed.tolist() != permute(index, n, key=10).tolist()


def brute(rows, n_shards, key):
    made = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in rows))
    places = permute(np.arange(len(rows)), len(rows), key).tolist()
    return sorted((str(i if has else None), size, crc, p % n_shards, p // n_shards) for (has, i, crc, size), p in zip(made, places))


def test_shards(make_docs):
    rows = [(i * 7 % 101, "é" * (i % 13)) for i in range(95)] + [(None, "a"), (3, None), (3, None), (3, ""), (5, "x" * 200_000)]
    docs = make_docs(rows)
    got = sorted((str(r["id"]), r["size"], r["crc"], r["shard"], r["slot"]) for r in shards(docs, 8, 4).collect())
    assert got == brute(rows, 8, 4)
    again = sorted((str(r["id"]), r["size"], r["crc"], r["shard"], r["slot"]) for r in shards(docs.repartition(13), 8, 4).collect())
    assert again == got
    for s in range(8):
        slots = sorted(g[4] for g in got if g[3] == s)
        assert slots == list(range(len(slots))) and len(slots) in (12, 13)


def test_no_rows(make_docs):
    assert shards(make_docs([]), 40).collect() == []


def test_rows_that_occur_very_often(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 7)
    rows = [(5, "same")] * 40 + [(i, "x" * i) for i in range(12)] + [(None, None)] * 8 + [(9, "same")] * 7
    got = sorted((str(r["id"]), r["size"], r["crc"], r["shard"], r["slot"]) for r in shards(make_docs(rows), 4, 1).collect())
    assert got == brute(rows, 4, 1)
