import random

import pytest
from pyspark.sql import types as T

from keysweep.llm.tiling import decontaminate, tiles, words


def brute(item, doc, size):
    """Covered words by the definition: search all pairs of places for the longest free match, mark it, repeat."""
    free_i, free_d, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free_i[i + n] and free_d[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < size:
            return covered
        free_i[i:i + n] = free_d[j:j + n] = [False] * n
        covered += n


@pytest.mark.parametrize("seed", range(30))
def test_tiles_against_brute_force(seed):
    rng = random.Random(seed)
    item = [rng.choice("abc") for _ in range(20)]
    doc = [rng.choice("abcd") for _ in range(15)] + item[10:] + ["x"] + item[:11] + [rng.choice("ab") for _ in range(9)]
    for size in (2, 3, 5):
        assert sum(t[2] for t in tiles(item, doc, size)) == brute(item, doc, size)


@pytest.fixture()
def items(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(40))), (2, "too short"), (3, None), (4, " ".join(f"v{i}" for i in range(10))), (4, "")]
    return spark.createDataFrame(rows, T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())]))


def test_documents(make_docs, items):
    one = [f"W{i}" for i in range(40)]
    texts = ["a " + " ".join(one) + ". b", " ".join(one[20:] + ["z"] + one[:20]), " ".join(one[:30]), " ".join(one[:34]), None, "",
             "is it too short?", " ".join(f"v{i}" for i in range(8)) + " q", "q " * 100_000 + " ".join(one) + " v0 v1 v2 v3 v4 v5 v6 v7 v8 v9"]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[1])]
    got = decontaminate(make_docs(rows), items).collect()
    want = [(i, None if t is None else [k for k, item in ((1, one), (2, ["too", "short"]), (4, [f"v{i}" for i in range(10)]))
             if brute([w.lower() for w in item], words(t)[-60:], min(5, len(item))) >= 0.8 * len(item)]) for i, t in rows]
    assert sorted(((r["id"], r["contaminated"], r["n_items"], r["item"]) for r in got), key=str) == \
        sorted(((i, bool(k), len(k or ()), k[0] if k else None) for i, k in want), key=str)
    kept = decontaminate(make_docs(rows), items, keep=True)
    assert kept.columns == make_docs([]).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, k in want if not k), key=str)


def test_empty_tables(make_docs, items):
    assert decontaminate(make_docs([]), items).collect() == []
    got = decontaminate(make_docs([(1, "a b c d e f")]), items.limit(0)).collect()
    assert [tuple(r) for r in got] == [(1, False, 0, None, 0.0)]
