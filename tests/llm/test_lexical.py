import random
import re
from collections import Counter
from math import floor, log

import pytest

from keysweep.llm import lexical

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, top):
    """``(item, rank, id, score)`` of all documents, each item text by itself."""
    held = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            m = 100 - 25 + 25 * c.total() * n_docs // n_terms
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def words(rng, n, m):
    return " ".join(f"{rng.choice('abcdefghijklm')}{rng.choice(['', 'É', '日', '7'])}" * rng.choice([1, 1, 2]) + rng.choice(["", ",", "-X"]) for _ in range(rng.randint(n, m)))


@pytest.mark.parametrize("settings", [{}, {"block_terms": 5, "block_docs": 7}, {"top": 3, "block_docs": 1}])
def test_against_brute_force(spark, make_docs, settings):
    rng = random.Random(5)
    rows = [(i, words(rng, 0, 30)) for i in range(150)] + [(200 + i, "a b c d") for i in range(60)]
    rows += [(None, "a b c d"), (None, None), (7, "a b c d"), (7, "a b c d"), (900, "x " * 100_000), (901, ""), (902, "\x00 ,;"), (903, None)]
    rng.shuffle(rows)
    # More than 64 terms, repeated terms, no known term, nulls, repeated rows, two texts under one id.
    items = [(1, "a B c d a"), (1, "a B c d a"), (1, "x"), (2, None), (None, "é 日日"), (3, " ".join(f"{c}{d}" for c in "abcdefghijklm" for d in ["", "É", "日", "7", "q", "z"])),
             (4, "unknown"), (5, words(rng, 5, 9)), (6, "")]
    queries = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, rank string")
    found = lexical.search(make_docs(rows).repartition(3), queries, **settings)
    got = sorted(((r["item"], r["rank"], r["id"], r["score"]) for r in found.collect()), key=str)
    assert got == brute(rows, [(i, t) for i, t in items if t is not None], settings.get("top", 20))


def test_empty_tables(spark, make_docs):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, asked in ((make_docs([]), items), (make_docs([(1, "a")]), items.limit(0)), (make_docs([(1, None)]), items)):
        assert lexical.search(docs, asked).collect() == []


def test_masks_below_the_last_place_are_not_scored():
    import numpy as np
    n = [4] * 3000
    doc = np.arange(3000).repeat(2)
    term = np.tile([0, 1], 3000)
    term[1::2][20:] = 2  # only the first 20 documents hold term 1
    block = lexical.Block(n, doc, term, np.ones(6000, np.int64), 3000, 12_000)
    seen = []
    scores = block.scores
    block.scores = lambda which, factor, docs: seen.extend(docs.tolist()) or scores(which, factor, docs)
    ranking = lexical.best(block, list(range(3000)), (np.array([0, 1]), np.array([1, 1])), np.array([10, 1000, 10]), [], 20)
    assert [r[2] for r in ranking] == list(range(20)) and seen == list(range(20))
