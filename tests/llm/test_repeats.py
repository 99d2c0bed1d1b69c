"""Repeated passages of words (recompression) and of bytes (suffix arrays), against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from keysweep.llm.recompression import kernel, without_repeats, words
from keysweep.llm import suffixes
from keysweep.llm.suffixes import SuffixFamily, without_earlier
from keysweep.llm.windows import least_at


def some_texts(seed, n=40):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcé") for _ in range(k))
    passages = [[word(2) for _ in range(rng.randint(30, 60))] for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [word(rng.randint(1, 5)) for _ in range(rng.randint(0, 60))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            a, at = rng.randint(0, 8), rng.randint(0, len(parts))
            parts[at:at] = p[a:len(p) - rng.randint(0, 8)]
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    return out + [out[3], out[3], "x " * 50, "x " * 34, "x " * 35, "y z " * 40, None, "", " \t", "\u2003a\x1c b\x85", "q" * 60, "q" * 50]


def rows_of(seed):
    texts = some_texts(seed)
    return [(i * 3, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[5]), (3, texts[1]), (6, texts[7])]


def brute_words(rows, size):
    parts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(p[i:i + size]) for p in parts for i in range(len(p) - size + 1))
    for (doc, _), p in zip(rows, parts):
        gone = {j for i in range(len(p) - size + 1) if seen[tuple(p[i:i + size])] > 1 for j in range(i, i + size)}
        kept = " ".join(w for j, w in enumerate(p) if j not in gone)
        yield doc, len(p), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def brute_bytes(rows, size):
    data = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for k in range(len(b) - size + 1):
            first[b[k:k + size]] = min(first.get(b[k:k + size], i), i)
    for (doc, _), (i, b) in zip(rows, data):
        gone = {j for k in range(len(b) - size + 1) if first[b[k:k + size]] < i for j in range(k, k + size)}
        spans = sum(j - 1 not in gone for j in gone)
        yield doc, len(b), len(gone), spans, hashlib.sha256(bytes(c for j, c in enumerate(b) if j not in gone)).hexdigest()


@pytest.mark.parametrize("seed", [1, 2])
def test_words(make_docs, seed):
    rows = rows_of(seed)
    got = [tuple(r) for r in without_repeats(make_docs(rows)).select("id", "n_words", "n_removed", "digest").collect()]
    assert sorted(got, key=str) == sorted(brute_words(rows, 35), key=str)
    assert 0 < sum(r[2] for r in got) < sum(r[1] for r in got)


@pytest.mark.parametrize("seed,settings", [(1, {}), (2, {}), (1, {"batches": 5, "chunk_bytes": 300, "bucket_bytes": 700}), (2, {"batches": 1, "chunk_bytes": 2000, "bucket_bytes": 50})])
def test_bytes(make_docs, seed, settings):
    rows = rows_of(seed)
    got = without_earlier(make_docs(rows).repartition(3), **settings)
    got = [tuple(r) for r in got.select("id", "n_bytes", "n_removed", "n_spans", "digest").collect()]
    assert sorted(got, key=str) == sorted(brute_bytes(rows, 50), key=str)


def test_a_kept_family_meets_later_batches(spark, make_docs):
    rows = [(i, t) for i, t in enumerate(some_texts(7, 60))]
    want = {r[0]: r[1:] for r in brute_bytes(rows, 50)}
    family = SuffixFamily(spark, buckets=5, chunk_bytes=500)
    ranks = []
    for a in range(0, len(rows), 12):
        batch = make_docs(rows[a:a + 12]).selectExpr("doc_id AS id", "text AS t")
        got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["digest"]) for r in family.add(batch).collect()}
        assert got == {i: want[i] for i, _ in rows[a:a + 12]}
        ranks.append([rank for rank, _ in family.levels])
    # Levels of equal rank have merged, as carries in a binary counter.
    assert ranks == [[i for i in range(9, -1, -1) if n >> i & 1] for n in range(1, len(ranks) + 1)]
    assert family.add(make_docs([]).selectExpr("doc_id AS id", "text AS t")).collect() == []
    # A batch that comes late is judged by smaller ids only.
    text = next(t for _, t in rows if t and len(t) > 99)
    late = family.add(make_docs([(10_000, text), (-1, text)]).selectExpr("doc_id AS id", "text AS t")).collect()
    assert {r["id"]: r["n_removed"] for r in late} == {10_000: len(text.encode()), -1: 0}
    family.drop()


def test_smallest_document_of_every_window():
    import numpy as np
    rng = random.Random(8)
    for size in (3, 8, 9, 16, 50):
        found = list({bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(size, size + 9))) for _ in range(60)})
        least = np.array([rng.randrange(20) for _ in found])
        first: dict = {}
        for f, n in zip(found, least.tolist()):
            for k in range(len(f) - size + 1):
                first[f[k:k + size]] = min(first.get(f[k:k + size], n), n)
        got = suffixes.smallest(found, least, size)
        assert [g.tolist() for g in got] == [[first[f[k:k + size]] for k in range(len(f) - size + 1)] for f in found]


def test_equal_windows_have_equal_names():
    rng = random.Random(5)
    of = kernel(35)
    fine = of.finer(4)
    for k in (1, 2, 3, 30):
        passage = [f"w{rng.randrange(k)}" for _ in range(60)]
        names = []
        for _ in range(20):
            around = [[f"w{rng.randrange(k)}" for _ in range(rng.randrange(40))] for _ in range(2)]
            x = of.code([" ".join(around[0] + passage + around[1])])[0]
            names.append([k.anchors(x)[0][len(around[0]):len(around[0]) + 26].tolist() for k in (of, fine)])
        assert all(n == names[0] for n in names)


def test_least_at():
    import numpy as np
    x = np.array([5, 3, 9, 1, 7, 2, 8], np.uint64)
    for width in range(1, 8):
        assert x[least_at(x, width)].tolist() == [min(x.tolist()[i:i + width]) for i in range(8 - width)]
    assert least_at(np.array([4, 1, 1, 1], np.uint64), 3).tolist() == [1, 1]


def test_empty_and_long(make_docs):
    assert without_repeats(make_docs([])).collect() == [] == without_earlier(make_docs([])).collect()
    long = make_docs([(1, "ab " * 200_000), (2, "z")])
    assert sorted((r["id"], r["n_words"], r["n_removed"]) for r in without_repeats(long).collect()) == [(1, 200_000, 200_000), (2, 1, 0)]
    assert sorted((r["id"], r["n_bytes"], r["n_removed"]) for r in without_earlier(long).collect()) == [(1, 600_000, 0), (2, 1, 0)]
    assert words("a\u2003b c\x1cd") == ["a\u2003b".encode(), b"c\x1cd"]
