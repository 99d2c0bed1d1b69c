import random

import pytest
import xxhash
from pyspark.sql import functions as F

from keysweep.llm.covering import BITS, _signed, fingerprint, links, masks, near_duplicates


def slow_fingerprint(text):
    words, at = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [at] if at else []
            at = ""
        else:
            at += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    """values: id -> fingerprint"""
    ids = list(values)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for x in ids:
        for y in ids:
            if (values[x] ^ values[y]).bit_count() <= 2:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b", "a b c", "Ä É a b c d\x0be f", "x y " * 3000])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_every_pair_of_positions_is_masked_out_by_some_table():
    kept = masks(2)
    assert len(kept) == 7
    for i in range(BITS):
        for j in range(i, BITS):
            assert any(not m >> i & 1 and not m >> j & 1 for m in kept)


@pytest.mark.parametrize("pairwise", [0, 4, 1000])
def test_links_connect_what_is_within_the_radius(spark, pairwise):
    rng = random.Random(3)
    values = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        values |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(60)}
    values |= {0, 1, 3, 7, 1 << 63, 2 ** 64 - 1}
    fps = spark.createDataFrame([(_signed(v),) for v in values], "fp long")
    want = components({v: v for v in values})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for r in links(fps, pairwise=pairwise).collect():
        a, b = sorted((r["a"] % 2 ** 64, r["b"] % 2 ** 64))
        assert want[a] == want[b]
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {v: find(v) for v in values} == want


def test_components_of_documents(make_docs):
    rng = random.Random(5)
    rows = [(0, None), (3, ""), (4, "\n"), (5, "one"), (6, "ONE"), (6, "one"), (7, "b " * 50_000)]
    for k in range(8):
        words = [rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(300)]
        for c in range(6):
            changed = list(words)
            for _ in range(c):
                changed[rng.randrange(300)] = "new"
            rows.append((100 - 10 * k + c, " ".join(changed)))
    got = near_duplicates(make_docs(rows)).collect()
    values = {i: slow_fingerprint(t) for i, t in rows}
    want = components(values)
    assert sorted((r["id"], r["fp"] % 2 ** 64, r["component"]) for r in got) == sorted((i, values[i], want[i]) for i, _ in rows)


def test_null_ids_and_no_rows(make_docs):
    got = near_duplicates(make_docs([(None, "a b"), (9, "a b"), (None, "q w e r t y")])).collect()
    assert sorted((str(r["id"]), str(r["component"])) for r in got) == [("9", "9"), ("None", "9"), ("None", "None")]
    assert near_duplicates(make_docs([])).collect() == []
