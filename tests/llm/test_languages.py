from zlib import crc32

import numpy as np
import pytest

from keysweep.llm import languages as L


def test_gradients_against_differences():
    net = L.Network.of(["a", "b", "c"], [a.astype(np.float64) for a in L.fresh(["a", "b", "c"], hidden=3).arrays()])
    rng = np.random.default_rng(0)
    x, lang = rng.integers(0, 6, (7, 4)), np.array([0, 2, 1, 2])
    inside = (np.arange(7)[:, None] < np.array([7, 7, 3, 1]))[..., None].astype(float)
    _, gradient = L.slopes(net, x, inside, lang)
    for k, (array, slope) in enumerate(zip(net.arrays(), gradient)):
        for at in rng.integers(0, array.size, 12).tolist():
            array.flat[at] += 1e-6
            up = L.slopes(net, x, inside, lang)[0]
            array.flat[at] -= 2e-6
            down = L.slopes(net, x, inside, lang)[0]
            array.flat[at] += 1e-6
            assert slope.flat[at] == pytest.approx((up - down) / 2e-6, abs=1e-7), k


def plain(net, window):
    """Probabilities of each position of one window, number by number."""
    def one(gates, data):
        h, out = np.zeros(len(gates.offset)), []
        for c in data:
            sums, part = gates.byte[:, c], np.stack([h @ s for s in gates.state])
            z, r = (1 / (1 + np.exp(-(sums[i] + part[i]))) for i in range(2))
            new = np.tanh(sums[2] + r * (part[2] + gates.offset))
            h = (1 - z) * new + z * h
            out.append(h)
        return np.array(out)
    score = one(net.ahead, window) @ net.out[0] + one(net.back, window[::-1])[::-1] @ net.out[1] + net.bias
    e = np.exp(score)
    return e / e.sum(axis=1, keepdims=True)


def test_pooling_against_one_position_at_a_time(monkeypatch):
    monkeypatch.setattr(L, "BATCH", 3)
    net = L.fresh(["a", "b"])
    texts = [b"", b"x", b"hello " * 40, bytes(range(256)) * 2, b"y" * 128, b"z" * 129]
    got = L.pooled(net, texts)
    for text, chances in zip(texts, got):
        ends = L._cuts(len(text))
        assert np.diff(ends).max(initial=0) <= L.WINDOW and ends[-1] == len(text)
        rows = [plain(net, text[a:b]) for a, b in zip(ends, ends[1:])]
        want = np.concatenate(rows).mean(axis=0) if rows else np.zeros(2)
        assert chances == pytest.approx(want, abs=1e-4)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = L.fit(L.sample(docs))
    rows = L.languages(docs, net).join(docs.selectExpr("doc_id AS id", "lang"), "id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_learns_from_its_part_only(spark):
    rows = [(i, "abc " * 30, "x" if i % 2 else "y") for i in range(40)] + [(None, "abc", "never"), (100, None, "never"), (101, "12", "never"), (102, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sampled = L.sample(docs, per_lang=5).collect()
    own = [r for r in rows[:40] if crc32(str(r[0]).encode()) % 3 != 1]
    assert {r["lang"] for r in sampled} == {"x", "y"}
    assert all(sum(r["lang"] == k for r in sampled) == min(5, sum(r[2] == k for r in own)) for k in "xy")


def test_odd_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "1234 ..."), (4, "hello"), (4, "hello"), (None, "hello"), (5, "hello there " * 200_000), (6, "日本"), (7, "½ ²")])
    net = L.fresh(["aa", "bb"])
    got = L.languages(docs.withColumnRenamed("fp", "lang"), net).collect()
    assert sorted((r["id"] or 0, r["lang_pred"] == "und") for r in got) == \
        [(0, False), (1, True), (2, True), (3, True), (4, False), (4, False), (5, False), (6, False), (7, True)]
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") for r in got)
    assert L.languages(docs.limit(0), net).count() == 0
    none = L.fit(L.sample(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")))
    assert {r["lang_pred"] for r in L.languages(docs, none).collect()} == {"und"}
