import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from keysweep.llm import phrases


def brute(rows, min_count, top=2000):
    """``rows`` are ``(lang, text)``."""
    f, out = defaultdict(Counter), []
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        found = {p: v for p, v in c.items() if len(p) > 1 and v >= min_count}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * v >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, v in found.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def some(rng, n, words):
    return "".join(rng.choice(words) + rng.choice([" "] * 9 + ["  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(n))


@pytest.mark.parametrize("settings", [{}, {"trie_entries": 50, "leaf_entries": 4, "part_bytes": 500}, {"part_bytes": 2000, "top": 7}])
def test_against_brute_force(make_docs, settings):
    rng = random.Random(3)
    words = ["a", "b", "C", "c", "the", "É", "é", "日本", "x\xa0y", "\x1c", "'s", "-"]
    rows = [(f"l{i % 3}" if i % 7 else None, some(rng, rng.randint(0, 40), words)) for i in range(300)]
    rows += [("l1", "Red hot chili peppers. red hot chili peppers"), ("l1", "red hot")] * 9 + [("one", "ha " * 20_000), (None, None), ("l0", ""), ("l0", " . ,")]
    docs = make_docs([(i, t) for i, (_, t) in enumerate(rows)])
    langs = docs.sparkSession.createDataFrame([(i, lang) for i, (lang, _) in enumerate(rows)], "doc_id long, lang string")
    found = phrases.collocations(docs.join(langs, "doc_id").repartition(3), min_count=9, **settings)
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found.collect())
    assert got == brute(rows, 9, settings.get("top", 2000)) and got


def test_empty_tables(spark):
    schema = "lang string, text string"
    for rows in ([], [(None, None)], [("en", "a b")]):
        assert phrases.collocations(spark.createDataFrame(rows, schema)).collect() == []


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 50)
    monkeypatch.setattr(phrases, "STEP", 8)
    rng = random.Random(1)
    for n in (0, 1, 3, 7, 8, 11, 12, 100, 500):
        data = some(rng, n, ["a", "bb", "c" * 90]).encode()
        whole = [w for part in phrases.words(data) for w in part]
        got = []
        for piece, places in phrases.steps(data):
            got += [tuple(piece[i:i + 4]) for i in range(places)]
        assert got == [tuple(whole[i:i + 4]) for i in range(len(whole))]


@pytest.mark.parametrize("bits", [16, 32])
def test_trie_bursts_and_spills_whole_subtrees(bits):
    rng = np.random.default_rng(2)
    trie, want, got = phrases.Trie(bits, leaf_entries=8), Counter(), Counter()
    for step in range(60):
        ids = rng.integers(1, [3, 5, 9, 30], (200, 4)).astype(np.uint64)[:, :64 // bits]
        paths = np.zeros(200, np.uint64)
        for k in range(64 // bits):
            paths = (paths << np.uint64(bits)) | ids[:, k]
        want.update(paths.tolist())
        trie.add(paths)
        assert trie.size == sum(leaf.size for leaf in trie.leaves) and trie.lows == sorted(trie.lows)
        assert max(leaf.size for leaf in trie.leaves) <= 8
        if step % 7 == 0:
            run = trie.spill(trie.size // 2)
            assert (np.diff(run[0].astype(object)) > 0).all()
            got.update(dict(zip(run[0].tolist(), run[1].tolist())))
    run = trie.spill(0)
    got.update(dict(zip(run[0].tolist(), run[1].tolist())))
    assert got == want and trie.size == 0


def test_hash_table_counts_like_a_dictionary():
    rng = np.random.default_rng(3)
    leaf, want = phrases.Leaf(), Counter()
    for n in (1, 5, 100, 3000, 10):
        keys, counts = np.unique(rng.integers(1, 4000, n).astype(np.uint64) << np.uint64(40), return_counts=True)
        leaf.add(keys, counts)
        want.update(dict(zip(keys.tolist(), counts.tolist())))
        assert leaf.size == len(want) and dict(zip(*(c.tolist() for c in leaf.items()))) == want


def test_a_full_filter_changes_nothing(make_docs, monkeypatch):
    rng = random.Random(6)
    rows = [("x", some(rng, 60, ["a", "b", "c", "dd", "ee"])) for _ in range(60)]
    docs = make_docs([(i, t) for i, (_, t) in enumerate(rows)]).selectExpr("'x' AS lang", "text")
    monkeypatch.setattr(phrases, "_filter", lambda frequent: np.full(phrases.FILTER_BITS // 8, 255, np.uint8))
    found = phrases.collocations(docs, min_count=20).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found) == brute(rows, 20)


def test_more_words_than_numbers(make_docs):
    n = phrases.MAX_WORD_IDS + 9000
    text = " ".join(f"w{i}" for i in range(n))
    docs = make_docs([(1, text), (2, text)]).selectExpr("'x' AS lang", "text").coalesce(1)
    counts, totals = phrases.phrase_counts(docs, min_count=2)
    found = {(r["size"], r["f"]): r["count"] for r in counts.groupBy("size", "f").count().collect()}
    assert found == {(k, 2): n - k + 1 for k in (1, 2, 3, 4)} and totals.first()["n"] == 2 * n
