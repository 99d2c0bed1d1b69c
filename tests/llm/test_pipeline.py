import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keysweep.llm import toxicity
from keysweep.llm.covering import fingerprint
from keysweep.llm.exact import without_copies
from keysweep.llm.packing import encode
from keysweep.llm.tiling import tiles, words


def brute(spark, sf_dir):
    """The ids that stay and the token ids of each, one document after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(toxicity.sample(spark.read.parquet(f"{sf_dir}/labels.parquet"), docs))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    rows = [r for r in rows if model.above(model.logits(r[1], {}))[0] < toxicity.REJECT_AT]
    seen, unique = set(), []
    for i, t in rows:
        norm = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        if norm not in seen:
            seen.add(norm)
            unique.append((i, t))
    group, prints = {}, {i: fingerprint(t) for i, t in unique}
    for i, _ in unique:  # a walk over links, from the smallest id on
        if i in group:
            continue
        todo = [i]
        while todo:
            at = todo.pop()
            if at not in group:
                group[at] = i
                todo += [j for j in prints if j not in group and (prints[j] ^ prints[at]).bit_count() <= 2]
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = {}
    for i, t in unique:
        parts = words(t)
        if group[i] == i and not any(sum(x[2] for x in tiles(a, parts, min(5, len(a)))) >= 0.8 * len(a) for a in items if a):
            out[i] = encode(t, public_tokenizers.path("byte_bpe_50k.json")).tobytes()
    return out


def test_against_brute_force(spark, sf_dir):
    got: dict = {}
    for r in corpus_pipeline.run(spark, sf_dir).orderBy("doc_id", "start").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
    want = brute(spark, sf_dir)
    assert 0 < len(want) < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got == want


def test_copies_with_repeated_rows(make_docs):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (2, "a  b"), (None, "a b"), (None, None), (3, ""), (None, "z"), (None, "z"), (4, "c")]
    kept = without_copies(make_docs(rows))
    assert kept.columns == make_docs([]).columns
    assert {v for r in kept.collect() for c, v in r.asDict().items() if c not in ("doc_id", "text")} == {"x"}
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, "a b"), (1, "c"), (3, ""), (None, "z")], key=str)


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "toxicity"], ids=lambda s: s[0])
def test_stages_on_odd_rows(spark, make_docs, sf_dir, stage):
    odd = make_docs([(1, None), (2, ""), (3, "x y " * 50_000), (None, "q"), (5, "q r s t u"), (5, "q r s t u")])
    assert stage[1](spark, odd, sf_dir).where(F.col("doc_id") == 5).count() >= 1
    assert stage[1](spark, odd.limit(0), sf_dir).count() == 0
