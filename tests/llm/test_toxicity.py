import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysweep.llm.toxicity import REJECT_AT, Severity, _descend, fit, sample, score


def test_held_out_labels(spark):
    """Fitted on three quarters of the labels of a table, scored on the others."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fitted = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) > 0
    model = fit(sample(labels.where(fitted), docs))
    told = score(docs, model).join(labels.where(~fitted).withColumnRenamed("doc_id", "id"), "id").select("toxic", "rejected", "severity").toPandas()
    toxic = told["toxic"] == 1
    assert told.rejected[toxic].mean() >= 0.95
    assert told.rejected[~toxic].mean() <= 0.005
    assert told.severity[toxic].mean() > 10 * told.severity[~toxic].mean()
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3


def test_same_model_whatever_the_partitions(spark, make_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) + (" awful" * (1 + i % 5) if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (999, 1), (4, None)], "doc_id long, toxic int")
    docs = make_docs(rows)
    one = fit(sample(labels, docs))
    two = fit(sample(labels.repartition(5), docs.repartition(7)))
    assert one == two
    got = {r["id"]: r for r in score(make_docs(rows + [(None, "awful"), (-1, None), (-2, ""), (-3, "aaa " * 100_000), (0, "awful awful")]), one).collect()}
    assert all(got[i]["rejected"] == (i % 3 == 0) for i in range(1, 300))
    assert got[None]["rejected"] and not got[-1]["rejected"] and not got[-2]["rejected"] and not got[-3]["rejected"]
    assert got[-1]["severity"] == got[-2]["severity"] < got[3]["severity"]
    kept = score(make_docs(rows), one, keep=True)
    assert kept.columns == make_docs([]).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(300) if i % 3}


def test_ordinal_grades_share_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    grade = np.digitize(x @ [2.0, -1.0] + rng.logistic(size=3000), [-1.0, 0.5, 2.0])
    weights, cuts = _descend([[0, 1]] * 3000, x.tolist(), grade, 2, 3, 800, 0.0)
    assert np.allclose(weights, [2.0, -1.0], atol=0.2) and np.allclose(cuts, [-1.0, 0.5, 2.0], atol=0.2)


@pytest.mark.parametrize("toxic", [0, 1, None])
def test_one_class_or_no_labels(spark, make_docs, toxic):
    docs = make_docs([(1, "a b"), (2, None)])
    labels = spark.createDataFrame([(1, toxic), (2, toxic)], "doc_id long, toxic int")
    got = score(docs, fit(sample(labels, docs))).collect()
    assert [r["rejected"] for r in got] == [toxic == 1] * 2
    assert score(make_docs([]), Severity({}, (1.0, 2.0, 3.0))).collect() == []


def test_scores_against_the_definition(make_docs):
    """Every figure of a row by the formulas, in plain Python."""
    import math
    import re

    weights = {"bad": 2.5, "bad-": 0.25, "awfu-": 1.0, "awful-": -0.5, "nice": -3.0, "été": 0.75, "worse": 0.5, "wors-": 0.125}
    model = Severity(weights, (0.5, 1.25, 4.0))
    texts = ["bad", "Bad bad nice, awfully", "été ÉTÉ worse worsening", "", None, "nothing here", "nice " * 50 + "awful", "bad " * 3 + "x " * 20_000, "bad " * 9]

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    rows = score(make_docs(list(enumerate(texts))), model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = re.findall(r"\w+", (texts[r["id"]] or "").lower())
        logit = 0.0
        for w in set(words):
            names = [w] + [w[:n] + "-" for n in (4, 5) if len(w) > n]
            logit += math.log1p(100 * words.count(w) / len(words)) * sum(weights.get(n, 0) for n in names)
        above = [sigmoid(logit - t) for t in model.thresholds]
        chances = [a - b for a, b in zip([1, *above], [*above, 0])]
        assert r["severity"] == pytest.approx(sum(above)) and r["p_toxic"] == pytest.approx(above[0])
        assert r["grade"] == chances.index(max(chances)) and r["rejected"] == (above[0] >= REJECT_AT)
