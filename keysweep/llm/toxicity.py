"""Toxicity as an ordered severity: cumulative-link regression over sparse word features.

``P(grade > k) = sigmoid(w . x - theta_k)``: one weight per feature, shared by all ordered thresholds. The
expected severity is the sum of these probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keysweep.plans.store import stored

#: At most so many labelled documents are fitted on, those with the smallest hash of their id.
SAMPLE_ROWS = 12_000
#: At most so many features are kept, those that tell toxic documents best.
FEATURES = 6_000
#: A feature must depend on the label by a likelihood ratio of so much, which chance hardly gives to one in 100,000.
MIN_RATIO = 24.0
#: Toxic documents are split into so many grades.
GRADES = 3
#: Chosen on labels that were held out: it rejects 99 % of toxic documents and hardly a clean one.
REJECT_AT = 0.3

_WORD = re.compile(r"\w+")
#: Beginnings of words that are features besides the words, so that endings not seen before are known too.
_STEMS = (4, 5)


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def rates(counts: Counter) -> dict[str, float]:
    """Value of each word: the log of one plus its share of the words in percent, so that length does not count."""
    total = max(1, counts.total())
    return {word: log1p(100 * count / total) for word, count in counts.items()}


def names(word: str) -> list[str]:
    """Features of a word: itself, and its stems with a hyphen."""
    return [word, *(word[:n] + "-" for n in _STEMS if len(word) > n)]


@dataclass(frozen=True)
class Severity:
    """A fitted model: weights by feature, and rising thresholds between grades."""
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def logits(self, text: str | None, cache: dict) -> float:
        total = 0.0
        for word, rate in rates(word_counts(text)).items():
            weight = cache.get(word)
            if weight is None:
                weight = sum(self.weights.get(n, 0.0) for n in names(word))
                if len(cache) < 1 << 18:
                    cache[word] = weight
            if weight:
                total += weight * rate
        return total

    def above(self, logit: float) -> list[float]:
        """Probability of a grade above each threshold."""
        return [float(_sigmoid(np.float64(logit - t))) for t in self.thresholds]


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def sample(labels: DataFrame, docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic") -> DataFrame:
    """``id, text, toxic`` of at most ``rows`` labelled documents; null ids or labels are left out.

    Chosen by a hash of the id among all labels, so the choice does not depend on partitions.
    """
    spark = docs.sparkSession
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")) \
        .orderBy(F.xxhash64("id"), "id").limit(rows).toPandas()
    kind = labels.schema[id_col].dataType.simpleString()
    chosen = spark.createDataFrame(list(chosen.itertuples(index=False, name=None)), f"id {kind}, toxic int")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id")  # at most ``rows`` ids


def fit(labelled: DataFrame, features: int = FEATURES, grades: int = GRADES, rounds: int = 400, penalty: float = 1e-5) -> Severity:
    """Fit on ``id, text, toxic``, a bounded sample.

    Labels say toxic or not; the grades of toxic documents, 1 to ``grades``, are equal parts of them by the share of their words that
    are marked (occur at least eight times as often among toxic documents). Grade 0 is not toxic.
    """
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for name in {n for w in word_counts(text) for n in names(w)}:
                    seen.setdefault(name, [0, 0])[toxic > 0] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()),
                 pa.array([v[1] for v in seen.values()], pa.int64())], names=["name", "clean", "toxic"])

    labelled = stored(labelled.select("text", "toxic"))
    totals = {bool(r["t"]): r["n"] for r in labelled.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_clean:  # nothing to tell apart: every document gets the share of toxic ones
        share = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.0
        edge = float(np.log(max(1 - share, 1e-9) / max(share, 1e-9)))
        return Severity({}, tuple(edge + k for k in range(grades)))

    counted = labelled.mapInArrow(occurrences, "name string, clean long, toxic long") \
        .groupBy("name").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    share = n_toxic / (n_toxic + n_clean)
    both = F.col("clean") + F.col("toxic")
    ratio = 2 * (F.when(F.col("toxic") > 0, F.col("toxic") * F.log(F.col("toxic") / (both * share))).otherwise(0.0)
                 + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share)))).otherwise(0.0))
    best = counted.withColumn("odds", odds).withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO) \
        .orderBy(F.desc("ratio"), "name").limit(features).collect()
    place = {r["name"]: i for i, r in enumerate(best)}
    marked = {r["name"] for r in best if r["odds"] >= np.log(8)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                x: dict[int, float] = {}
                words = word_counts(text)
                for word, rate in rates(words).items():
                    for name in names(word):
                        if (i := place.get(name)) is not None:
                            x[i] = x.get(i, 0.0) + rate
                share = sum(c for w, c in words.items() if any(n in marked for n in names(w))) / max(1, words.total())
                out.append((toxic, share, list(x.keys()), list(x.values())))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()),
                                              pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.float64()))],
                                             names=["toxic", "share", "at", "x"])

    # Sorted, so that the result does not hang on the order in which tasks end.
    rows = sorted(labelled.mapInArrow(vectors, "toxic int, share double, at array<int>, x array<double>").collect(),
                  key=lambda r: (r["toxic"], r["share"], r["at"], r["x"]))
    toxic = np.array([r["toxic"] > 0 for r in rows])
    marks = np.array([r["share"] for r in rows])
    bounds = np.quantile(marks[toxic], np.arange(1, grades) / grades)
    grade = np.where(toxic, 1 + np.searchsorted(bounds, marks, side="right"), 0)
    weights, thresholds = _descend([r["at"] for r in rows], [r["x"] for r in rows], grade, len(best), grades, rounds, penalty)
    return Severity({n: float(weights[i]) for n, i in place.items() if weights[i]}, thresholds)


def _descend(at: list, x: list, grade: np.ndarray, n_features: int, grades: int, rounds: int, penalty: float):
    """Maximum likelihood of the cumulative-link model by gradient steps of adapted length, over the whole sample."""
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    col = np.array([i for a in at for i in a], np.int64)
    value = np.array([v for a in x for v in a], np.float64)
    # Parameters: weights, the first threshold, the logs of the steps between thresholds.
    p = np.concatenate([np.zeros(n_features), [1.0], np.zeros(grades - 1)])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    n = len(at)
    for step in range(1, rounds + 1):
        w, cuts = p[:n_features], np.cumsum(np.concatenate([p[n_features:n_features + 1], np.exp(p[n_features + 1:])]))
        score = np.bincount(row, value * w[col], minlength=n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper, lower = _sigmoid(edges[grade + 1] - score), _sigmoid(edges[grade] - score)
        slope = upper + lower - 1  # of the log likelihood, by the score
        chance = np.maximum(upper - lower, 1e-9)
        by_cut = np.bincount(grade, upper * (1 - upper) / chance, minlength=grades + 1)[:grades] \
            - np.bincount(grade, lower * (1 - lower) / chance, minlength=grades + 1)[1:]
        by_p = np.concatenate([np.bincount(col, value * slope[row], minlength=n_features) / n - penalty * w, [by_cut.sum() / n],
                               np.exp(p[n_features + 1:]) * by_cut[::-1].cumsum()[::-1][1:] / n])
        mean, square = 0.9 * mean + 0.1 * by_p, 0.99 * square + 0.01 * by_p ** 2
        p = p + 0.05 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    cuts = np.cumsum(np.concatenate([p[n_features:n_features + 1], np.exp(p[n_features + 1:])]))
    return p[:n_features], tuple(float(c) for c in cuts)


def score(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text", reject_at: float = REJECT_AT,
          keep: bool = False) -> DataFrame:
    """``id, severity, p_toxic, grade, rejected``: one row per row of ``docs``, whole texts, no shuffle.

    ``severity`` is the expected grade, ``grade`` the likeliest; ``rejected`` if ``p_toxic`` (a grade above 0) reaches ``reject_at``.
    Null and empty texts have no features. Only the two named columns are read; with ``keep`` the rows that are not
    rejected are returned instead, with all columns of ``docs``.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            above = [model.above(model.logits(t.as_py(), cache)) for t in batch.column("t" if not keep else text_col)]
            toxic = [a[0] for a in above]
            if keep:
                yield batch.filter(pa.array([p < reject_at for p in toxic], pa.bool_()))
                continue
            grade = []
            for a in above:
                chances = [hi - lo for hi, lo in zip([1.0, *a], [*a, 0.0])]
                grade.append(chances.index(max(chances)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([sum(a) for a in above], pa.float64()), pa.array(toxic, pa.float64()),
                 pa.array(grade, pa.int32()), pa.array([p >= reject_at for p in toxic], pa.bool_())],
                names=["id", "severity", "p_toxic", "grade", "rejected"])

    if keep:
        return docs.mapInArrow(of, docs.schema)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return texts.mapInArrow(of, f"id {kind}, severity double, p_toxic double, grade int, rejected boolean")
