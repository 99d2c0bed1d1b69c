"""Ranked lexical search: the best documents of each item of a query set, by groups of equal presence masks.

Documents are read once and keep only the terms that items ask for. Then, in blocks of documents, a bitmap per term tells which of an
item's terms a document holds: its mask. Documents of one mask are a group, whose score is bounded by its terms' largest parts; groups are
scored by descending bound, and once the best bound left is below the last place of the ranking, the rest cannot enter it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from keysweep.plans.store import stored

TOP = 20
#: Items go in blocks of at most so many terms; each block reads the documents once.
BLOCK_TERMS = 1 << 18
#: Documents whose masks are held at a time.
BLOCK_DOCS = 1 << 13
#: Places that the rankings of an item's tasks are first merged in.
SALTS = 64

#: Bytes between terms are blanks, A-Z are lower-cased.
_PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """Terms in order of occurrence: runs of ASCII letters, ASCII digits and all characters beyond ASCII, only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class Items(NamedTuple):
    """A block of items: numbers of the terms, and of each item the distinct ones and how often it has them."""
    vocabulary: dict[bytes, int]
    held: list[tuple[np.ndarray, np.ndarray]]


def _blocks(items: DataFrame, block_terms: int) -> Iterator[tuple[list, Items]]:
    """Ids and terms of items, so many at a time; never all of them are on the driver."""
    ids, vocabulary, held, size = [], {}, [], 0
    for row in items.toLocalIterator():
        counts = Counter(terms(row["t"]))
        if ids and size + len(counts) > block_terms:
            yield ids, Items(vocabulary, held)
            ids, vocabulary, held, size = [], {}, [], 0
        ids.append(row["item"])
        held.append((np.array([vocabulary.setdefault(t, len(vocabulary)) for t in counts], np.int64), np.array(list(counts.values()), np.int64)))
        size += len(counts)
    if ids:
        yield ids, Items(vocabulary, held)


def postings(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """``id, n, terms, tfs`` of the documents with a term: how many they have, and which of the ``vocabulary`` (a broadcast)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            keep, n, ends, which, times = [], [], [0], [], []
            for i, text in enumerate(batch.column("t")):
                found = terms(text.as_py())
                if not found:
                    continue
                counts = Counter(found)
                hits = [(known[t], counts[t]) for t in counts.keys() & known.keys()]
                keep.append(i)
                n.append(len(found))
                which += [h[0] for h in hits]
                times += [h[1] for h in hits]
                ends.append(len(which))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, k)) for c, k in ((which, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists],
                                             names=["id", "n", "terms", "tfs"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    return texts.mapInArrow(of, f"id {kind}, n bigint, terms array<int>, tfs array<bigint>")


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Parts of some documents' scores by term, from their postings."""

    def __init__(self, n: list[int], doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int):
        # Exact whatever the sizes, as are Python's integers.
        m = np.array([100 - 25 + 25 * x * n_docs // n_terms for x in n], np.int64)
        part = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        order = np.argsort(term, kind="stable")
        term, self.size = term[order], len(n)
        self.doc, self.part = doc[order], part[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        self.at = dict(zip(term[first].tolist(), zip(first.tolist(), np.append(first[1:], len(term)).tolist())))
        self.most = dict(zip(term[first].tolist(), np.maximum.reduceat(self.part, first).tolist())) if len(first) else {}

    def groups(self, which: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct masks over the terms ``which`` (a row each, a column per 64 terms), the documents by mask, and where each mask's end."""
        masks = np.zeros((self.size, -(-len(which) // 64)), np.uint64)
        for i, t in enumerate(which):
            a, b = self.at[t]
            masks[self.doc[a:b], i // 64] |= np.uint64(1 << i % 64)
        docs = np.flatnonzero(masks.any(axis=1))
        masks = masks[docs]
        order = np.lexsort(masks.T)
        docs, masks = docs[order], masks[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(docs)), bool), (masks[1:] != masks[:-1]).any(axis=1))))
        return masks[first], docs, np.append(first, len(docs))

    def scores(self, which: list[int], factor: list[int], docs: np.ndarray) -> np.ndarray:
        """Scores of ascending ``docs``."""
        out = np.zeros(len(docs), np.int64)
        for t, f in zip(which, factor):
            a, b = self.at[t]
            at = np.minimum(np.searchsorted(self.doc[a:b], docs), b - a - 1) + a
            out += np.where(self.doc[at] == docs, self.part[at] * f, 0)
        return out


def best(block: Block, ids: list, item: tuple[np.ndarray, np.ndarray], weights: np.ndarray, ranking: list, top: int) -> list:
    """``ranking`` (``(-score, id is null, id)`` in order, at most ``top``) with the documents of a block that enter it."""
    which = [(t, int(c * weights[t])) for t, c in zip(item[0].tolist(), item[1].tolist()) if t in block.at and weights[t] > 0]
    factor = [f for _, f in which]
    most = [f * block.most[t] for t, f in which]
    which = [t for t, _ in which]

    def last() -> int:
        return -ranking[-1][0] if len(ranking) == top else 1

    if sum(most) < last():
        return ranking
    masks, docs, ends = block.groups(which)
    bound = np.zeros(len(masks), np.int64)
    for i, x in enumerate(most):
        bound += ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64) * x
    order = np.argsort(-bound, kind="stable")
    sizes = np.cumsum(np.diff(ends)[order])
    done, batch = 0, 4 * top
    # Equal scores may still enter by a smaller id, so only lower bounds end it.
    while done < len(order) and bound[order[done]] >= last():
        until = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + batch, side="right")))
        chosen = order[done:until]
        chosen = np.sort(np.concatenate([docs[ends[g]:ends[g + 1]] for g in chosen[bound[chosen] >= last()].tolist()]))
        scores = block.scores(which, factor, chosen)
        enter = np.flatnonzero(scores >= last())
        if len(enter) > top:  # what is below the last place among these alone is not sorted at all
            enter = enter[scores[enter] >= np.partition(scores[enter], -top)[-top]]
        ranking = sorted(ranking + [(-s, ids[d] is None, 0 if ids[d] is None else ids[d]) for s, d in zip(scores[enter].tolist(), chosen[enter].tolist())])[:top]
        done, batch = until, 4 * batch
    return ranking


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each query, merged in two steps."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    some = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block_terms: int = BLOCK_TERMS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``item, rank, id, score``: the ``top`` documents of each item with a score above 0, highest first, equal ones by ascending id.

    The score is a saturated term frequency, damped by the document's length, times a weight that falls with the documents that hold the
    term, in whole numbers. Null and empty texts have no term and are not counted. A null id comes last among equal scores. Repeated
    rows of documents are documents of their own; repeated rows of items are one, and of several texts under one item id each is ranked
    by itself. Items without a known term, and empty tables, give no rows. Only the named columns are read.

    Items are the stated query set. They go in blocks of bounded size, each of which reads the documents once; a task returns at most
    ``top`` rows for each item of the block.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    items = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("t")).where("t IS NOT NULL").distinct()
    out = spark.createDataFrame([], f"item {item_kind}, rank int, id {kind}, score bigint")
    # Stored, so that all blocks see the items in one order.
    for ids, block in _blocks(stored(items), block_terms):
        held = stored(postings(docs, spark.sparkContext.broadcast(block.vocabulary), id_col, text_col))
        n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            return out
        # At most a row for each term of the block.
        df = {r["term"]: r["n"] for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
        weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(block.vocabulary))], np.int64)
        shared = spark.sparkContext.broadcast((block.held, weights))

        def rank(batches: Iterator[pa.RecordBatch], shared=shared, n_docs=n_docs, n_terms=n_terms) -> Iterator[pa.RecordBatch]:
            held, weights = shared.value
            rankings: list[list] = [[] for _ in held]
            kind = None
            for batch in batches:
                kind = batch.schema.field("id").type
                for a in range(0, batch.num_rows, block_docs):
                    part = batch.slice(a, block_docs)
                    lists = part.column("terms")
                    doc = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                    block = Block(part.column("n").to_pylist(), doc, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                                  part.column("tfs").flatten().to_numpy(zero_copy_only=False), n_docs, n_terms)
                    ids = part.column("id").to_pylist()
                    for q, item in enumerate(held):
                        rankings[q] = best(block, ids, item, weights, rankings[q], top)
            rows = [(q, None if null else i, -s) for q, ranking in enumerate(rankings) for s, null, i in ranking]
            if rows:
                q, found, score = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(found, kind), pa.array(score, pa.int64())], names=["q", "id", "score"])

        found = _ranked(held.mapInArrow(rank, f"q int, id {kind}, score bigint"), top)
        names = spark.createDataFrame(list(enumerate(ids)), f"q int, item {item_kind}")
        out = out.unionByName(found.join(F.broadcast(names), "q").select("item", "rank", "id", "score"))  # a block of items
    return out


#: The same ranking in DuckDB.
SEARCH_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), stat AS (
  SELECT count(*) FILTER (len(terms) > 0) AS nn, sum(len(terms))::BIGINT AS ll FROM docs
), asked AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), post AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM post, stat GROUP BY term
), long AS (
  SELECT k, doc_id, 100 - 25 + ((25 * len(terms)::BIGINT * nn) // ll) AS m FROM docs, stat WHERE len(terms) > 0
), scored AS (
  SELECT item_id, doc_id, k, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN post USING (term) JOIN weights USING (term) JOIN long USING (k) GROUP BY item_id, doc_id, k
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0
) WHERE rank <= 20"""
