"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of words are joined over its hash. For each such pair the longest common runs of
words that do not overlap are marked, longest first; the marked share of the item's words tells whether the document
contains it, in whatever order its passages come.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from keysweep.llm.common import Codes, semi_join, unused
from keysweep.plans.store import stored

#: Words of the shortest run that is marked.
RUN_WORDS = 5
#: Share of an item's words that must be marked.
COVERAGE = 0.8
#: Bytes of text whose seeds are held at a time; a longer text alone.
CHUNK = 1 << 20

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


_codes = Codes(lambda word: crc32(word.encode("utf-8", "surrogatepass")) + (len(word) << 32), 1 << 16)


def codes(parts: list[str]) -> np.ndarray:
    """A number for each word, the same everywhere."""
    return np.fromiter(map(_codes.__getitem__, parts), np.uint64, len(parts))


def run_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` numbers."""
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _BASE + (x[k:k + n] ^ (x[k:k + n] >> np.uint64(15))) * np.uint64(0xD1342543DE82EF95)
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def tiles(item: list[str], doc: list[str], size: int = RUN_WORDS) -> list[tuple[int, int, int]]:
    """``(item start, document start, length)`` of greedy tiles of at least ``size`` words.

    The longest match of words unmarked on both sides is marked first; of equally long ones the earliest in the item, then in the document.
    """
    starts: dict[int, list[int]] = {}
    for i, h in enumerate(run_hashes(codes(item), size).tolist()):
        starts.setdefault(h, []).append(i)
    in_doc = run_hashes(codes(doc), size)
    seeds = np.flatnonzero(np.isin(in_doc, np.fromiter(starts, np.int64, len(starts))))
    heap, ends = [], {}  # of each diagonal, the end of the last match seen
    for j, h in zip(seeds.tolist(), in_doc[seeds].tolist()):
        for i in starts[h]:
            if ends.get(i - j, -1) > j:
                continue  # inside a match that began further left
            n = 0
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                n += 1
            if n >= size:  # else only the hashes agreed
                heap.append((-n, i, j))
                ends[i - j] = j + n
    heapq.heapify(heap)
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = free_item[i:i - n] & free_doc[j:j - n]
        if free.all():
            free_item[i:i - n] = free_doc[j:j - n] = False
            out.append((i, j, -n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= size:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def _shingles(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = np.cumsum(pc.fill_null(pc.binary_length(batch.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = np.flatnonzero(np.diff(length // CHUNK, prepend=-1)).tolist()
        for a, b in zip(first, [*first[1:], batch.num_rows]):
            some = batch.slice(a, b - a)
            parts = (codes(words(t.as_py())) for t in some.column("t"))
            seeds = [np.concatenate([run_hashes(x, size) for size in sizes] or [np.zeros(0, np.int64)]) for x in parts]
            at = np.concatenate(([0], np.cumsum([len(s) for s in seeds]))).astype(np.int32)
            values = np.concatenate([*seeds, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([some.column("key"), pa.ListArray.from_arrays(pa.array(at), pa.array(values))], names=["key", "seeds"])


def item_seeds(items: DataFrame, size: int, coverage: float) -> DataFrame:
    """``item, seed, times, needed, size`` of items ``item, t``. An item of fewer than ``size`` words is one seed of its own size."""
    kind = items.schema["item"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("t").to_pylist()):
                parts = words(text)
                own = max(1, min(size, len(parts)))
                seed, times = np.unique(run_hashes(codes(parts), own), return_counts=True)
                # Tiles of ``size`` words need the fewest seeds for the words that they cover: one each.
                needed = max(1, -(-int(np.ceil(coverage * len(parts) - 1e-9)) // own)) if len(parts) >= size else 1
                n = len(seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.as_py()] * n, batch.schema.field("item").type), pa.array(seed), pa.array(times, pa.int64()),
                     pa.array([needed] * n, pa.int64()), pa.array([own] * n, pa.int32())], names=["item", "seed", "times", "needed", "size"])

    return items.mapInArrow(of, f"item {kind}, seed long, times long, needed long, size int")


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", size: int = RUN_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """``key, item, n_words, covered``: each item of which a text marks the share ``coverage`` or more; ``key`` is ``text_key``.

    Pairs are found over shared seeds (runs of ``size`` words), counted per pair of distinct text and item; a pair with fewer seeds
    than the coverage takes is left out, which loses none. Only texts of pairs are then read and tiled. Copies are one text.
    Null and empty texts and items match nothing. An item of fewer than ``size`` words must be in the text as a whole. Items with the same id are items of their own if
    their texts differ; a null item id is an id. An empty table on either side gives no rows.
    """
    items = stored(items.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("t"))
                   .distinct().withColumn("item_key", F.sha2(F.concat_ws("\x1f", F.col("item").cast("string"), F.col("t")), 256)))
    seeds = stored(item_seeds(items.select(F.col("item_key").alias("item"), "t"), size, coverage))
    text = F.col(text_col).cast("string")
    texts = docs.where(text.isNotNull()).select(text_key(text).alias("key"), text.alias("t"))
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # at most ``size``
    # Seeds of copies meet in the partial count below, where their key is the same.
    shared = texts.mapInArrow(lambda b: _shingles(b, sizes), "key string, seeds array<long>") \
        .select("key", F.explode("seeds").alias("seed"))
    shared = semi_join(shared, seeds, ["seed"], "inner").select("key", "item", "seed", "times", "needed").distinct()
    pairs = stored(shared.groupBy("key", "item").agg(F.sum("times").alias("m"), F.max("needed").alias("needed"))
                   .where("m >= needed").select("key", F.col("item").alias("item_key")))
    wanted = stored(pairs.select("key").distinct())
    found = stored(semi_join(texts, wanted, ["key"]).groupBy("key").agg(F.first("t").alias("t")))
    both = pairs.join(found, "key").join(items.select("item_key", "item", F.col("t").alias("item_t")), "item_key")

    kind = items.schema["item"].dataType.simpleString()

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, marked = [], []
            for doc, item in zip(batch.column("t"), batch.column("item_t")):
                a = words(item.as_py())
                totals.append(len(a))
                marked.append(sum(t[2] for t in tiles(a, words(doc.as_py()), max(1, min(size, len(a))))))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("item"), pa.array(totals, pa.int64()),
                                              pa.array(marked, pa.int64())], names=["key", "item", "n_words", "covered"])

    out = both.select("key", "item", "t", "item_t").mapInArrow(tiled, f"key string, item {kind}, n_words long, covered long")
    return out.where(F.col("covered") >= coverage * F.col("n_words") - 1e-9)


def text_key(text):
    return F.sha2(text, 256)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False,
                  **settings) -> DataFrame:
    """One row per row of ``docs``: ``id, contaminated, n_items, item, coverage``.

    ``item`` is the best covered item (of equal ones the smallest id), null without one; ``coverage`` its share. With ``keep`` the rows of
    ``docs`` that contain no item are returned instead, with all their columns. Repeated rows and null ids are
    judged by their texts alone. See ``contained``.
    """
    found = contained(docs, items, id_col, text_col, **settings)
    share = F.col("covered") / F.col("n_words")
    best = stored(found.groupBy("key").agg(F.count("*").alias("n_items"), F.max(share).alias("coverage"),
                                           F.min_by("item", F.struct(-share, "item")).alias("item")))
    key = F.coalesce(text_key(F.col(text_col).cast("string")), F.lit(""))
    if keep:
        own = unused(docs.columns, "_text_key")
        return semi_join(docs.withColumn(own, key), best.select(F.col("key").alias(own)), [own], "left_anti").select(*(f"`{c}`" for c in docs.columns))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"))
    return semi_join(rows, best, ["key"], "left").select(
        "id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "item",
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
