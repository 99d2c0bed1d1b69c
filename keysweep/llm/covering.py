"""SimHash fingerprints and their links within a Hamming radius, found by covering locality-sensitive hashing.

Every bit position gets a nonzero vector of ``radius + 1`` bits; table ``v`` keeps the positions whose vector has
an odd product with ``v``. At most ``radius`` differing positions span too few dimensions to meet all
``2 ** (radius + 1) - 1`` tables, so some table masks out all of them: every pair within the radius collides there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from keysweep.llm.common import semi_join
from keysweep.llm.components import smallest_reachable
from keysweep.plans.store import stored

BITS = 64
SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: Distinct fingerprints that are compared pair by pair within a bucket; larger buckets are linked over common neighbours.
PAIRWISE = 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words give 0.

    Words lie between ASCII white space and are lower-cased in A-Z only; shingles count as often as they occur, and
    a text with fewer words is one shingle.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = np.ascontiguousarray(hashes[at:at + (1 << 15)].astype("<u8")).view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * set_in > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``id, fp``: one row per row of ``docs``, the fingerprint as a signed 64-bit number. Only the two columns are read."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column("t")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return texts.mapInArrow(of, f"id {kind}, fp bigint")


def masks(radius: int = RADIUS) -> list[int]:
    """The bit mask of each table. Position ``i`` has the vector ``i % (2 ** (radius + 1) - 1) + 1``."""
    span = 2 ** (radius + 1)
    return [sum(1 << i for i in range(BITS) if ((i % (span - 1) + 1) & v).bit_count() % 2) for v in range(1, span)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """Links ``a, b`` (``a < b``) that connect any two of the distinct ``fp`` within ``radius`` bits, perhaps over a third.

    Buckets of up to ``pairwise`` fingerprints are compared pair by pair. In larger ones fingerprints are joined to
    common neighbours instead: any two within ``2 * r`` bits have a value within ``r`` bits of both, and all
    that share such a value are within the radius. This takes rows in proportion to the bucket, never its square, and
    finds the same components. Neighbours are one bit away, so it is for a radius of 2; others are refused.
    """
    if radius != 2:
        raise ValueError(f"links are built for a radius of 2, not {radius}")
    tables = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(_signed(m)).alias("m")) for k, m in enumerate(masks(radius))))
    dealt = fps.select("fp", F.explode(tables).alias("t")).select("fp", "t.k", F.col("fp").bitwiseAND(F.col("t.m")).alias("key"))
    sizes = dealt.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = stored(dealt.join(stored(sizes), ["k", "key"]))

    few = sized.where(F.col("n") <= pairwise).groupBy("k", "key").agg(F.sort_array(F.collect_list("fp")).alias("all"))
    pairs = few.select("all", F.posexplode("all").alias("i", "a")).select(
        "a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)

    # In a bucket, fingerprints differ only where its mask has a zero.
    free = F.element_at(F.array(*(F.lit(_signed(~m & (2 ** BITS - 1))) for m in masks(radius))), F.col("k") + 1)
    many = sized.where(F.col("n") > pairwise).groupBy("fp").agg(F.bit_or(free).alias("free"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(BITS)))
    flips = F.filter(flips, lambda x: x.bitwiseAND(F.col("free")) == x)
    many = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    stars = many.groupBy("near").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select("a", F.explode("all").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                    words: int = SHINGLE_WORDS) -> DataFrame:
    """``id, fp, component``: the component is the smallest id that is reachable over links, the own one included.

    One row per row of ``docs``, repeated rows too. Null and empty texts have fingerprint 0 and are linked like any
    other. A null id is never smallest; a component of null ids alone is null. An empty table gives no rows.

    Documents with the same fingerprint are one node from the start, so copies are never paired.
    """
    rows = stored(fingerprints(docs, id_col, text_col, words))
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")))
    edges = stored(links(nodes.select("fp"), radius))
    found = smallest_reachable(nodes, edges)
    # Both sides are stored tables, so a fingerprint of many documents is split at run time.
    return rows.join(found, "fp").select("id", "fp", "component")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                            words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns.

    An id is one document: all its rows stay, or go if any of them is in a component with a smaller id. Rows with a null
    id stay. Only ids of dropped rows are joined back, never texts shuffled for it unless those ids outgrow a broadcast.
    """
    found = near_duplicates(docs, id_col, text_col, radius, words)
    lost = stored(found.where("id > component").select(F.col("id").alias(id_col)).distinct())
    return semi_join(docs, lost, [id_col], "left_anti").select(*(f"`{c}`" for c in docs.columns))
