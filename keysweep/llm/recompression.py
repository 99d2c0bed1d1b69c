"""Removal of repeated word passages by recompression.

Rounds name pairs of neighbours: first runs of two equal words, then pairs whose first symbol is in the left and whose second is in
the right half of the names. Names are hashes of their parts, so they are the same in all texts without a
shared table. A pair is decided by its neighbours alone; where a symbol begins is thus fixed by ``2 ** rounds`` words on either
side, and equal passages have equal symbols inside. A window is named after the least of its inner symbols; stretches of windows
with one symbol are compared as a whole by two hashes of all their words, and single windows where such stretches differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from keysweep.llm.common import Codes, semi_join
from keysweep.llm.windows import NONE, Kernel, covered, distinct_texts, least_at, listed, mixed, names_of, parts_of, place_arrays, \
    stretches, text_key, window_hashes, windows_in, with_others
from keysweep.plans.store import release, stored

WINDOW_WORDS = 35
#: Windows of one part of a stretch.
BLOCK = 4
_HALVES = (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5)


def words(text: str) -> list[bytes]:
    """Runs of other characters than ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split()


_codes = Codes(xxhash.xxh64_intdigest)


def codes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_codes.__getitem__, parts), np.uint64, len(parts))


def rounds_for(size: int) -> int:
    """Rounds after which each window still holds a symbol that its words alone decide."""
    n = 0
    while 3 * 2 ** (n + 1) <= size:
        n += 1
    return n


def symbol_starts(x: np.ndarray, rounds: int) -> np.ndarray:
    """Places where the symbols of the last round begin; each has at most ``2 ** rounds`` words."""
    sym, start = x, np.arange(len(x))
    for r in range(rounds):
        if len(sym) < 2:
            break
        if r == 0:
            same = np.concatenate(([False], sym[1:] == sym[:-1], [False]))
            first = same[1:-1] & ~same[:-2] & ~same[2:]
        else:
            left = (mixed(sym + np.uint64(r * _HALVES[0] % (1 << 64))) & np.uint64(1)).astype(bool)
            first = left[:-1] & ~left[1:]
        at = np.flatnonzero(first)
        named = sym.copy()
        named[at] = mixed(sym[at] * np.uint64(_HALVES[0]) + mixed(sym[at + 1] + np.uint64(_HALVES[1])))
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        sym, start = named[stay], start[stay]
    return start


def kernel(size: int) -> Kernel:
    """Names of words, and windows named after the least passage that begins with a symbol inside."""
    rounds = rounds_for(size)
    reach = 2 ** rounds if rounds else 0

    def code(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [words(t) for t in texts]
        return codes([w for p in parts for w in p]), np.array([len(p) for p in parts], np.int64)

    def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(x) < size:
            return NONE
        # The passage from the start of a symbol on, as far as any window reaches that the symbol is inside of.
        passages = window_hashes(x, reach + 1)
        ranks = np.full(len(passages), np.iinfo(np.uint64).max, np.uint64)
        start = symbol_starts(x, rounds)
        start = start[start < len(passages)]
        ranks[start] = passages[start]
        at = reach + least_at(ranks[reach:], size - 2 * reach)
        return ranks[at], at

    return Kernel(size, code, anchors)


def _repeated(found: DataFrame, weight) -> tuple[DataFrame, DataFrame]:
    """``doc, pos, len`` of the stretches whose whole content occurs again; and one place of each content whose name others have."""
    kinds = stored(found.groupBy("name", "h1", "h2").agg(F.sum(weight).alias("n"), F.min("doc").alias("doc"),
                                                         F.min_by("pos", "doc").alias("pos"), F.first("len").alias("len")))
    whole = found.join(kinds.where("n > 1").select("h1", "h2"), ["h1", "h2"], "left_semi").select("doc", "pos", "len")
    differ = stored(kinds.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name"))
    return whole, semi_join(kinds, differ, ["name"]).select("doc", "pos", "len")


def without_repeats(docs: DataFrame, size: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, text, n_words, n_removed, digest``.

    Every word that lies in a window of ``size`` words whose sequence also starts anywhere else, in the same text too,
    goes, all occurrences alike; ``text`` is what stays, joined by single spaces, ``digest`` its SHA-256. Null and
    empty texts have no words; repeated rows and rows with null ids are documents of their own, so copies of ``size`` words or more
    leave nothing. An empty table gives no rows. Only the two columns are read.

    Copies are one text with a weight. Names and windows are counted before they are shuffled.
    """
    texts = distinct_texts(docs, id_col, text_col)
    of = kernel(size)
    named = stored(names_of(texts, of))
    again = stored(named.groupBy("name").agg(F.sum("copies").alias("n")).where("n > 1").select("name"))
    found = stored(stretches(texts, named, again, of, "copies"))
    release(named, again)
    hits, places = _repeated(found, "copies")
    # Where stretches of one name differ, first parts of them, then single windows decide.
    finer = of.finer(min(BLOCK, size))
    more, places = _repeated(with_others(stored(parts_of(texts, places, finer, "copies"))), F.lit(1))
    windows = stored(windows_in(texts, places, of, "copies"))
    twice = stored(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    single = windows.join(twice, ["h1", "h2"], "left_semi").select("doc", "pos", F.lit(1).alias("len"))
    hits = listed(hits.unionByName(more).unionByName(single))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone, digest = [], [], [], []
            for t, places in zip(batch.column("t"), batch.column("places")):
                parts = words(t.as_py())
                pos, length = place_arrays(places)
                out = covered(len(parts), pos, pos + length - 1 + size)
                rest = b" ".join(p for p, o in zip(parts, out.tolist()) if not o)
                kept.append(rest.decode("utf-8", "surrogatepass"))
                total.append(len(parts))
                gone.append(int(out.sum()))
                digest.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(kept, pa.string()), pa.array(total, pa.int64()),
                                              pa.array(gone, pa.int64()), pa.array(digest, pa.string())],
                                             names=["key", "text", "n_words", "n_removed", "digest"])

    done = stored(texts.select("doc", "key", "t").join(hits, "doc", "left").select("key", "t", "places")
                  .mapInArrow(cleaned, "key binary, text string, n_words long, n_removed long, digest string"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text_key(text).alias("key")).join(done, "key") \
        .select("id", "text", "n_words", "n_removed", "digest")
