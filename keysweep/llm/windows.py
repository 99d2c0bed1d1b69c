"""Windows of fixed length over sequences of numbers, and the search for those that occur again.

Each window has an anchor, a place inside it that its content alone decides, and is named after what stands there. Windows in a row with the
same anchor are a stretch. Stretches are compared as a whole first; single windows only where stretches of one name differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from keysweep.llm.common import semi_join
from keysweep.plans.store import release, stored

#: Odd, so that powers can be undone modulo 2 ** 64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Rows of one Arrow batch that a task hands on.
BATCH = 1 << 16

#: Bytes of text that are worked on at a time; longer texts are alone.
CHUNK = 1 << 20

#: Numbers of some texts in a row, and how many each has.
Code = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
#: For such numbers: the name and the anchor of every window, also of those that lie in two texts.
Anchors = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
NONE = np.zeros(0, np.uint64), np.zeros(0, np.int64)


class Kernel(NamedTuple):
    size: int
    code: Code
    anchors: Anchors

    def finer(self, block: int) -> "Kernel":
        """Anchors less than ``block`` into the window, with longer names: of all that such a stretch has in common."""
        core = self.size - block + 1

        def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = self.anchors(x)[1]
            start = np.arange(len(at))
            at = start + (at - start) % block
            return (window_hashes(x, core)[at], at) if len(at) else NONE

        return Kernel(self.size, self.code, anchors)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def piece_hashes(x: np.ndarray, a: np.ndarray, b: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hashes of the numbers from each ``a`` to before its ``b``, by prefix sums of a polynomial modulo 2 ** 64."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * _powers(base, len(x)), dtype=np.uint64)))
    down = _powers(pow(base, -1, 1 << 64), len(x) + 1)
    return mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def window_hashes(x: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """Hashes of all windows of ``size`` numbers."""
    n = max(0, len(x) - size + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * _powers(base, len(x)), dtype=np.uint64)))
    return mixed((sums[size:] - sums[:-size]) * _powers(pow(base, -1, 1 << 64), n)) if n else np.zeros(0, np.uint64)


def least_at(x: np.ndarray, width: int) -> np.ndarray:
    """Where the minimum of each ``width`` numbers in a row lies, the first of equal ones; by doubling."""
    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[b] < x[a], b, a)

    at, have = np.arange(len(x), dtype=np.int32 if len(x) < 1 << 31 else np.int64), 1
    while 2 * have <= width:
        at = least(at[:-have], at[have:])
        have *= 2
    return least(at[:len(at) - (width - have)], at[width - have:]) if width > have else at


def _runs(change: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run, where ``change`` tells which places but the first begin one."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, n), bool), change)))
    return first, np.diff(np.append(first, n))


def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``begin``."""
    return np.arange(length.sum()) + np.repeat(begin - np.cumsum(length) + length, length)


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, key, t, least, copies``: each text once; null is empty. ``doc`` is a number of its own, ``least`` the
    smallest id, null if all are."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    once = docs.select(F.col(id_col).alias("id"), text.alias("t")).groupBy(text_key("t").alias("key")) \
        .agg(F.first("t").alias("t"), F.min("id").alias("least"), F.count("*").alias("copies"))
    return stored(once.select(F.monotonically_increasing_id().alias("doc"), "*"))


def text_key(text):
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _batches(rows: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``BATCH`` rows from pieces of any size."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)

    for piece in rows:
        for a in range(0, len(piece[0]), BATCH):
            held.append(tuple(c[a:a + BATCH] for c in piece))
            n += len(held[-1][0])
            if n >= BATCH:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def _chunks(batches: Iterator[pa.RecordBatch], code: Code):
    """Rows of some texts (without ``t``), their numbers in a row, and where each text begins and how many it has."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1):
            part = batch.slice(rows[0], len(rows)) if len(rows) else batch.slice(0, 0)
            x, n = code(part.column("t").to_pylist())
            yield part, x, np.cumsum(n) - n, n


def _numbers(part: pa.RecordBatch, column: str) -> np.ndarray:
    return part.column(column).to_numpy(zero_copy_only=False)


def _stretches(x, begin, n, kernel: Kernel):
    """Text, first window, length and name of each stretch. Equal windows have their anchors equally far in, so none are in one."""
    names, at = kernel.anchors(x)
    count = np.maximum(n - kernel.size + 1, 0)
    window = _spread(begin, count)
    first, length = _runs(np.diff(at[window]) != 0, len(window))
    return np.repeat(np.arange(len(n)), count)[first], window[first], length, names[window[first]].view(np.int64)


def names_of(texts: DataFrame, kernel: Kernel) -> DataFrame:
    """``doc, name, copies``: a row for each stretch of windows."""
    def rows(batches: Iterator[pa.RecordBatch]):
        for part, x, begin, n in _chunks(batches, kernel.code):
            text, _, _, name = _stretches(x, begin, n, kernel)
            yield _numbers(part, "doc")[text], name, _numbers(part, "copies")[text]

    return texts.select("doc", "t", "copies").mapInArrow(lambda b: _batches(rows(b), ["doc", "name", "copies"]), "doc long, name long, copies long")


def _place_rows(part, x, begin, text, first, length, name, kernel: Kernel, carry: str):
    end = first + length - 1 + kernel.size
    return (_numbers(part, "doc")[text], (first - begin[text]).astype(np.int32), length.astype(np.int32), name,
            *(piece_hashes(x, first, end, b).view(np.int64) for b in BASES), _numbers(part, carry)[text])


def stretches(texts: DataFrame, named: DataFrame, again: DataFrame, kernel: Kernel, carry: str) -> DataFrame:
    """``doc, pos, len, name, h1, h2`` and the column ``carry`` of ``texts``: the stretches whose name is in ``again``,
    with two hashes of all that their windows cover. Names of a text are held as one list, no longer than the text."""
    wanted = semi_join(named.select("doc", "name"), again, ["name"]).groupBy("doc").agg(F.collect_set("name").alias("names"))

    def rows(batches: Iterator[pa.RecordBatch]):
        for part, x, begin, n in _chunks(batches, kernel.code):
            found = _stretches(x, begin, n, kernel)
            of = np.isin(found[3], part.column("names").flatten().to_numpy())
            yield _place_rows(part, x, begin, *(c[of] for c in found), kernel, carry)

    columns = ["doc", "pos", "len", "name", "h1", "h2", carry]
    return texts.select("doc", "t", carry).join(wanted, "doc") \
        .mapInArrow(lambda b: _batches(rows(b), columns), f"doc long, pos int, len int, name long, h1 long, h2 long, {carry} long")


def parts_of(texts: DataFrame, places: DataFrame, kernel: Kernel, carry: str) -> DataFrame:
    """As ``stretches``: those of a finer kernel among the windows of ``places`` (``doc, pos, len``)."""
    def rows(batches: Iterator[pa.RecordBatch]):
        for part, x, begin, n in _chunks(batches, kernel.code):
            names, at = kernel.anchors(x)
            text, pos, length = _places(part)
            window, text = _spread(begin[text] + pos, length), np.repeat(text, length)
            order = np.argsort(window, kind="stable")
            window, text = window[order], text[order]
            first, length = _runs((np.diff(window) != 1) | (np.diff(at[window]) != 0), len(window))
            yield _place_rows(part, x, begin, text[first], window[first], length, names[window[first]].view(np.int64), kernel, carry)

    columns = ["doc", "pos", "len", "name", "h1", "h2", carry]
    return texts.select("doc", "t", carry).join(listed(places), "doc") \
        .mapInArrow(lambda b: _batches(rows(b), columns), f"doc long, pos int, len int, name long, h1 long, h2 long, {carry} long")


def with_others(places: DataFrame) -> DataFrame:
    """The stored ``places`` whose name occurs more than once; ``places`` are released."""
    shared = stored(places.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name"))
    out = stored(semi_join(places, shared, ["name"]))
    release(places, shared)
    return out


def listed(places: DataFrame) -> DataFrame:
    """``doc, places``: the stretches (``pos, len``) of each text as one list, no longer than the text."""
    return places.groupBy("doc").agg(F.collect_list(F.struct("pos", "len")).alias("places"))


def place_arrays(places: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """``pos, len`` of one list made by ``listed``."""
    if not places.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(places.values.field(c).to_numpy().astype(np.int64) for c in ("pos", "len"))


def _places(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, ``pos`` and ``len`` of all places of some texts."""
    places = part.column("places")
    flat = places.flatten()
    return pc.list_parent_indices(places).to_numpy().astype(np.int64), *(flat.field(c).to_numpy().astype(np.int64) for c in ("pos", "len"))


def windows_in(texts: DataFrame, places: DataFrame, kernel: Kernel, carry: str) -> DataFrame:
    """``doc, pos, h1, h2`` and the column ``carry``: each window of the stretches ``places`` (``doc, pos, len``)."""
    def rows(batches: Iterator[pa.RecordBatch]):
        for part, x, begin, _ in _chunks(batches, kernel.code):
            text, pos, length = _places(part)
            at, text = _spread(begin[text] + pos, length), np.repeat(text, length)
            yield (_numbers(part, "doc")[text], (at - begin[text]).astype(np.int32),
                   *(piece_hashes(x, at, at + kernel.size, b).view(np.int64) for b in BASES), _numbers(part, carry)[text])

    columns = ["doc", "pos", "h1", "h2", carry]
    return texts.select("doc", "t", carry).join(listed(places), "doc") \
        .mapInArrow(lambda b: _batches(rows(b), columns), f"doc long, pos int, h1 long, h2 long, {carry} long")


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie from one of ``starts`` to before its end."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
