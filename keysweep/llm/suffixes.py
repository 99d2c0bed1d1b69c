"""Removal of byte strings that an earlier document holds, by a logarithmic family of suffix arrays.

The arrays are sparse: of all suffixes they hold those that begin at an anchor. Every string of the match length has one anchor inside,
which its bytes alone decide, so equal strings have theirs at the same place. An array orders the suffixes by a hash of their first bytes, in
buckets, and says which chunk of documents each is from.

A new batch of documents is sorted into an array of its own and merge-scanned with itself and with every level of the family: suffixes that
begin alike in several documents are candidates. For these alone the bytes around the anchor meet, where equal strings of the match length
are brought together and get their smallest document. Then the batch becomes a level; levels of equal rank merge into one of the
next, so there are logarithmically many. Levels and chunks stay where they are written, so later batches can meet them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from keysweep.llm.common import SMALL_BYTES
from keysweep.llm.windows import BASES, _spread, covered, least_at, mixed, window_hashes
from keysweep.plans.store import release, size_in_bytes, stored

MATCH_BYTES = 50
BATCHES = 2
#: Bytes of text of a chunk, a longer text alone; and of what a bucket holds suffixes of, on average.
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: Windows whose anchors are looked for at a time.
SLICE = 1 << 21
#: Bits of the hash of a suffix's first bytes.
NAME_BITS = 48
LAST = (1 << 63) - 1

#: A number for each byte value.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))
_CHUNKS = "chunk long, n array<long>, known array<boolean>, sizes array<int>, data binary, lengths binary, offsets binary"
_NAMES = "bucket int, chunk long, names binary, several binary"
_LEVEL = "bucket int, names binary, chunks binary"
_SCANNED = "kind int, bucket int, chunk long, a binary, b binary"
_BYTES_OF = "bucket int, chunk long, fresh boolean, lengths binary, offsets binary, least binary, data binary"
_ANSWERS = "bucket int, chunk long, which binary, least binary"


def _pack(x: np.ndarray) -> bytes:
    """Numbers byte by byte, so that bytes of one rank lie together."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(kind).reshape(-1)


def _pack_rising(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=x.dtype.type(0)))


def _unpack_rising(data: bytes, kind: str = "<u8") -> np.ndarray:
    return np.cumsum(_unpack(data, kind), dtype=kind)


def _inner(size: int) -> int:
    return max(1, size // 3)


def stretches(data: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows in a row with one anchor, of some texts in a row: how many there are, and how far into the first the anchor lies.

    The anchor of a window is where the least hash of a third of its length lies. Windows that lie in two texts do not count.
    """
    inner = _inner(size)
    begin = np.cumsum(sizes) - sizes
    windows = _spread(begin, np.maximum(sizes - size + 1, 0))
    lengths, offsets = [], []
    for a in range(0, len(windows), SLICE):
        some = windows[a:a + SLICE]
        low = some[0]
        ranks = window_hashes(_BYTES[data[low:some[-1] + size]], inner)
        at = least_at(ranks, size - inner + 1)[some - low].astype(np.int64) + low
        first = np.flatnonzero(np.diff(at, prepend=-1))
        lengths.append(np.diff(np.append(first, len(some))))
        offsets.append(at[first] - some[first])
    if not lengths:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(lengths), np.concatenate(offsets)


def names_at(data: np.ndarray, anchor: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first bytes of the suffixes that begin at ``anchor``."""
    out = np.zeros(len(anchor), np.uint64)
    for k in range(_inner(size)):
        out = out * np.uint64(BASES[1]) + _BYTES[data[anchor + k]]
    return mixed(mixed(out)) >> np.uint64(64 - NAME_BITS)


class _Chunk:
    """A row of the table of chunks, unpacked."""

    def __init__(self, row: dict, size: int):
        self.size, self.chunk = size, row["chunk"]
        self.raw = zstandard.ZstdDecompressor().decompress(row["data"]) if row["data"] else b""
        self.data = np.frombuffer(self.raw, np.uint8)
        self.sizes = np.array(row["sizes"], np.int64)
        self.n = np.array(row["n"], np.int64)
        kind = np.min_scalar_type(size)
        self.length, self.offset = (_unpack(row[c], kind.str).astype(np.int64) for c in ("lengths", "offsets"))
        self.begin = np.cumsum(self.sizes) - self.sizes
        count = np.maximum(self.sizes - size + 1, 0)
        windows = _spread(self.begin, count)
        # Of each stretch: its first window, and its document.
        self.first = windows[np.cumsum(self.length) - self.length]
        self.doc = np.searchsorted(self.begin + self.sizes, self.first, side="right")
        names = names_at(self.data, self.first + self.offset, size)
        self.order = np.argsort(names, kind="stable")
        names = names[self.order]
        self.at = np.flatnonzero(np.diff(names.astype(np.int64), prepend=-1))
        self.names = names[self.at]

    def buckets(self, count: int) -> Iterator[tuple[int, int, int]]:
        """Number of a bucket, and where its distinct names begin and end."""
        of = ((self.names >> np.uint64(NAME_BITS - 32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        return zip(of[first].tolist(), first.tolist(), np.append(first[1:], len(of)).tolist())  # none without names

    def several(self) -> np.ndarray:
        """Names that several documents of the chunk have."""
        last = np.append(self.at[1:], len(self.order))[:len(self.at)] - 1
        return self.doc[self.order[self.at]] != self.doc[self.order[last]]

    def candidates(self, count: int, bits: list[dict]) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
        """By bucket: the distinct byte strings of the candidate stretches, and of each stretch its number and that of its bytes."""
        chosen = {b["bucket"]: np.unpackbits(np.frombuffer(b["a"], np.uint8)).astype(bool) for b in bits}
        ends = np.append(self.at[1:], len(self.order))[:len(self.at)]
        for bucket, a, b in self.buckets(count):
            if bucket not in chosen:
                continue
            which = np.flatnonzero(chosen[bucket][:b - a]) + a
            held = self.order[_spread(self.at[which], ends[which] - self.at[which])]
            number: dict[bytes, int] = {}
            low, high = self.first[held].tolist(), (self.first[held] + self.length[held] - 1 + self.size).tolist()
            own = np.array([number.setdefault(self.raw[x:y], len(number)) for x, y in zip(low, high)], np.int64)
            yield bucket, list(number), held, own

    def least(self, own: np.ndarray, held: np.ndarray, n: int) -> np.ndarray:
        """The smallest document of each of ``n`` byte strings."""
        out = np.full(n, LAST, np.int64)
        np.minimum.at(out, own, self.n[self.doc[held]])
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _fields(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()),
             "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def chunks(docs: DataFrame, batch_number: int, size: int, chunk_bytes: int) -> DataFrame:
    """Chunks of the documents ``id, t`` with their stretches; a null id is larger than any other."""
    schema, kind = _fields(_CHUNKS), np.min_scalar_type(size)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = batch_number << 48 | TaskContext.get().partitionId() << 24
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            data, sizes = b"".join(texts), np.array([len(t) for t in texts], np.int64)
            lengths, offsets = stretches(np.frombuffer(data, np.uint8), sizes, size)
            row = (number, [LAST if i is None else i for i in ids], [i is not None for i in ids], sizes.tolist(),
                   zstandard.ZstdCompressor(level=3).compress(data), _pack(lengths.astype(kind)), _pack(offsets.astype(kind)))
            return _batch([row], schema)

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("t")):
                ids.append(i)
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1]) + 16
                if held >= chunk_bytes:
                    yield out()
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield out()

    return docs.select("id", "t").mapInArrow(of, _CHUNKS)


def suffix_names(held: DataFrame, size: int, buckets: int) -> DataFrame:
    """Of each chunk and bucket the distinct names of its suffixes in order, and which ones several of its documents have."""
    schema = _fields(_NAMES)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = _Chunk(row, size)
            several = chunk.several()
            rows = [(k, chunk.chunk, _pack_rising(chunk.names[a:b]), np.packbits(several[a:b]).tobytes()) for k, a, b in chunk.buckets(buckets)]
            if rows:
                yield _batch(rows, schema)

    return held.mapInArrow(of, _NAMES)


def _merge_scan(fresh: pa.Table, old: pa.Table) -> list[tuple]:
    """Rows of ``_SCANNED`` for a bucket: candidates of each chunk (kind 0, bits over its names), and the batch's array (kind 1)."""
    if not fresh.num_rows:
        return []
    names, chunk, several = [], [], []
    for row in fresh.to_pylist():
        names.append(_unpack_rising(row["names"]))
        chunk.append(np.full(len(names[-1]), row["chunk"], np.int64))
        several.append(np.unpackbits(np.frombuffer(row["several"], np.uint8))[:len(names[-1])].astype(bool))
    n_fresh = sum(map(len, names))
    for row in old.to_pylist():
        names.append(_unpack_rising(row["names"]))
        chunk.append(_unpack(row["chunks"], "<i8"))
        several.append(np.zeros(len(names[-1]), bool))
    name, chunk, several = map(np.concatenate, (names, chunk, several))
    order = np.argsort(name, kind="stable")  # merges runs that are in order
    first = np.flatnonzero(np.diff(name[order].astype(np.int64), prepend=-1))
    length = np.diff(np.append(first, len(order)))
    is_fresh = (order < n_fresh)
    wanted = ((length > 1) | np.logical_or.reduceat(several[order], first)) & np.logical_or.reduceat(is_fresh, first)
    chosen = np.zeros(len(name), bool)
    chosen[order] = np.repeat(wanted, length)
    bucket = fresh.column("bucket")[0].as_py()
    out = []
    by_chunk = np.lexsort((name, chunk))
    edges = np.flatnonzero(np.diff(chunk[by_chunk], prepend=chunk[by_chunk[0]] - 1))
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(by_chunk)).tolist()):
        bits = chosen[by_chunk[a:b]]
        if bits.any():
            out.append((0, bucket, int(chunk[by_chunk[a]]), np.packbits(bits).tobytes(), None))
    own = order[is_fresh]
    return [*out, (1, bucket, None, _pack_rising(name[own]), _pack(chunk[own]))]


def candidate_bytes(held: DataFrame, size: int, buckets: int, fresh_from: int) -> DataFrame:
    """Of each chunk (with its ``bits``) and bucket the distinct byte strings of candidates, each with its smallest document."""
    schema = _fields(_BYTES_OF)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = _Chunk(row, size)
            kind = np.min_scalar_type(2 * size)
            for bucket, found, which, own in chunk.candidates(buckets, row["bits"]):
                lengths, offsets = np.array([len(f) for f in found], kind), np.zeros(len(found), kind)
                offsets[own] = chunk.offset[which]
                yield _batch([(bucket, chunk.chunk, chunk.chunk >= fresh_from, _pack(lengths), _pack(offsets), _pack(chunk.least(own, which, len(found))),
                               zstandard.ZstdCompressor(level=1).compress(b"".join(found)))], schema)

    return held.mapInArrow(of, _BYTES_OF)


def smallest(found: list[bytes], least: np.ndarray, size: int) -> list[np.ndarray]:
    """For each window of each distinct byte string, the smallest document (of ``least``, by string) that has the window."""
    data = np.frombuffer(b"".join(found) + bytes(8), np.uint8)
    lengths = np.array([len(f) for f in found], np.int64)
    count = lengths - size + 1
    at = _spread(np.cumsum(lengths) - lengths, count)
    doc = np.repeat(least, count)
    # Numbers of 8 bytes; the last one ends where the window does, or there are bytes one by one.
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").reshape(-1)
    keys = [words[at + s] for s in [*range(0, size - 8, 8), size - 8]] if size >= 8 else [data[at + s].astype(np.uint64) for s in range(size)]
    hashed = np.zeros(len(at), np.uint64)
    for key in keys:
        hashed = mixed((hashed ^ key) * np.uint64(BASES[0]))
    order = np.argsort(hashed, kind="stable")
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    # Neighbours are equal if their bytes are.
    for key in keys:
        ordered = key[order]
        changed[1:] |= ordered[1:] != ordered[:-1]
    first = np.flatnonzero(changed)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
    return np.split(out, np.cumsum(count)[:-1])


def _answers(table: pa.Table, size: int) -> list[tuple]:
    """Rows of ``_ANSWERS`` for a bucket: where a chunk's own smallest document of a byte string is not that of all its windows."""
    kind = np.min_scalar_type(2 * size).str
    rows, number, least, offsets = [], {}, [], []
    for row in table.to_pylist():
        data, at, own = zstandard.ZstdDecompressor().decompress(row["data"]), 0, []
        for length, offset, doc in zip(*(_unpack(row[c], k).tolist() for c, k in (("lengths", kind), ("offsets", kind), ("least", "<i8")))):
            k = number.setdefault(data[at:at + length], len(number))
            at += length
            if k == len(least):
                least.append(doc)
                offsets.append(offset)
            elif doc < least[k]:
                least[k] = doc
            own.append((k, doc))
        if row["fresh"]:
            rows.append((row["bucket"], row["chunk"], own))
    # Only strings around the same suffix can share windows, and alone around it a string's smallest document is that of all its windows.
    strings, least = list(number), np.array(least, np.int64)
    lengths = np.array([len(s) for s in strings], np.int64)
    name = names_at(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths + np.array(offsets, np.int64), size)
    _, same, times = np.unique(name, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[same] > 1).tolist()
    found = dict(zip(several, smallest([strings[k] for k in several], least[several], size) if several else ()))
    lowest = least.tolist()
    for k, f in found.items():
        lowest[k] = int(f.min())
    out = []
    for bucket, chunk, own in rows:
        which = [i for i, (k, doc) in enumerate(own) if lowest[k] < doc]
        if which:
            out.append((bucket, chunk, _pack(np.array(which, "<u4")), _pack(np.concatenate([found[k] if k in found else np.full(lengths[k] - size + 1, least[k]) for k in (own[i][0] for i in which)]))))
    return out


def _with(held: DataFrame, rows: DataFrame, columns: list[str], name: str, how: str = "inner", small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Chunks with the stored ``rows`` about them as a list; these are broadcast if their measured size allows."""
    small = size_in_bytes(rows) <= small_bytes
    lists = rows.groupBy("chunk").agg(F.collect_list(F.struct(*columns)).alias(name))  # a row for each bucket and chunk at most
    return held.join(F.broadcast(lists) if small else lists, "chunk", how)


def cleaned(held: DataFrame, size: int, buckets: int) -> DataFrame:
    """Rows of documents from chunks with their ``bits`` and ``answers``."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("digest", pa.string()), ("spans", kind)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = _Chunk(row, size)
            answers = {a["bucket"]: a for a in row["answers"] or []}
            starts = []
            for bucket, found, which, own in chunk.candidates(buckets, row["bits"] or []):
                mine, doc = chunk.least(own, which, len(found)), chunk.n[chunk.doc[which]]
                least: dict[int, np.ndarray] = {}
                if bucket in answers:
                    at = _unpack(answers[bucket]["which"], "<u4").tolist()
                    count = [len(found[i]) - size + 1 for i in at]
                    least = dict(zip(at, np.split(_unpack(answers[bucket]["least"], "<i8"), np.cumsum(count)[:-1])))
                # Without an answer the chunk's own smallest document is that of all windows.
                for stretch, i, d, m in zip(which.tolist(), own.tolist(), doc.tolist(), mine[own].tolist()):
                    first, length = int(chunk.first[stretch]), int(chunk.length[stretch])
                    if i in least:
                        starts.append(first + np.flatnonzero(least[i] < d))
                    elif m < d:
                        starts.append(np.arange(first, first + length))
            start = np.concatenate([*starts, np.zeros(0, np.int64)])
            gone = covered(len(chunk.data), start, start + size)
            rows = []
            for n, known, a, length in zip(chunk.n.tolist(), row["known"], chunk.begin.tolist(), chunk.sizes.tolist()):
                out, data = gone[a:a + length], chunk.data[a:a + length]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0])))).tolist()
                spans = [{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2])]
                rows.append((n if known else None, length, int(out.sum()), len(spans), hashlib.sha256(data[~out].tobytes()).hexdigest(), spans))
            yield _batch(rows, schema)

    return held.mapInArrow(of, "id long, n_bytes long, n_removed long, n_spans long, digest string, spans array<struct<start:long,end:long>>")


class SuffixFamily:
    """Levels of suffix arrays and the chunks that they point into, kept between batches.

    ``buckets`` is fixed for the life of a family: about so many as keep a bucket's share of all text small.
    """

    def __init__(self, spark: SparkSession, size: int = MATCH_BYTES, buckets: int = 64, chunk_bytes: int = CHUNK_BYTES):
        self.spark, self.size, self.buckets, self.chunk_bytes = spark, size, buckets, chunk_bytes
        self.levels: list[tuple[int, DataFrame]] = []  # rank and array
        self.chunks: list[DataFrame] = []

    def add(self, docs: DataFrame) -> DataFrame:
        """Judge the batch ``id, t`` by itself and all earlier batches, and keep it.

        Rows as ``without_earlier`` gives them, stored. A document is judged when it comes: a later batch with smaller ids does not
        change what was returned.
        """
        size, buckets = self.size, self.buckets
        number = len(self.chunks) + 1
        own = stored(chunks(docs, number, size, self.chunk_bytes))
        levels = self.spark.createDataFrame([], _LEVEL)
        for _, level in self.levels:
            levels = levels.unionByName(level)
        scanned_as, level_as = _fields(_SCANNED), _fields(_LEVEL)

        def merge_scan(fresh, old):
            rows = _merge_scan(fresh, old)
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), scanned_as)] if rows else [pa.array([], f.type) for f in scanned_as], schema=scanned_as)

        names = suffix_names(own, size, buckets)
        scanned = stored(names.groupBy("bucket").cogroup(levels.groupBy("bucket")).applyInArrow(merge_scan, _SCANNED))
        bits = stored(scanned.where("kind = 0").select("chunk", "bucket", "a"))
        every = own
        for old in self.chunks:
            every = every.unionByName(old)
        found = candidate_bytes(_with(every, bits, ["bucket", "a"], "bits"), size, buckets, number << 48)
        answers_as = _fields(_ANSWERS)

        def answer(table):
            rows = _answers(table, size)
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), answers_as)] if rows else [pa.array([], f.type) for f in answers_as], schema=answers_as)

        answers = stored(found.groupBy("bucket").applyInArrow(answer, _ANSWERS))
        judged = _with(_with(own, bits, ["bucket", "a"], "bits", "left"), answers, ["bucket", "which", "least"], "answers", "left", 1 << 20)
        out = stored(cleaned(judged, size, buckets))

        level = stored(scanned.where("kind = 1").select("bucket", F.col("a").alias("names"), F.col("b").alias("chunks")))
        release(scanned, bits, answers)
        self.chunks.append(own)
        self.levels.append((0, level))

        def merge(table):
            names = np.concatenate([_unpack_rising(x.as_py()) for x in table.column("names")])
            chunk = np.concatenate([_unpack(x.as_py(), "<i8") for x in table.column("chunks")])
            order = np.argsort(names, kind="stable")
            return pa.Table.from_arrays([table.column("bucket").combine_chunks().slice(0, 1), pa.array([_pack_rising(names[order])], pa.binary()),
                                         pa.array([_pack(chunk[order])], pa.binary())], schema=level_as)

        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, one), (_, two) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, stored(two.unionByName(one).groupBy("bucket").applyInArrow(merge, _LEVEL))))
            release(one, two)
        return out

    def drop(self) -> None:
        """Delete what is kept."""
        release(*self.chunks, *(level for _, level in self.levels))
        self.levels, self.chunks = [], []


def without_earlier(docs: DataFrame, size: int = MATCH_BYTES, id_col: str = "doc_id", text_col: str = "text",
                    batches: int = BATCHES, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``id, n_bytes, n_removed, n_spans, digest, spans``, for whole-number ids.

    Each byte (UTF-8) covered by ``size`` bytes that also start in a document with a smaller id goes; ``spans`` are the removed
    runs as ``(start, end)``, ``digest`` is the SHA-256 of the bytes that stay. Null and empty texts have no bytes. A null id is larger
    than any other; rows with the same id do not remove each other's bytes. An empty table gives no rows. Only the
    two columns are read. Documents go into a new family in ``batches`` of rising ids; use ``SuffixFamily`` to keep one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    total, cuts = rows.agg(F.sum(F.octet_length("t")), F.percentile_approx("id", [i / batches for i in range(1, batches)] or [1.0], 10_000)).first()
    edges = [None, *(sorted(set(cuts or [])) if batches > 1 else []), None]
    family = SuffixFamily(spark, size, max(1, -(-(total or 0) // bucket_bytes)), chunk_bytes)
    out = None
    for low, high in zip(edges, edges[1:]):
        # Null ids are last.
        part = rows if low is None else rows.where(F.col("id").isNull() | (F.col("id") > low))
        part = part if high is None else part.where(F.col("id") <= high)
        done = family.add(part)
        out = done if out is None else out.unionByName(done)
    family.drop()
    return out
