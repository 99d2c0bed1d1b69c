"""Phrase collocations, counted in burst tries over word numbers.

Every place of a text is a path of words. Tasks count paths in a trie: its leaves are hash tables that hold ranges of paths and burst into
narrower ones, by the first word, then the next. When a task holds too much, whole subtrees leave it as sorted runs, cut by a hash of
their first words, and the runs of one such prefix partition are merged wherever Spark puts it.

Words are counted first, then pairs of words that may be frequent, then paths of three and four whose pairs may be: a phrase is never more
frequent than a part of it. A filter of fixed size tells which may be; what it lets through needlessly only costs time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from keysweep.plans.skew import skew_join
from keysweep.plans.store import size_in_bytes, stored

MAX_WORDS = 4
MIN_COUNT = 30
TOP = 2000
#: A longer candidate with so large a part of the occurrences (in percent) covers what it holds.
COVERING = 80
NO_LANG = "und"

#: Entries of a leaf before it bursts, and of a task's tries before subtrees are spilled.
LEAF_ENTRIES = 1 << 14
TRIE_ENTRIES = 1 << 21
#: Numbers of words in paths of four, 16 bits each; 0 is none. Pairs have 32 bits for each.
MAX_WORD_IDS = (1 << 16) - 1
#: Text bytes of a prefix partition, on average; a partition is merged in one piece.
PART_BYTES = 16 << 20
#: Buckets of the filter of words that may be frequent, a fixed number. Full buckets make it pass more, never less.
FILTER_BITS = 1 << 24
#: Words that a task counts before it hands the counts on.
COUNTED_WORDS = 1 << 18
#: Bytes of text, and words, that are worked on at a time.
CHUNK, STEP = 1 << 20, 1 << 17
#: Words that a task remembers the numbers of.
KNOWN_WORDS = 1 << 18

_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Breaks are newlines, tabs are blanks, A-Z are lower-cased.
_PLAIN = bytes(10 if c in _BREAKS else 32 if c == 9 else c for c in range(256)).lower()
_BLANK = re.compile(rb"[ \n]")
_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9)


def words(data: bytes) -> Iterator[list[bytes]]:
    """Words in order, with ``b"\\n"`` between pieces, about ``CHUNK`` bytes at a time."""
    data, at = data.translate(_PLAIN), 0
    while at < len(data):
        cut = _BLANK.search(data, at + CHUNK)
        end = cut.end() if cut else len(data)
        yield [w for w in data[at:end].replace(b"\n", b" \n ").split(b" ") if w]
        at = end


def steps(data: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Some words in a row, and how many of them are places of their own; the others are those that follow."""
    rest: list[bytes] = []
    for found in words(data):
        rest += found
        at = 0
        while len(rest) - at >= STEP + MAX_WORDS:
            yield rest[at:at + STEP + MAX_WORDS - 1], STEP
            at += STEP
        rest = rest[at:]
    for at in range(0, len(rest), STEP):
        piece = rest[at:at + STEP + MAX_WORDS - 1]
        yield piece, min(STEP, len(piece))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Language and texts of some documents of it, with breaks between them."""
    held: dict[str, list[bytes]] = {}
    size, total = Counter(), 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("t")):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            held.setdefault(lang, []).append(data)
            size[lang] += len(data)
            total += len(data)
            if size[lang] >= CHUNK or total >= 8 * CHUNK:
                full = [lang] if size[lang] >= CHUNK else list(held)
                for lang in full:
                    yield lang, b"\n".join(held.pop(lang))
                    total -= size.pop(lang)
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass") + b"\n" + word)


def joint_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash for the hashes of some words in a row (along the last axis)."""
    out = np.zeros(hashes.shape[:-1], np.uint64)
    for k in range(hashes.shape[-1]):
        out = (out ^ hashes[..., k]) * np.uint64(_ODD[k % 3])
        out ^= out >> np.uint64(29)
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, word, f``, aggregated."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out(lang: str) -> pa.RecordBatch:
            counts = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()),
                                               pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "f"])

        for lang, data in _chunks(batches):
            counts = held.setdefault(lang, Counter())
            for found in words(data):
                counts.update(found)
            counts.pop(b"\n", None)
            if sum(map(len, held.values())) >= COUNTED_WORDS:
                yield from [out(known) for known in list(held)]
        yield from [out(known) for known in list(held)]

    counted = texts.mapInArrow(of, "lang string, word binary, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return counted.withColumn("word", F.col("word").cast("string"))


def _filter(frequent: DataFrame) -> np.ndarray:
    """A bit for the hash of each phrase (``lang, phrase``, of one length all), ``FILTER_BITS`` in all."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.array([[word_hash(lang, w) for w in phrase.encode("utf-8", "surrogatepass").split(b" ")]
                               for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())], np.uint64)
            if len(hashes):
                at = (hashes[:, 0] if hashes.shape[1] == 1 else joint_hash(hashes)) % np.uint64(FILTER_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + 1)], names=["at"])

    at = frequent.select("lang", "phrase").mapInArrow(of, "at bigint")
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows:  # 4 KiB each, ``FILTER_BITS`` in all
        bits = np.frombuffer(row["bits"], np.uint8)
        out[(row["n"] - 1) * len(bits):row["n"] * len(bits)] = bits
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Leaf:
    """Counts by key in open addressing; 0 is no key."""

    def __init__(self):
        self.keys, self.counts, self.size = np.zeros(64, np.uint64), np.zeros(64, np.int64), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct ``keys``."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            old = self.items()
            room = len(self.keys)
            while 2 * (self.size + len(keys)) > room:
                room *= 2
            self.keys, self.counts, self.size = np.zeros(room, np.uint64), np.zeros(room, np.int64), 0
            self._put(*old)
        self._put(keys, counts)

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        last = len(self.keys) - 1
        at = ((keys * np.uint64(_ODD[0])) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            # Of several keys that find one place free, one gets it.
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.size += int(np.count_nonzero(mine & free))
            self.counts[at[mine]] += counts[mine]
            rest = ~mine
            keys, counts, at = keys[rest], counts[rest], (at[rest] + 1) & last

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        held = self.keys > 0
        return self.keys[held], self.counts[held]


class Trie:
    """Counts of paths, word numbers of ``bits`` bits packed into 64.

    Each leaf holds a range of paths, at first all of them; one that grows too large bursts at the word boundary nearest to its
    middle: between first words as long as it holds several, else between second words, and so on.
    """

    def __init__(self, bits: int, leaf_entries: int = LEAF_ENTRIES):
        self.bits, self.leaf_entries = bits, leaf_entries
        self.lows, self.leaves, self.size = [0], [Leaf()], 0

    def add(self, paths: np.ndarray) -> None:
        paths, counts = np.unique(paths, return_counts=True)
        cuts = [0, *np.searchsorted(paths, np.array(self.lows[1:], np.uint64)).tolist(), len(paths)]
        full = []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                leaf = self.leaves[i]
                self.size -= leaf.size
                leaf.add(paths[a:b], counts[a:b])
                self.size += leaf.size
                if leaf.size > self.leaf_entries:
                    full.append(i)
        for i in reversed(full):
            paths, counts = self.leaves[i].items()
            order = np.argsort(paths)
            parts = list(self._burst(self.lows[i], paths[order], counts[order]))
            self.lows[i:i + 1], self.leaves[i:i + 1] = [p[0] for p in parts], [p[1] for p in parts]

    def _burst(self, low: int, paths: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, Leaf]]:
        if len(paths) <= self.leaf_entries:
            leaf = Leaf()
            leaf.add(paths, counts)
            yield low, leaf
            return
        middle, first, last = int(paths[len(paths) // 2]), int(paths[0]), int(paths[-1])
        for shift in range(64 - self.bits, -1, -self.bits):
            cut = middle >> shift << shift
            if cut <= first:  # the middle's word begins the leaf: cut behind that word
                cut += 1 << shift
            if first < cut <= last:
                break
        at = int(np.searchsorted(paths, np.uint64(cut)))
        yield from self._burst(low, paths[:at], counts[:at])
        yield from self._burst(cut, paths[at:], counts[at:])

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Paths in order and their counts, of whole subtrees, the largest first, until at most ``keep`` entries are left."""
        gone = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for i in sorted(range(len(self.leaves)), key=lambda i: -self.leaves[i].size):
            if self.size <= keep:
                break
            gone.append(self.leaves[i].items())
            self.size -= self.leaves[i].size
            self.leaves[i] = Leaf()
        paths, counts = (np.concatenate(c) for c in zip(*gone))
        order = np.argsort(paths)
        return paths[order], counts[order]


class _Words(dict):
    """Numbers of words from 1 on; 0 for breaks and for words that cannot be frequent in their language."""

    def __init__(self, lang: str, passing: bytes):
        super().__init__({b"\n": 0})
        self.lang, self.passing, self.held, self.hashes = lang, passing, [b""], [0]

    def __missing__(self, word: bytes) -> int:
        hashed = word_hash(self.lang, word)
        at = hashed % FILTER_BITS
        number = 0
        if self.passing[at >> 3] >> (at & 7) & 1:
            number = len(self.held)
            self.held.append(word)
            self.hashes.append(hashed)
        self[word] = number
        return number

    def forget(self) -> None:
        """Only numbered words stay."""
        rare = [w for w, i in self.items() if not i and w != b"\n"]
        for w in rare:
            del self[w]


class _Pairs:
    """Paths of two words."""
    bits, size, prefix = 32, 2, 2

    def __init__(self, known: _Words):
        self.known, self.held = known, known.held

    def full(self, places: int) -> bool:
        return False

    def paths(self, numbers: np.ndarray, places: int) -> np.ndarray:
        x = np.append(numbers, 0).astype(np.uint64)
        first, second = x[:places], x[1:places + 1]
        return ((first << np.uint64(32)) | second)[(first > 0) & (second > 0)]


class _Longer:
    """Paths of three words, and of four where the last pair may be frequent; their words have numbers of their own."""
    bits, size, prefix = 16, 4, 3

    def __init__(self, known: _Words, frequent: np.ndarray):
        self.known, self.frequent, self.held, self.number = known, frequent, [b""], np.zeros(1, np.uint64)
        self.hashes = np.zeros(1, np.uint64)

    def full(self, places: int) -> bool:
        return len(self.held) + places + MAX_WORDS > MAX_WORD_IDS

    def paths(self, numbers: np.ndarray, places: int) -> np.ndarray:
        if len(self.hashes) < len(self.known.hashes):
            self.hashes = np.array(self.known.hashes, np.uint64)
            self.number = np.append(self.number, np.zeros(len(self.hashes) - len(self.number), np.uint64))
        x = np.concatenate((numbers, np.zeros(MAX_WORDS, np.int64)))
        hashes = self.hashes[x]
        pair = np.zeros(len(x), bool)
        both = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
        pair[both] = passes(self.frequent, joint_hash(np.stack((hashes[both], hashes[both + 1]), axis=-1)))
        at = np.flatnonzero(pair[:places] & pair[1:places + 1])
        words = np.stack([x[at], x[at + 1], x[at + 2], np.where(pair[at + 2], x[at + 3], 0)])
        new = np.unique(words)
        new = new[(new > 0) & (self.number[new] == 0)]
        self.number[new] = np.arange(len(self.held), len(self.held) + len(new), dtype=np.uint64)
        self.held += [self.known.held[i] for i in new.tolist()]
        out = np.zeros(len(at), np.uint64)
        for w in words:
            out = (out << np.uint64(16)) | self.number[w]
        return out


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers byte by byte, so that bytes of one rank lie together; the first one rises."""
    columns = [np.diff(columns[0], prepend=0), *columns[1:]]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns))


def _unpack(data: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    columns = np.ascontiguousarray(raw.reshape(size, 8, -1).transpose(0, 2, 1)).view("<u8")[..., 0].astype(np.int64)
    columns[0] = np.cumsum(columns[0])
    return columns


def _run(paths: np.ndarray, counts: np.ndarray, kind: _Pairs | _Longer, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """A sorted run cut by prefix partition: its number, the words that it uses, and its paths and counts."""
    shifts = [64 - kind.bits * (k + 1) for k in range(kind.size)]
    ids = np.stack([((paths >> np.uint64(s)) & np.uint64((1 << kind.bits) - 1)).astype(np.int64) for s in shifts])
    flag = np.zeros(len(kind.held), bool)
    flag[ids] = True
    hashes = np.zeros(len(kind.held), np.uint64)
    used = np.flatnonzero(flag)
    hashes[used] = np.fromiter((xxhash.xxh64_intdigest(kind.held[i]) for i in used.tolist()), np.uint64, len(used))
    part = ((joint_hash(hashes[ids[:kind.prefix].T]) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, ids, counts = part[order], ids[:, order], counts[order]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    local = np.zeros(len(kind.held), np.int64)
    for a, b in zip(first.tolist(), np.append(first[1:], len(part)).tolist()):
        rows = ids[:, a:b]
        flag[:] = False
        flag[rows] = True
        flag[0] = True
        own = np.flatnonzero(flag)
        local[own] = np.arange(len(own))
        held = b" ".join([kind.held[i] for i in own[1:].tolist()])
        yield int(part[a]), zstandard.ZstdCompressor(level=1).compress(held), _pack([*local[rows], counts[a:b]])


def runs(texts: DataFrame, passing, frequent, parts: int, leaf_entries: int = LEAF_ENTRIES, trie_entries: int = TRIE_ENTRIES) -> DataFrame:
    """``lang, part, words, paths``: sorted runs of all tasks; ``passing`` is the filter of words, as a broadcast.

    Paths are pairs or, with the filter ``frequent`` of pairs, those of three and four words.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, tuple[_Words, _Pairs | _Longer, Trie]] = {}
        bits = passing.value.tobytes()

        def fresh(lang: str) -> tuple[_Words, _Pairs | _Longer, Trie]:
            known = _Words(lang, bits)
            kind = _Pairs(known) if frequent is None else _Longer(known, frequent.value)
            return known, kind, Trie(kind.bits, leaf_entries)

        def out(lang: str, keep: int = 0) -> Iterator[pa.RecordBatch]:
            _, kind, trie = tries[lang]
            paths, counts = trie.spill(keep)
            if len(paths):
                rows = list(zip(*_run(paths, counts, kind, parts)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows[0]), pa.string()), pa.array(rows[0], pa.int32()),
                                                  pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())],
                                                 names=["lang", "part", "words", "paths"])

        for lang, data in _chunks(batches):
            for found, places in steps(data):
                if lang not in tries:
                    tries[lang] = fresh(lang)
                known, kind, trie = tries[lang]
                numbers = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
                at, ahead = 0, MAX_WORDS - 1
                while at < places:
                    some = min(places - at, STEP if kind.bits == 32 else 1 << 13)
                    if kind.full(some):  # numbers run out: begin anew
                        yield from out(lang)
                        kind, trie = _Longer(known, frequent.value), Trie(kind.bits, leaf_entries)
                        tries[lang] = known, kind, trie
                    trie.add(kind.paths(numbers[at:at + some + ahead], some))
                    at += some
                while sum(t.size for *_, t in tries.values()) > trie_entries:
                    largest = max(tries, key=lambda k: tries[k][2].size)
                    yield from out(largest, tries[largest][2].size // 2)
                if sum(len(k) for k, *_ in tries.values()) > KNOWN_WORDS:
                    for k, *_ in tries.values():
                        k.forget()
                    if sum(len(k) for k, *_ in tries.values()) > KNOWN_WORDS // 2:
                        for k in list(tries):
                            yield from out(k)
                        tries.clear()
        for lang in list(tries):
            yield from out(lang)

    return texts.mapInArrow(of, "lang string, part int, words binary, paths binary")


def _sums(key: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and sum of each run of equal keys."""
    changed = np.zeros(max(0, len(counts) - 1), bool)
    for k in key:
        changed |= k[1:] != k[:-1]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(counts)), bool), changed)))
    return first, np.add.reduceat(counts, first) if len(first) else counts


def _merge(table: pa.Table, size: int, min_count: int) -> tuple[list[str], list[int], list[int]]:
    """Phrases, sizes and counts, from ``min_count`` on, of the runs of a prefix partition."""
    numbers: dict[bytes, int] = {}
    ids, counts = [], []
    for held, data in zip(table.column("words"), table.column("paths")):
        own = [numbers.setdefault(w, len(numbers) + 1) for w in zstandard.ZstdDecompressor().decompress(held.as_py()).split(b" ")]
        columns = _unpack(data.as_py(), size + 1)
        ids.append(np.array([0, *own], np.int64)[columns[:-1]])
        counts.append(columns[-1])
    ids, counts = np.concatenate(ids, axis=1), np.concatenate(counts)
    # Two words in one key.
    key = [(ids[k] << 32) | ids[k + 1] for k in range(0, size, 2)]
    order = np.lexsort(key[::-1])
    key, counts = [k[order] for k in key], counts[order]
    first, f = _sums(key, counts)
    found = [([k[first][f >= min_count] for k in key], f[f >= min_count])]
    if size == MAX_WORDS:
        # Places of a third word, whether or not a fourth one follows.
        whole = found[0][0][1] & 0xFFFFFFFF > 0
        found = [([k[whole] for k in found[0][0]], found[0][1][whole])]
        key[1] = key[1] >> 32 << 32
        first, f = _sums(key, counts)
        found.append(([k[first][f >= min_count] for k in key], f[f >= min_count]))
    held = [b"", *numbers]
    phrases, sizes, times = [], [], []
    for keys, fs in found:
        for row, n in zip(zip(*(k.tolist() for k in keys)), fs.tolist()):
            parts = [held[i] for k in row for i in (k >> 32, k & 0xFFFFFFFF) if i]
            phrases.append(b" ".join(parts).decode("utf-8", "surrogatepass"))
            sizes.append(len(parts))
            times.append(n)
    return phrases, sizes, times


def _merged(cut: DataFrame, size: int, min_count: int) -> DataFrame:
    def merge(key, table):
        phrases, sizes, times = _merge(table, size, min_count)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.string()),
                         "size": pa.array(sizes, pa.int32()), "f": pa.array(times, pa.int64())})

    return cut.groupBy("lang", "part").applyInArrow(merge, "lang string, phrase string, size int, f bigint")


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, part_bytes: int = PART_BYTES,
                  leaf_entries: int = LEAF_ENTRIES, trie_entries: int = TRIE_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all phrases of 1 to 4 words with at least ``min_count`` occurrences, and ``lang, n`` of all words."""
    share = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("string").alias("t"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = -(-size // part_bytes) or 1
    single = stored(word_counts(texts))
    frequent = single.where(F.col("f") >= min_count).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")
    passing = share(_filter(frequent))
    pairs = stored(_merged(runs(texts, passing, None, parts, leaf_entries, trie_entries), 2, min_count))
    longer = _merged(runs(texts, passing, share(_filter(pairs)), parts, leaf_entries, trie_entries), MAX_WORDS, min_count)
    counts = stored(longer.unionByName(pairs).unionByName(frequent))
    return counts, single.groupBy("lang").agg(F.sum("f").alias("n"))


def _key(phrase: Column) -> Column:
    """A phrase of a language as one value: phrases hold no newline."""
    return F.concat(phrase, F.lit("\n"), F.col("lang"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, top: int = TOP,
                 covering: int = COVERING, **settings) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of 2 to 4 words of each language.

    Words lie between blanks and tabs, phrases between ``.,;:!?`` and line ends; A-Z are lower-cased. ``a`` is the count of the phrase, ``l``
    and ``r`` those of its parts at the cut where ``score``, two million times ``a / (l + r)`` as a whole number, is lowest (the first of
    equal ones); ``n`` counts all words. Phrases below ``min_count``, and those inside a longer one that has ``covering`` percent of their
    occurrences, are left out. Order: score, then ``a``, both descending, then the phrase's UTF-8 bytes.

    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they occur. An empty table gives no
    rows. Only the two columns are read. Counts are exact: hashes decide only where a path is merged and which words are left out early,
    never which paths are equal.
    """
    counts, totals = phrase_counts(docs, lang_col, text_col, min_count, **settings)
    size = size_in_bytes(counts)
    found = counts.where("size > 1").withColumn("w", F.split("phrase", " "))

    def at(rows: DataFrame, k: Column) -> DataFrame:
        return rows.withColumn("k", k).select(
            "lang", "phrase", F.col("f").alias("a"), "k", _key(F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).alias("left"),
            _key(F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ")).alias("right"))

    # Pairs, most of all, have one cut.
    cuts = at(found.where("size = 2"), F.lit(1)).unionByName(at(found.where("size > 2"), F.explode(F.sequence(F.lit(1), F.col("size") - 1))))
    parts = counts.select(_key(F.col("phrase")).alias("key"), "f")
    cuts = skew_join(cuts, parts.withColumnsRenamed({"key": "left", "f": "l"}), "left", small_bytes=size)
    cuts = skew_join(cuts, parts.withColumnsRenamed({"key": "right", "f": "r"}), "right", small_bytes=size)
    # Decimals hold products of more than 64 bits.
    score = F.expr("CAST(2000000 AS DECIMAL(38, 0)) * a div (l + r)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")) \
        .select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r", _key(F.col("phrase")).alias("key"))

    spans = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(n).alias("n")) for n in range(2, MAX_WORDS) for i in range(1, MAX_WORDS - n + 2)))
    inner = F.filter(spans, lambda s: (s["at"] + s["n"] - 1 <= F.col("size")) & (s["n"] < F.col("size")))
    inside = F.transform(inner, lambda s: F.array_join(F.slice("w", s["at"], s["n"]), " "))
    longest = found.where("size > 2").select("lang", "f", F.explode(inside).alias("part")).select(_key(F.col("part")).alias("key"), "f") \
        .groupBy("key").agg(F.max("f").alias("longer"))
    free = scored.join(longest, "key", "left").where(
        F.expr(f"longer IS NULL OR CAST(100 AS DECIMAL(38, 0)) * longer < CAST({int(covering)} AS DECIMAL(38, 0)) * a"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = free.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB, on tables small enough to list every phrase.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), places AS (
  SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM pieces WHERE len(w) > 0
), f AS MATERIALIZED (
  SELECT lang, list_slice(w, i, i + k - 1) AS p, count(*) AS f FROM places, (VALUES (1), (2), (3), (4)) AS s(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), found AS MATERIALIZED (SELECT * FROM f WHERE len(p) > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS k FROM found) AS c
  JOIN f AS x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f AS y ON y.lang = c.lang AND y.p = c.p[k + 1:]
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY score, k) = 1
), inside AS (
  SELECT lang, list_slice(p, i, i + n - 1) AS p, max(f) AS longer
  FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM found), (VALUES (2), (3)) AS s(n)
  WHERE n < len(p) AND i + n - 1 <= len(p) GROUP BY ALL
), free AS (
  SELECT cuts.*, array_to_string(p, ' ') AS phrase FROM cuts LEFT JOIN inside USING (lang, p)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free
) JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000"""
