"""Packing of tokenised documents into sequences of several context sizes.

Documents are cut into whole windows of the longest size; what remains is routed to the shortest size that holds it.
Each remainder opens a window of its size, whose gap is filled with the remainders of shorter sizes that fit
best, and at last with a cut, so that windows end up exactly full. Finished sequences are dealt into step groups of even token counts.
"""

from __future__ import annotations

import heapq
import json
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

SIZES = (256, 512, 1024, 2048)
END_ID = 1
#: A task packs documents in groups of about so many tokens and carries what is unfinished to the next group.
GROUP_TOKENS = 1 << 20
#: Tokens of a step group.
STEP_TOKENS = 1 << 16

# Beyond these characters, libraries may differ in which ones they call letters; over long blanks, the faster one backtracks.
_FAR = re.compile("[^\x00-ɏ]|\\s{1000}")
#: Fixed value: the word pattern of the byte-level tokenizers, as documented with them.
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _fast(path: str):
    """The same vocabulary in a library that is three times as fast, and a pattern of the texts that it must not be given; None if the
    file does not allow it."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in (
        "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    if not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    # Visible stand-ins of bytes: printable ones stand for themselves, the others follow from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in spec.get("added_tokens", ())}
    try:
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    except KeyError:
        return None
    if made != sorted(made):  # ids must rise with the order of merges
        return None
    apart = re.compile("|".join([_FAR.pattern, *map(re.escape, sorted(special))]))
    return tiktoken.Encoding("bytes", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}), apart


def encode(text: str | None, path: str, end_id: int = END_ID) -> np.ndarray:
    """Token ids of a text, then ``end_id``; null counts as empty. Added tokens of the vocabulary count where the text spells them out."""
    text = text or ""
    fast = _fast(path)
    if fast is not None and not fast[1].search(text):
        ids = fast[0].encode_to_numpy(text, disallowed_special=())
    else:
        ids = _tokenizer(path).encode(text, add_special_tokens=False).ids
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1], out[-1] = ids, end_id
    return out


def fill(rests: list[tuple[int, int, int]], sizes: tuple[int, ...]) -> tuple[list, list]:
    """Windows of ``(document, start, length)`` pieces, all exactly full, and the pieces of one unfinished window.

    ``rests`` are ``(length, document, start)`` and go in descending order of length.
    """
    rests = sorted(rests)
    windows: list[list[tuple[int, int, int]]] = []
    while rests:
        length, doc, start = rests.pop()
        size = next(s for s in sizes if s >= length)
        window, gap = [(doc, start, length)], size - length
        while gap and rests:
            at = bisect_right(rests, (gap, float("inf"), 0))
            if at:
                length, doc, start = rests.pop(at - 1)
                window.append((doc, start, length))
                gap -= length
            else:
                length, doc, start = rests.pop(0)
                window.append((doc, start, gap))
                insort(rests, (length - gap, doc, start + gap))
                gap = 0
        if gap:
            return windows, window
        windows.append(window)
    return windows, []


def cut(pieces: list[tuple[int, int, int]], sizes: tuple[int, ...]) -> list[list[tuple[int, int, int]]]:
    """The last unfinished window in full windows of ever shorter sizes; the last one may stay short."""
    pieces, windows = pieces[::-1], []
    while pieces:
        total = sum(p[2] for p in pieces)
        room = max((s for s in sizes if s <= total), default=total)
        window = []
        while room:
            doc, start, length = pieces.pop()
            taken = min(length, room)
            window.append((doc, start, taken))
            room -= taken
            if taken < length:
                pieces.append((doc, start + taken, length - taken))
        windows.append(window)
    return windows


def steps(totals: list[int], step_tokens: int) -> list[int]:
    """A step group for each sequence, longest first to the lightest group."""
    heap = [(0, g) for g in range(max(1, round(sum(totals) / step_tokens)))]
    out = [0] * len(totals)
    for i in sorted(range(len(totals)), key=lambda i: -totals[i]):
        load, group = heap[0]
        out[i] = group
        heapq.heapreplace(heap, (load + totals[i], group))
    return out


def pack(docs: DataFrame, tokenizer_path: str, sizes: tuple[int, ...] = SIZES, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", group_tokens: int = GROUP_TOKENS,
         step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: ``id, start, length, ids, doc_tokens, sequence_id, offset, context, step_group``.

    ``ids`` are little-endian unsigned 32-bit token ids; ``start`` counts the ids of the document before the piece;
    ``offset`` those of the sequence. All sequences are exactly as long as one of ``sizes`` but the last one of a task,
    which is padded to the longest size. ``sequence_id`` is unique, not gapless: the task's number
    and a count. ``step_group`` numbers groups of about ``step_tokens`` tokens within a task.

    Null texts are empty documents, which consist of the end id; every row, repeated or with a null id, is a document of
    its own. An empty table gives no rows. Only the two named columns are read.

    There is no shuffle: each task tokenises and packs its own rows in one pass, holding one group, and a lost task is
    repeated with the same result.
    """
    sizes = tuple(sorted(sizes))
    longest = sizes[-1]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, "
              "context int, step_group bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        state = {"sequence": task << 33, "step": task << 33}
        names: list = []  # ids of the documents at hand
        tokens: list[np.ndarray] = []
        rests: list[tuple[int, int, int]] = []
        full: list[list[tuple[int, int, int]]] = []
        fields: dict = {}

        def out(windows: list) -> Iterator[pa.RecordBatch]:
            totals = [sum(p[2] for p in w) for w in windows]
            groups = steps(totals, step_tokens)
            columns: list[list] = [[] for _ in range(9)]
            for window, total, group in zip(windows, totals, groups):
                offset = 0
                for doc, start, length in window:
                    row = (names[doc], start, length, tokens[doc][start:start + length].tobytes(), len(tokens[doc]),
                           state["sequence"], offset, total if total in sizes else longest, state["step"] + group)
                    for column, value in zip(columns, row):
                        column.append(value)
                    offset += length
                state["sequence"] += 1
            state["step"] += max(groups, default=-1) + 1
            types = [fields["id"], pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            heads = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "context", "step_group"]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=heads)

        held = 0
        for batch in batches:
            fields["id"] = batch.schema.field("id").type
            for name, text in zip(batch.column("id"), batch.column("t")):
                ids = encode(text.as_py(), tokenizer_path, end_id)
                doc, whole = len(names), len(ids) // longest * longest
                names.append(name.as_py())
                tokens.append(ids)
                full += [[(doc, s, longest)] for s in range(0, whole, longest)]
                if whole < len(ids):
                    rests.append((len(ids) - whole, doc, whole))
                held += len(ids)
                if held >= group_tokens:
                    windows, open_window = fill(rests, sizes)
                    yield from out(full + windows)
                    # Only what the open window needs is kept.
                    kept = sorted({p[0] for p in open_window})
                    names[:], tokens[:] = [names[d] for d in kept], [tokens[d] for d in kept]
                    rests[:] = [(n, kept.index(d), s) for d, s, n in open_window]
                    full.clear()
                    held = 0
        if names:
            windows, open_window = fill(rests, sizes)
            yield from out(full + windows + cut(open_window, sizes))

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return texts.mapInArrow(run, schema)
