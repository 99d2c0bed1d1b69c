"""Language of a text by a bidirectional gated recurrent network over bytes.

The network reads windows of a text's UTF-8 bytes in both directions and gives every position a probability of each language; those of all
positions of a text are pooled. It is trained here, by backpropagation through time over a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from keysweep.plans.store import stored

#: Documents that are learned from, at most, of each language: those with the smallest hash of their id.
SAMPLE_PER_LANG = 600
#: Windows of a sampled document, at most, evenly spread over its text.
SAMPLE_WINDOWS = 4
#: Languages that are learned, at most: those of most documents.
MAX_LANGS = 200

WINDOW = 128
HIDDEN = 8
#: Windows that are read at a time, and bytes of text that are cut into windows at a time.
BATCH, CHUNK = 2048, 1 << 20

STEPS = 400
TRAIN_BATCH = 192
RATE = 0.02

NONE = "und"
_LETTER = regex.compile(r"\p{L}")


class Gates(NamedTuple):
    """One direction: what each byte adds to the three gates, what the state adds, and the offset of the candidate's state part."""
    byte: np.ndarray  # (3, 256, hidden): update, reset, candidate
    state: np.ndarray  # (3, hidden, hidden)
    offset: np.ndarray  # (hidden,)


class Network(NamedTuple):
    langs: list[str]
    ahead: Gates
    back: Gates
    out: np.ndarray  # (2, hidden, languages)
    bias: np.ndarray  # (languages,)

    def arrays(self) -> list[np.ndarray]:
        return [*self.ahead, *self.back, self.out, self.bias]

    @classmethod
    def of(cls, langs: list[str], arrays: list[np.ndarray]) -> "Network":
        return cls(langs, Gates(*arrays[:3]), Gates(*arrays[3:6]), arrays[6], arrays[7])


def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)

    def some(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    def gates() -> Gates:
        return Gates(some(3, 256, hidden, scale=0.5), some(3, hidden, hidden, scale=hidden ** -0.5), np.zeros(hidden, np.float32))

    return Network(langs, gates(), gates(), some(2, hidden, len(langs), scale=hidden ** -0.5), np.zeros(len(langs), np.float32))


def _sigmoid(x: np.ndarray) -> None:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5


def _read(gates: Gates, x: np.ndarray, inside: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """States ``(time, windows, hidden)`` over bytes ``x (time, windows)``; ``inside`` is 0 where a window has ended, 1 elsewhere.

    ``keep`` gets what the way back needs: gates, candidate and the candidate's state part, of each step.
    """
    steps, n = x.shape
    hidden = gates.offset.size
    kind = gates.offset.dtype
    out = np.empty((steps, n, hidden), kind)
    h = np.zeros((n, hidden), kind)
    add, part, offset = np.empty((3, n, hidden), kind), np.empty((3, n, hidden), kind), np.tile(gates.offset, (n, 1))
    ended = np.zeros(steps, bool) if inside is None else ~inside.all(axis=(1, 2))
    for t in range(steps):
        at = x[t].astype(np.intp)
        for gate in range(3):
            np.take(gates.byte[gate], at, axis=0, out=add[gate], mode="clip")
        np.matmul(h, gates.state, out=part)
        part[2] += offset
        both, new = add[:2], add[2]
        both += part[:2]
        _sigmoid(both)
        scaled = part[2] * both[1] if keep is not None else np.multiply(part[2], both[1], out=part[2])
        new += scaled
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((both.copy(), new.copy(), part[2].copy()))
        h -= new
        h *= both[0]
        h += new
        if ended[t]:
            h *= inside[t]
        out[t] = h
    return out


def _chances(net: Network, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Probabilities ``(languages, time, windows)`` of positions from the states of both directions."""
    hidden = ahead.shape[-1]
    x = net.out[0].T @ ahead.reshape(-1, hidden).T
    x += net.out[1].T @ back.reshape(-1, hidden).T
    x += net.bias[:, None]
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x.reshape(-1, *ahead.shape[:-1])


def label(net: Network, x: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """Probabilities ``(languages, time, windows)`` of every position of the windows ``x (time, windows)``."""
    ahead = _read(net.ahead, x, inside)
    back = _read(net.back, x[::-1], None if inside is None else inside[::-1])[::-1]
    return _chances(net, ahead, back)


def _unread(gates: Gates, x: np.ndarray, inside: np.ndarray | None, states: np.ndarray, kept: list, slope: np.ndarray) -> list[np.ndarray]:
    """Gradients of ``gates`` for the gradients ``slope`` of all states: backpropagation through time."""
    steps, n, hidden = states.shape
    by_sum = np.empty((3, steps, n, hidden), slope.dtype)
    by_state, by_offset = np.zeros_like(gates.state), np.zeros_like(gates.offset)
    down = np.zeros((n, hidden), slope.dtype)
    for t in reversed(range(steps)):
        (update, reset), new, part = kept[t]
        before = states[t - 1] if t else np.zeros((n, hidden), slope.dtype)
        down = down + slope[t]
        if inside is not None:
            down = down * inside[t]
        by_new = down * (1 - update) * (1 - new * new)
        by_update = down * (before - new) * update * (1 - update)
        by_reset = by_new * part * reset * (1 - reset)
        by_sum[0, t], by_sum[1, t], by_sum[2, t] = by_update, by_reset, by_new
        by_part = np.stack((by_update, by_reset, by_new * reset))
        by_offset += by_part[2].sum(axis=0)
        by_state += before.T @ by_part
        down = down * update + (by_part @ gates.state.transpose(0, 2, 1)).sum(axis=0)
    flat = x.ravel()
    order = np.argsort(flat, kind="stable")
    used, first = np.unique(flat[order], return_index=True)
    by_byte = np.zeros_like(gates.byte)
    by_byte[:, used] = np.add.reduceat(by_sum.reshape(3, -1, hidden)[:, order], first, axis=1)
    return [by_byte, by_state, by_offset]


def slopes(net: Network, x: np.ndarray, inside: np.ndarray | None, lang: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss of all positions, whose language is that of their window, and its gradients in the order of ``arrays``."""
    kept: tuple[list, list] = [], []
    mirrored = None if inside is None else inside[::-1]
    ahead = _read(net.ahead, x, inside, kept[0])
    back = _read(net.back, x[::-1], mirrored, kept[1])
    by_score = np.moveaxis(_chances(net, ahead, back[::-1]), 0, -1).copy()
    shown = np.ones((*x.shape, 1), by_score.dtype) if inside is None else inside
    total = shown.sum()
    right = by_score[:, np.arange(len(lang)), lang]
    loss = float(-(np.log(np.maximum(right, 1e-12)) * shown[..., 0]).sum() / total)
    by_score[:, np.arange(len(lang)), lang] -= 1
    by_score *= shown / total
    hidden, n_langs = net.out.shape[1:]
    flat = by_score.reshape(-1, n_langs)
    by_out = np.stack([s.reshape(-1, hidden).T @ flat for s in (ahead, back[::-1])])
    first = _unread(net.ahead, x, inside, ahead, kept[0], by_score @ net.out[0].T)
    second = _unread(net.back, x[::-1], mirrored, back, kept[1], (by_score @ net.out[1].T)[::-1])
    return loss, [*first, *second, by_out, flat.sum(axis=0)]


def train(langs: list[str], windows: list[bytes], lang: np.ndarray, steps: int = STEPS, seed: int = 1) -> Network:
    """Fit a network to windows of known languages (positions in ``langs``), each language equally often; the same for the same input."""
    net, rng = fresh(langs, seed=seed), np.random.default_rng(seed)
    of = [np.flatnonzero(lang == k) for k in range(len(langs))]
    x, inside = _columns(np.frombuffer(b"".join(windows), np.uint8), np.cumsum([0, *map(len, windows)]))
    mean = [np.zeros_like(a) for a in net.arrays()]
    square = [np.zeros_like(a) for a in net.arrays()]
    for step in range(1, steps + 1):
        chosen = np.array([rng.choice(of[k]) for k in rng.integers(0, len(langs), TRAIN_BATCH)])
        _, gradient = slopes(net, x[:, chosen], inside[:, chosen], lang[chosen])
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in gradient)))
        rate = RATE * (1 - (step - 1) / steps) * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
        for a, g, m, s in zip(net.arrays(), gradient, mean, square):
            g = g * min(1.0, 1 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            a -= (rate * m / (np.sqrt(s) + 1e-8)).astype(a.dtype)
    return net


def _cuts(n: int) -> np.ndarray:
    """Where windows of about equal length, at most ``WINDOW``, begin and end in ``n`` bytes."""
    k = -(-n // WINDOW)
    return np.arange(k + 1) * n // k if k else np.zeros(1, np.int64)


def _columns(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows between ``ends`` as columns, and 1 where they have a byte."""
    length = np.diff(ends)
    at = np.minimum(ends[:-1] + np.arange(WINDOW)[:, None], max(0, len(data) - 1))
    inside = np.arange(WINDOW)[:, None] < length
    x = data[at] if len(data) else np.zeros(at.shape, np.uint8)
    return x, inside[..., None].astype(np.float32)


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities ``(texts, languages)`` over all positions of each text; 0 for empty ones."""
    out = np.zeros((len(texts), len(net.langs)))
    owner = np.repeat(np.arange(len(texts)), [len(_cuts(len(t))) - 1 for t in texts])
    start = np.cumsum([0, *map(len, texts)])
    ends = np.concatenate([np.zeros(1, np.int64), *(s + _cuts(len(t))[1:] for s, t in zip(start.tolist(), texts))])
    data = np.frombuffer(b"".join(texts), np.uint8)
    for a in range(0, len(owner), BATCH):
        mine = ends[a:a + BATCH + 1]
        x, inside = _columns(data[mine[0]:mine[-1]], mine - mine[0])
        # Windows of one text are about equally long, so most batches end well before the last column.
        x, inside = x[:np.diff(mine).max()], inside[:np.diff(mine).max()]
        chances = label(net, x, inside)
        chances *= inside[..., 0]
        np.add.at(out, owner[a:a + BATCH], chances.sum(axis=1).T)
    return out / np.maximum(1, np.diff(start))[:, None]


def _pieces(data: bytes) -> Iterator[bytes]:
    for a in range(0, len(data), CHUNK):
        yield data[a:a + CHUNK]


def is_held_out(doc_id: Column) -> Column:
    """A third of the documents, by their id; null ids among them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG,
           langs: int = MAX_LANGS) -> DataFrame:
    """``lang, windows`` of at most ``per_lang`` documents of each of at most ``langs`` languages that are not held out.

    Chosen by a hash of the id, so the choice does not depend on partitions. Rows without id, language or text are left out.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang")) \
        .where(~is_held_out(F.col("id")) & F.col("lang").isNotNull() & F.coalesce(F.col("t"), F.lit("")).rlike(r"\p{L}"))
    most = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs).select("lang")
    order = Window.partitionBy("lang").orderBy("hash", "id")
    ids = own.select("id", "lang", F.xxhash64("id").alias("hash")).join(F.broadcast(most), "lang") \
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_lang).select("id", "lang")
    ids = stored(ids.distinct())  # at most ``langs * per_lang`` rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("t"):
                data = text.as_py().encode("utf-8", "surrogatepass")
                ends = _cuts(len(data))
                some = np.unique(np.linspace(0, len(ends) - 2, SAMPLE_WINDOWS).astype(int)).tolist()
                rows.append([data[ends[i]:ends[i + 1]] for i in some])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.list_(pa.binary()))], names=["lang", "windows"])

    return own.join(F.broadcast(ids), ["id", "lang"]).select("lang", "t").mapInArrow(cut, "lang string, windows array<binary>")


def fit(sampled: DataFrame, steps: int = STEPS) -> Network:
    """A network trained on the driver with the bounded table ``sampled``."""
    # Sorted, so that the result does not hang on the order in which tasks end.
    rows = sorted((r["lang"], bytes(w)) for r in sampled.collect() for w in r["windows"])
    langs = sorted({r[0] for r in rows})
    place = {k: i for i, k in enumerate(langs)}
    if not langs:
        return fresh([])
    return train(langs, [r[1] for r in rows], np.array([place[r[0]] for r in rows]), steps)


def languages(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, lang_pred, score``: one row per row of ``docs``, whole texts, no shuffle.

    ``score`` is the pooled probability of ``lang_pred``. Null texts and texts without a letter are ``und`` with score 0, as is everything
    if no language was learned. Of equal probabilities the first language by name counts. Repeated rows and null ids are kept as they are. An
    empty table gives no rows. Only the two columns are read.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, len(net.langs)))
            total = np.zeros(batch.num_rows)
            held, size = [], 0  # (row, bytes)

            def read() -> None:
                for (row, part), chances in zip(held, pooled(net, [p for _, p in held])):
                    found[row] += chances * len(part)
                    total[row] += len(part)

            for row, text in enumerate(batch.column("t")):
                text = text.as_py()
                if text is None or not net.langs or not _LETTER.search(text):
                    continue
                for part in _pieces(text.encode("utf-8", "surrogatepass")):
                    held.append((row, part))
                    size += len(part)
                    if size >= CHUNK:
                        read()
                        held, size = [], 0
            read()
            known = total > 0
            best = found.argmax(axis=1) if net.langs else np.zeros(batch.num_rows, int)
            score = np.where(known, found[np.arange(len(best)), best] / np.maximum(total, 1), 0.0) if net.langs else total
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([net.langs[k] if ok else NONE for k, ok in zip(best.tolist(), known.tolist())], pa.string()),
                 pa.array(np.clip(score, 0.0, 1.0))], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return texts.mapInArrow(of, f"id {kind}, lang_pred string, score double") \
        .select("id", is_held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
