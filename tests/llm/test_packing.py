import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keysweep.llm.packing import SIZES, _fast, cut, encode, fill, pack, steps

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_named_library(plain):
    rng = random.Random(2)
    assert _fast(PATH) is not None
    for limit in (0x80, 0x250, 0x3000, 0x11000):
        for _ in range(300):
            text = "".join(c if rng.random() < 0.5 else rng.choice(" \n\t'sdmtre019<|endoftext|>\x85\xa0")
                           for c in (chr(rng.randrange(limit)) for _ in range(rng.randrange(30))) if not "\ud800" <= c <= "\udfff")
            assert encode(text, PATH).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", " " * 2_000_000 + "x", "\n \t" * 300_000 + "x", "x" * 100_000):
        assert encode(text, PATH).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_fill_and_cut():
    rng = random.Random(4)
    for _ in range(50):
        rests = [(rng.randint(1, 2048), d, 5) for d in range(rng.randint(0, 60))]
        windows, rest = fill(rests, SIZES)
        assert all(sum(p[2] for p in w) in SIZES for w in windows)
        last = cut(rest, SIZES)
        assert sum(sum(p[2] for p in w) not in SIZES for w in last) <= 1
        at = defaultdict(list)
        for w in windows + last:
            for d, s, n in w:
                at[d].append((s, n))
        for n, d, s in rests:
            for start, length in sorted(at[d]):
                assert start == s and length > 0
                s += length
            assert s == n + 5


def test_step_groups_are_even():
    totals = [2048] * 40 + [256] * 100
    groups = steps(totals, 8192)
    loads = [sum(t for t, g in zip(totals, groups) if g == k) for k in set(groups)]
    assert max(loads) - min(loads) <= 2048


@pytest.mark.parametrize("group_tokens", [500, 1 << 20])
def test_pieces_make_up_documents_and_sequences(make_docs, plain, group_tokens):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["lorem", "ipsum", "çé", "42"]) for _ in range(rng.choice([0, 3, 90, 700, 1500])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "long word " * 30_000), (None, "x"), (7, "x"), (503, "中文 <|endoftext|>")]
    got = pack(make_docs(rows).coalesce(2), PATH, group_tokens=group_tokens).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], len(ids), r["context"]))
        docs[r["id"]].append((r["start"], ids, r["doc_tokens"]))
    short = 0
    for pieces in sequences.values():
        at = 0
        for offset, length, context in sorted(pieces):
            assert offset == at
            at += length
        assert at <= pieces[0][2] and pieces[0][2] in SIZES
        short += at != pieces[0][2]
    assert short <= 2  # one for each task
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*plain.encode(t or "", add_special_tokens=False).ids, 1])
    for i, texts in want.items():
        if len(texts) == 1:
            assert sum((ids for _, ids, _ in sorted(docs[i])), []) == texts[0]
            at = 0
            for start, ids, total in sorted(docs[i]):
                assert start == at and total == len(texts[0])
                at += len(ids)
        else:
            assert sum(len(p[1]) for p in docs[i]) == sum(map(len, texts))


def test_no_rows(make_docs):
    assert pack(make_docs([]), PATH).collect() == []
