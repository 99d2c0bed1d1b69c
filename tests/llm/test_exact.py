import hashlib
import re

import pytest

from keysweep.llm.exact import exact_groups

ROWS = [(1, "a b"), (2, "a  b"), (3, "a\n\tb"), (3, "a b"), (4, " a b"), (5, None), (6, ""), (7, " "), (8, "\x0b"),
        (9, "a b"), (None, "a b"), (None, "z"), (10, "x" * 300_000), (11, "x" * 299_999 + "y"), (12, "x" * 300_000),
        (1, "a b"), (13, "A b")]


def brute(rows):
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest_all", [True, False])
def test_groups(make_docs, digest_all):
    got = exact_groups(make_docs(ROWS), digest_all=digest_all).collect()
    want = brute(ROWS)
    assert sorted(((r["id"], r["keep_id"], r["group_size"]) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    if digest_all:
        assert sorted(((r["id"], r["keep_id"], r["group_size"], r["digest"]) for r in got), key=str) == want
    # Exactly one row of each group stays, and it has the group's id.
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({w[3] for w in want})
    assert all(r["id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("digest_all", [True, False])
def test_empty_table(make_docs, digest_all):
    assert exact_groups(make_docs([]), digest_all=digest_all).collect() == []
