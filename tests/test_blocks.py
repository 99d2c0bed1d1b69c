"""Blocks of several lines against a walk over the markers of a file."""

import random
import re

import pytest

from keysweep.fixed_values import BLOCK_LABEL, BLOCK_TYPE
from keysweep.functions.redact import redact
from keysweep.operators import intervals
from keysweep.operators.blocks import multiline_secrets
from pyspark.sql import functions as F

RSA, ENC, PGP = "RSA PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK"
MARK = re.compile(rf"-----(BEGIN|END) ({BLOCK_LABEL})-----")


def walk(name, text):
    """Each begin marker whose next marker in the file is the end of its label."""
    lines = text.split("\n")
    flat = "\n".join(line.removesuffix("\r") for line in lines)
    marks, out = list(MARK.finditer(flat)), []
    for a, b in zip(marks, marks[1:]):
        if a[1] == "BEGIN" and b[1] == "END" and a[2] == b[2]:
            out.append((name, flat.count("\n", 0, a.start()) + 1, flat.count("\n", 0, b.start()) + 1, BLOCK_TYPE, flat[a.start():b.end()]))
    return out


def some(rng, n):
    bits = [f"-----{k} {label}-----" for k in ("BEGIN", "END") for label in (RSA, RSA, ENC, PGP, "PUBLIC KEY")] + ["abc", "-", "----", "Proc-Type: 4", "é", "\r"]
    return "".join(rng.choice(bits) + rng.choice(["\n", "\n", "\r\n", " ", ""]) for _ in range(n))


@pytest.mark.parametrize("seed,bucket", [(1, 4), (2, 1 << 16), (3, 4)])
def test_against_walk(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(intervals, "BUCKET", bucket)
    rng = random.Random(seed)
    texts = {f"f{i}": some(rng, rng.randrange(40)) for i in range(40)}
    texts["key"] = f"x\n k = \"-----BEGIN {RSA}-----\nAAAA\nBBBB\n-----END {RSA}-----\"\n"
    texts["nested"] = f"-----BEGIN {RSA}-----\n-----BEGIN {ENC}-----\na\n-----END {ENC}-----\n-----END {RSA}-----\n"
    texts["long"] = f"-----BEGIN {RSA}-----" + "A-" * 300_000 + f"-----END {RSA}-----"
    texts |= {"open": f"-----BEGIN {RSA}-----\na", "empty": "", "closed": f"-----END {RSA}-----\n"}
    want = sorted(r for name, text in texts.items() for r in walk(name, text))
    whole = spark.createDataFrame([(n, 1, t) for n, t in texts.items()] + [("null", 1, None)], "file string, first_line long, content string")
    assert sorted(map(tuple, multiline_secrets(whole).collect())) == want
    # The same from pieces that end at line ends.
    rows = []
    for name, text in texts.items():
        lines, at = text.splitlines(keepends=True) if "\r" not in text and "\x85" not in text else re.findall("[^\n]*\n|[^\n]+", text), 0
        while at < len(lines):
            n = rng.randint(1, 4)
            rows.append((name, at + 1, "".join(lines[at:at + n])))
            at += n
    pieces = spark.createDataFrame(rows + [("lost", None, texts["key"])], whole.schema)
    assert sorted(map(tuple, multiline_secrets(pieces).collect())) == want


def test_blocks_are_redacted(spark):
    key = f"-----BEGIN {RSA}-----\n" + "\n".join("A" * 64 for _ in range(5)) + f"\n-----END {RSA}-----"
    found = multiline_secrets(spark.createDataFrame([("a", 7, key)], "file string, first_line long, content string"))
    row = found.select("line", "last_line", redact(F.col("match")).alias("shown")).first()
    assert (row.line, row.last_line) == (7, 13) and "A" * 30 not in row.shown and row.shown.count("\n") == 6
    assert multiline_secrets(spark.createDataFrame([], "file string, first_line long, content string")).collect() == []
