"""Edge cases of single operators."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keysweep.fixed_values import LINE_LIMIT_BYTES, MAX_BLOB_BYTES, VISIBLE_PREFIXES
from keysweep.functions import entropy, keywords, paths, redact
from keysweep.functions.exposure import exposure_window
from keysweep.operators.lines import is_truncated, number_lines


def column(spark, values, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in frame.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize("content,lines", [
    ("", []), ("\n", [""]), ("a\nb", ["a", "b"]), ("a\nb\n", ["a", "b"]), ("a\r\r\nb\r", ["a\r", "b"]),
    ("\n\na", ["", "", "a"]), ("a\n\n", ["a", ""]), ("\r\n", [""]), ("a\x0bb c", ["a\x0bb c"]),
])
def test_line_split(spark, content, lines):
    frame = spark.createDataFrame([(1, content)], "k int, content string")
    rows = number_lines(frame, "k").orderBy("line").collect()
    assert [(r.line, r.text) for r in rows] == list(enumerate(lines, 1))


def test_null_content_has_no_lines(spark):
    frame = spark.createDataFrame([(1, None)], "k int, content string")
    assert number_lines(frame, "k").count() == 0


@pytest.mark.parametrize("size,kept,cut", [
    (LINE_LIMIT_BYTES - 1, 5, False), (LINE_LIMIT_BYTES, 2, True), (LINE_LIMIT_BYTES + 9, 2, True),
])
@pytest.mark.parametrize("char,width", [("x", 1), ("é", 2)])
def test_line_limit(spark, size, kept, cut, char, width):
    long = char * (size // width) + "y" * (size % width)
    frame = spark.createDataFrame([(1, "a\n\n" + long + "\nb\nc\n")], "k int, content string")
    rows = number_lines(frame, "k", limit=LINE_LIMIT_BYTES).collect()
    assert sorted(r.line for r in rows) == list(range(1, kept + 1))
    assert number_lines(frame, "k").count() == 5
    assert frame.select(is_truncated(F.col("content"), LINE_LIMIT_BYTES)).first()[0] is cut


def test_paths(spark):
    values = [".env", "a/.env.local", "a/Makefile", "a/b.GO", "a.b/c", "x/y.tar.JSON", "a/b.", "build/x.go",
              "a/build.go", "src/vendor/a.py", "yarn.lock", "a/package-lock.json", "Dist/a.ts", "a/.git/b.c", "a/b.c"]
    assert column(spark, values, paths.extension) == [
        ".env", ".local", "", ".go", "", ".json", ".", ".go", ".go", ".py", ".lock", ".json", ".ts", ".c", ".c"]
    scanned = column(spark, values, paths.is_scanned)
    parts = column(spark, values, lambda p: paths.has_valid_extension(p) & ~paths.is_skipped_file(p)
                   & ~paths.in_skipped_dir(p))
    assert scanned == parts
    assert [v for v, s in zip(values, scanned) if s] == [
        ".env", "a/b.GO", "x/y.tar.JSON", "a/build.go", "Dist/a.ts", "a/b.c"]
    assert column(spark, ["/r/a/b", "/r", "/rx/a", "q"], lambda p: paths.relative_to(p, "/r/")) == [
        "a/b", ".", "/rx/a", "q"]
    assert column(spark, ["0123456789"], paths.short_commit) == ["01234567"]


def test_size_cap(spark):
    frame = spark.createDataFrame([(MAX_BLOB_BYTES,), (MAX_BLOB_BYTES + 1,)], "size long")
    assert [r[0] for r in frame.where(paths.within_size_cap(F.col("size"))).collect()] == [512000]


def test_secret_values(spark):
    values = {"abc1234": False, "abcd1234": True, "abcdefgh": False, "12345678": False, "mytest123": False,
              "your_abc1": False, "xXxX1234a": False, "teſt1234": False, "a1======": True, "exampl3s": True}
    assert column(spark, list(values), keywords.is_secret_value) == list(values.values())


@pytest.mark.parametrize("line,values", [
    ("auth: token:abcdefgh1", {"token:abcdefgh1", "abcdefgh1"}),
    ('"api_key": "abcd1234"', set()),
    ("GITHUB_TOKEN=abcd1234", set()),
    ('k := "abcd1234"', set()),
    ("key:=abc12345", {"=abc12345"}),
    ("secret=abcd1234 secret=abcd1234 secret='efgh5678'", {"abcd1234", "efgh5678"}),
    ("toKen=abcd1234", {"abcd1234"}),
    ("ésecret=abcd1234", {"abcd1234"}),
    ("9secret=abcd1234", set()),
])
def test_keyword_values(spark, line, values):
    (found,) = column(spark, [line], keywords.keyword_values)
    assert len(found) == len(set(found)) and set(found) == values


def test_noise(spark):
    pad = "Q" * 5
    values = {"a" * 6 + "b": False, "a" * 7: True, "eyJabc": True, "xMD5y": True, "SHA256" + pad: True,
              "-----BEGIN": True, "zeyj": False, "é" * 7: True}
    assert column(spark, list(values), entropy.is_noise) == list(values.values())


def python_entropy(text: str) -> float:
    size = len(text.encode())
    return -sum(n / size * math.log2(n / size) for n in Counter(text).values())


def test_entropy(spark):
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghij"
    values = ["", "aaaa", "ab", chars[:32], chars[:33], "日本語日本", "a.b.*[", chars * 40]
    got = column(spark, values, entropy.shannon_entropy)
    assert got == pytest.approx([python_entropy(v) for v in values], abs=1e-12)
    assert got[3] == 5.0
    tokens = [values[3], values[4], values[7]]
    assert column(spark, tokens, entropy.token_entropy) == pytest.approx([python_entropy(t) for t in tokens])
    found = column(spark, [f"x {t} y" for t in tokens], entropy.high_entropy_tokens)
    assert found == [[], [values[4]], [values[7]]]


def test_token_lengths(spark):
    assert column(spark, ["a" * 29 + " " + "b" * 30 + "." + "c" * 31], entropy.long_tokens) == [["b" * 30, "c" * 31]]


def python_redact(text: str) -> str:
    raw = text.encode()
    if len(raw) <= 8:
        return "*" * len(raw)
    if b"\n" in raw:
        parts = raw.split(b"\n")
        if len(parts) <= 2:
            return "*" * 20 + " (multiline)"
        first = parts[0][:20] + b"..." if len(parts[0]) > 20 else parts[0]
        last = b"..." + parts[-1][-20:] if len(parts[-1]) > 20 else parts[-1]
        return "\n".join([lossy(first)] + ["    *****"] * (len(parts) - 2) + [lossy(last)])
    keep = 2 if len(raw) == 9 else 4
    prefix = next((p for p in VISIBLE_PREFIXES if text.startswith(p)), "")
    if len(raw) - len(prefix) < 2 * keep + 3:
        return prefix + "****"
    return prefix + lossy(raw[len(prefix):len(prefix) + keep]) + "..." + lossy(raw[-keep:])


def lossy(raw: bytes) -> str:
    """One replacement character for every byte that belongs to no whole character."""
    out, at = [], 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + width].decode())
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def test_redaction(spark):
    bases = ["abcdefghijklmnopqrstuvwxyz", "aéb日c😀defghijk", "日本語テキストです", "x\ny\nz", "long first line of a key\n1\nand a long last line é",
             "é" * 15 + "\nm\n" + "日" * 12, "a\nbcdefghijkl"]
    values = [b[:n] for b in bases for n in range(len(b) + 1)]
    values += [p + "Z" * n for p in VISIBLE_PREFIXES for n in (0, 6, 9, 10, 11, 12, 40)] + ["path = /usr/local"]
    assert column(spark, values, redact.redact) == [python_redact(v) for v in values]
    assert column(spark, ["sk-proj-a", "sk-ant-api03-a", "sk-a", "xsk-", "github_pat_", "patch"], redact.secret_prefix) == [
        "sk-proj-", "sk-ant-api03-", "sk-", "", "github_pat_", "pat"]


def test_known_redactions(spark):
    values = ["12345678", "123456789", "1234567890", "12345678901", "sk-1234567890"]
    assert column(spark, values, redact.redact) == ["********", "12...89", "****", "1234...8901", "sk-****"]


def test_masked(spark):
    values = {"": True, "* .-": True, "a": False, "**\n": False, "****": True}
    assert column(spark, list(values), redact.is_fully_masked) == list(values.values())


def test_exposure_text(spark):
    rows = [(0, True, None), (1, True, None), (2, True, "x"), (1, False, "abcdefghijk"), (3, False, "abc"),
            (3, False, None), (2, False, "a\nb")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n long, s boolean, r string")
    got = frame.select("i", exposure_window(F.col("n"), F.col("s"), F.col("r")).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [
        "", "Exposed for 1 commit (still present in HEAD)", "Exposed for 2 commits (still present in HEAD)",
        "Exposed for 1 commit (removed in commit abcdefgh)", "Exposed for 3 commits (removed in commit abc)",
        "Exposed for 3 commits", "Exposed for 2 commits (removed in commit a b)"]
