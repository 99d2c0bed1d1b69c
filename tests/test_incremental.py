"""Batches and changes of rules against one scan of everything."""

import random

import pytest

from keysweep import load_rules, scan_files
from keysweep.plans import incremental
from keysweep.plans.incremental import IncrementalScan
from tests.test_history import secret


def rows_of(frame):
    return sorted(map(tuple, frame.select("file", "line", "type", "match").collect()))


def texts(rng, n):
    lines = [secret(1), secret(2), "AWS_ACCESS_KEY_ID=AKIA" + "A1B2" * 4 + "\n", "api_key = abcd1234efgh\n", "plain\n",
             "blob aB1+cD2/eF3gH4iJ5kL6mN7oP8qR9sT0uVwXyZAbCdEfGhIj\n"]
    return [(f"{rng.choice('abcd')}/{i}.{rng.choice(['py', 'py', 'md'])}", "".join(rng.choice(lines) for _ in range(rng.randrange(4)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_batches_and_rule_changes_equal_one_scan(spark, tmp_path, seed):
    rng = random.Random(seed)
    rules = load_rules(spark)
    scan = IncrementalScan(spark, str(tmp_path / "state"))
    files = texts(rng, 40) + [("x/null.py", None), (None, secret(1)), ("a/same.py", secret(1)), ("a/same.py", secret(1)), ("a/same.py", secret(2))]
    for step in range(5):
        chosen = [r for r in rules if rng.random() < (0.5 if step < 4 else 2)]
        batch = rng.sample(files, 25) if step < 4 else files
        frame = spark.createDataFrame(batch, "path string, content string")
        assert rows_of(scan.scan(frame, chosen)) == rows_of(scan_files(frame, chosen))


def test_known_contents_are_not_read_again(spark, tmp_path, monkeypatch):
    rules = load_rules(spark)
    frame = spark.createDataFrame(texts(random.Random(9), 30), "path string, content string")
    scan = IncrementalScan(spark, str(tmp_path / "state"))
    seen = []
    real = incremental.detect

    def counting(files, some, *keys, **settings):
        seen.append((files.count(), sorted(r.name for r in some), settings["which"]))
        return real(files, some, *keys, **settings)
    monkeypatch.setattr(incremental, "detect", counting)
    first = rows_of(scan.scan(frame, rules[:20]))
    assert len(seen) == 1 and seen[0][2] == ("keyword", "entropy", "signature")
    assert rows_of(scan.scan(frame, rules[:20])) == first and len(seen) == 1
    # Another place of a known content costs nothing; a new rule meets all contents alone; fewer rules need no reading.
    moved = frame.selectExpr("concat('moved/', path) AS path", "content")
    assert len(rows_of(scan.scan(moved, rules[:20]))) == len(first) and len(seen) == 1
    scan.scan(frame, rules[:21])
    assert seen[1:] == [(seen[0][0], [rules[20].name], ("signature",))]
    assert rows_of(scan.scan(frame, rules[5:9])) == rows_of(scan_files(frame, rules[5:9])) and len(seen) == 2
    scan.scan(frame.unionAll(spark.createDataFrame([("n.py", secret(77))], frame.schema)), rules[:21])
    assert [s[0] for s in seen[2:]] == [1]


def test_a_scan_that_broke_off_is_repeated(spark, tmp_path, monkeypatch):
    rules = load_rules(spark)
    frame = spark.createDataFrame(texts(random.Random(4), 20), "path string, content string")
    scan = IncrementalScan(spark, str(tmp_path / "state"))
    real = scan._append

    def broken(name, rows):
        if name == "scanned":
            raise RuntimeError("stopped")
        real(name, rows)
    monkeypatch.setattr(scan, "_append", broken)
    with pytest.raises(RuntimeError):
        scan.scan(frame, rules)
    monkeypatch.setattr(scan, "_append", real)
    assert rows_of(scan.scan(frame, rules)) == rows_of(scan_files(frame, rules))


def test_empty_batch(spark, tmp_path):
    scan = IncrementalScan(spark, str(tmp_path / "state"))
    assert scan.scan(spark.createDataFrame([], "path string, content string"), load_rules(spark)).collect() == []
