"""Interval operators against sets of numbers, and lifecycles from runs against those from whole trees."""

import random

import pytest
from pyspark.sql import functions as F

from keysweep.operators import history, intervals
from keysweep.plans.scan import HistoryScan
from keysweep.plans.store import stored
from keysweep.sources.rules import load_rules
from tests.test_history import build, lifecycle_of, secret


def runs_of(numbers) -> list:
    out: list = []
    for n in sorted(numbers):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("bucket", [3, 1 << 16])
def test_union_against_sets(spark, monkeypatch, bucket):
    monkeypatch.setattr(intervals, "BUCKET", bucket)
    rng = random.Random(bucket)
    rows = [(rng.choice("abc"), s := rng.randrange(-20, 60), s + rng.randrange(-2, 9)) for _ in range(60)] + [("d", 0, 50), ("d", 10, 12), (None, 1, 2), ("e", None, 3), ("e", 4, None), ("f", 5, 4)]
    frame = spark.createDataFrame(rows, "k string, first_pos long, last_pos long")
    want = {k: runs_of({n for key, a, b in rows if key == k and a is not None and b is not None for n in range(a, b + 1)}) for k in "abcd"}
    got = intervals.union_intervals(frame, ["k"]).collect()
    assert sorted((r.k, r.first_pos, r.last_pos) for r in got) == sorted((k, *run) for k, found in want.items() for run in found)
    got = intervals.union_intervals(frame.where("k <> 'd' AND k <> 'e'"), []).collect()
    assert sorted(map(tuple, got)) == runs_of({n for k in "abc" for a, b in want[k] for n in range(a, b + 1)})
    assert intervals.union_intervals(frame.limit(0), ["k"]).collect() == []


@pytest.mark.parametrize("bucket", [2, 1 << 16])
def test_last_mark_before_a_point(spark, monkeypatch, bucket):
    monkeypatch.setattr(intervals, "BUCKET", bucket)
    marks = stored(spark.createDataFrame([(i, f"m{i}", -i) for i in (2, 3, 9, 21)], "at long, a string, b long"))
    points = spark.range(30).select(F.col("id").alias("at"))
    got = {r["at"]: (r.a, r.b) for r in intervals.at_or_before(points, marks, "at", ["a", "b"]).collect()}
    assert got == {i: next(((f"m{m}", -m) for m in (21, 9, 3, 2) if m <= i), (None, None)) for i in range(30)}


@pytest.mark.parametrize("seed,bucket", [(0, 2), (1, 3), (2, 1 << 16), (3, 2)])
def test_lifecycle_from_runs(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(intervals, "BUCKET", bucket)
    rng = random.Random(seed)
    contents = [secret(n) for n in range(6)] + ["clean\n", secret(0) + secret(1), "x\n" + secret(2)]
    trees = [{f"f{k}.py": rng.randrange(len(contents)) for k in range(5) if rng.random() < 0.5} if rng.random() < 0.8 else {} for _ in range(14)]
    blobs, entries, commits = build(spark, trees, contents, rng)
    scan = HistoryScan(blobs, entries, commits, load_rules(spark))
    want = sorted(map(tuple, scan.lifecycle.collect()))
    assert sorted(map(tuple, scan.lifecycle_from_runs().collect())) == want
    # The same from what each commit changed, repeated and needless changes included.
    changes = []
    for i, tree in enumerate(trees):
        before = trees[i - 1] if i else {}
        changes += [(i, p, f"b{b}") for p, b in tree.items() if before.get(p) != b or rng.random() < 0.2]
        changes += [(i, p, None) for p in before if p not in tree] + [(i, p, None) for p in tree if rng.random() < 0.1 and before.get(p) != tree[p]]
    changes = spark.createDataFrame(changes + [(0, "build/x.py", "b0")], "order_index long, path string, blob_id string")
    runs = history.runs_from_changes(changes, len(trees))
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, scan.runs.collect()))
    assert sorted(map(tuple, scan.lifecycle_from_runs(runs).collect())) == want

    found = scan.exposure_intervals().collect()
    life = lifecycle_of(scan)
    for match, state in life.items():
        own = sorted((r for r in found if r.match == match and r.type == "GitHub Classic PAT"), key=lambda r: r.introduced_commit)
        assert sum(r.exposure_commits for r in own) == state["count"]
        assert own[0].introduced_commit == f"commit{state['introduced']:04d}"
        assert (own[-1].removed_commit is None) == state["active"] and all(r.removed_commit for r in own[:-1])
        assert all(a.removed_commit <= b.introduced_commit for a, b in zip(own, own[1:]))


def test_no_findings_give_no_rows(spark):
    scan = HistoryScan(*build(spark, [{"a.py": 0}], ["clean\n"]), load_rules(spark))
    assert scan.lifecycle_from_runs().collect() == [] and scan.exposure_intervals().collect() == []
    assert [tuple(r) for r in scan.runs.collect()] == [("a.py", "b0", 0, 0)]


def test_intervals_move_once_each(spark, monkeypatch):
    """No row for each end of an interval; with few equal beginnings one shuffle before the runs are stored."""
    plans, real = [], intervals.stored
    monkeypatch.setattr(intervals, "stored", lambda frame, *codec: plans.append(frame._jdf.queryExecution().executedPlan().toString()) or real(frame, *codec))
    rows = [(k, n, n + k) for k in range(3) for n in range(0, 40, 2)]
    frame = spark.createDataFrame(rows, "k long, first_pos long, last_pos long")
    want = sorted((k, *run) for k in range(3) for run in runs_of({n for key, a, b in rows if key == k for n in range(a, b + 1)}))
    for few, moves in ((True, 1), (False, 2)):
        plans.clear()
        assert sorted(map(tuple, intervals.union_intervals(frame, ["k"], few=few).collect())) == want
        assert plans[0].count("Exchange") == moves and "Generate" not in plans[0]


def test_long_and_nested_intervals_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BUCKET", 3)
    for seed in range(6):
        rng = random.Random(seed)
        rows = [(rng.choice("ab"), s := rng.randrange(-30, 60), s + rng.choice([0, 0, 1, 3, 25])) for _ in range(rng.choice([6, 20]))]
        frame = spark.createDataFrame(rows, "k string, first_pos long, last_pos long")
        want = sorted((k, *run) for k in "ab" for run in runs_of({n for key, a, b in rows if key == k for n in range(a, b + 1)}))
        assert sorted(map(tuple, intervals.union_intervals(frame, ["k"], few=seed % 2 == 0).collect())) == want
