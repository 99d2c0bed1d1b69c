"""Lifecycles against a plain fold over commits, and joins with very uneven keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keysweep.catalog import corpus
from keysweep.catalog.queries import QUERIES
from keysweep.operators import history
from keysweep.plans import skew
from keysweep.plans.scan import HistoryScan
from keysweep.sources.rules import load_rules

KEY = "token = \"ghp_{}\"\n"


def secret(n: int) -> str:
    return KEY.format(f"{n:036d}")


def fold(trees: list[set]) -> dict:
    """State of every secret after walking the commits that have findings, oldest first."""
    state: dict = {}
    for at, present in [(i, t) for i, t in enumerate(trees) if t]:
        for key, s in state.items():
            if s["active"] and key not in present:
                s.update(active=False, removed=at)
        for key in present:
            s = state.setdefault(key, {"introduced": at, "removed": None, "count": 0})
            s["active"] = True
            s["count"] += 1
    for s in state.values():
        s["removed"] = None if s["active"] else s["removed"]
    return state


def build(spark, trees: list[dict], contents: list[str], shuffle: random.Random | None = None):
    """Tables for a list of trees, oldest first; a tree maps paths to content numbers."""
    count = len(trees)
    commits = [(f"commit{i:04d}", f"message {i}", count - 1 - i) for i in range(count)]
    entries = [(f"commit{i:04d}", path, f"b{blob}") for i, tree in enumerate(trees) for path, blob in tree.items()]
    blobs = [(f"b{n}", len(text.encode()), text) for n, text in enumerate(contents)]
    if shuffle:
        for rows in (commits, entries, blobs):
            shuffle.shuffle(rows)
    return (
        spark.createDataFrame(blobs, "blob_id string, size long, content string"),
        spark.createDataFrame(entries or [("none", "none", "none")], "commit string, path string, blob_id string"),
        spark.createDataFrame(commits, "commit string, message string, log_pos long"),
    )


def lifecycle_of(scan) -> dict:
    rows = scan.lifecycle.where(F.col("type") == "GitHub Classic PAT").collect()
    index = {f"commit{i:04d}": i for i in range(10000)}
    return {r.match: {"introduced": index[r.introduced_commit], "removed": index.get(r.removed_commit),
                      "count": r.exposure_commits, "active": r.still_present_in_head} for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_lifecycle_equals_fold(spark, seed):
    rng = random.Random(seed)
    contents = [secret(n) for n in range(6)] + ["clean\n", secret(0) + secret(1), "x\n" + secret(2)]
    trees = []
    for _ in range(rng.randint(1, 14)):
        tree = {f"f{k}.py": rng.randrange(len(contents)) for k in range(4) if rng.random() < 0.4}
        trees.append(tree)
    present = [{line for blob in tree.values() for line in contents[blob].splitlines() if "ghp_" in line}
               for tree in trees]
    scan = HistoryScan(*build(spark, trees, contents, rng), load_rules(spark))
    assert lifecycle_of(scan) == fold(present)


def test_report_and_clean_commits(spark):
    contents = [secret(1), "clean\n", secret(2), "\n" + secret(1)]
    trees = [{"a.py": 0}, {"a.py": 1}, {"a.py": 2, "build/x.py": 0}, {"a.py": 0, "b.txt": 3}, {"a.py": 1, "c.md": 2}]
    blobs, entries, commits = build(spark, trees, contents)
    rules = load_rules(spark)
    scan = HistoryScan(blobs, entries, commits, rules, base="/r/")
    rows = {(r.file, r.line, r.match): r for r in scan.report().collect()}
    one, two = secret(1).strip(), secret(2).strip()
    values = {k: v for k, v in rows.items() if v.type == "GitHub Classic PAT"}
    assert set(values) == {("/r/a.py", 1, one), ("/r/a.py", 1, two), ("/r/b.txt", 2, one)}
    first = values["/r/a.py", 1, one]
    # Removed by the clean commit 1, which is not looked at, so only commit 2 counts; then introduced again.
    assert (first.commit, first.introduced_commit, first.removed_commit) == ("commit0000", "commit0000", None)
    assert (first.exposure_commits, first.still_present_in_head) == (2, True)
    assert first.exposure_window == "Exposed for 2 commits (still present in HEAD)"
    assert first.message == "message 0"
    assert values["/r/b.txt", 2, one].commit == "commit0003"
    second = values["/r/a.py", 1, two]
    assert (second.introduced_commit, second.removed_commit, second.exposure_commits) == ("commit0002", "commit0003", 1)
    everything = HistoryScan(blobs, entries, commits, rules, include_clean=True)
    life = lifecycle_of(everything)
    assert life[one] == {"introduced": 0, "removed": 4, "count": 2, "active": False}
    assert [r.commit for r in everything.sequence.orderBy("pos").collect()] == [f"commit{i:04d}" for i in range(5)]


def test_large_blobs_are_left_out_on_request(spark):
    pad = "x" * 99 + "\n"
    small, large = secret(1) + pad * 5119, secret(2) + pad * 5120
    contents = [small + "y" * (512000 - len(small)), large]
    tables, rules = build(spark, [{"a.py": 0, "b.py": 1}], contents), load_rules(spark)
    scan = HistoryScan(*tables, rules, max_blob_bytes=512000)
    assert {r.file for r in scan.report().collect()} == {"a.py"}
    assert {r.file for r in HistoryScan(*tables, rules).snapshot_findings().collect()} == {"a.py", "b.py"}
    assert [tuple(r) for r in history.snapshot_files(scan.entries, scan.blobs, max_blob_bytes=512000).collect()] == [
        ("commit0000", "a.py", "b0", 512000)]
    assert history.snapshot_files(scan.entries, scan.blobs).count() == 2


def test_commit_sequence_over_buckets(spark, monkeypatch):
    """Positions are right across buckets, with gaps, and with commits that the log lacks."""
    monkeypatch.setattr(history, "_BUCKET", 4)
    known = [(f"c{i}", f"m{i}", 40 - i) for i in range(41)]
    commits = spark.createDataFrame(known, "commit string, message string, log_pos long")
    seen = [f"c{i}" for i in range(41) if i % 7 in (0, 3, 4)] + ["lost1", "lost2", "lost3"]
    hits = spark.createDataFrame([(c,) for c in seen for _ in range(3)], "commit string")
    rows = history.commit_sequence(hits, commits).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(seen)))
    assert {r.commit for r in rows[:3]} == {"lost1", "lost2", "lost3"} and {r.order_index for r in rows[:3]} == {0}
    assert [r.commit for r in rows[3:]] == [c for c in seen if c.startswith("c")]
    assert [r.order_index for r in rows[3:]] == [int(c[1:]) for c in seen if c.startswith("c")]


def test_commit_order_and_lookup(spark):
    commits = spark.createDataFrame([("b", "second", 1), ("c", "third", 0), ("a", "first", 2)],
                                    "commit string, message string, log_pos long")
    order = {r.commit: r.order_index for r in history.commit_order(commits).collect()}
    assert order == {"a": 0, "b": 1, "c": 2}
    wanted = spark.createDataFrame([("c",), ("zz",), ("c",)], "commit string")
    assert [tuple(r) for r in history.commit_lookup(commits, wanted).collect()] == [("c", "third", 2)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_skew_join_keeps_every_row(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "HOT_SHARE", 16)
    rng = random.Random(3)
    big = [(0 if rng.random() < 0.4 else rng.randrange(1, 60), i, i % 3) for i in range(3000)]
    big += big[:50]
    small = [(k, f"s{k}-{j}") for k in range(0, 50) for j in range(1 + k % 2)]
    left = spark.createDataFrame(big, "k int, i int, x int")
    right = spark.createDataFrame(small, "k int, s string")
    got = skew.skew_join(left, right, "k", how=how)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, "k", how).select(got.columns).collect()))


def test_hot_key_is_dealt_out(spark, monkeypatch):
    """No partition of the join holds a hot key as a whole."""
    monkeypatch.setattr(skew, "HOT_SHARE", 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        big = spark.range(8000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
        small = spark.range(8000).select(F.col("id").alias("k"), F.lit("s").alias("s"))
        joined = skew.skew_join(big, small, "k")
        sizes = [r["count"] for r in joined.where("k = 7").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 2668 and len(sizes) == 8 and max(sizes) < 800


def test_no_broadcast_path_gives_the_same_history(spark, monkeypatch):
    contents = [secret(n) for n in range(4)]
    trees = [{"a.py": i % 4, "b.py": (i * i) % 4} for i in range(9)]
    tables = build(spark, trees, contents)
    plain = HistoryScan(*tables, load_rules(spark))
    expected = sorted(map(tuple, plain.report().collect()))
    monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)
    salted = HistoryScan(*tables, load_rules(spark))
    assert sorted(map(tuple, salted.report().collect())) == expected
    assert sorted(map(tuple, salted.secrets_per_commit().collect())) == sorted(map(tuple, plain.secrets_per_commit().collect()))
    assert sorted(map(tuple, salted.history_findings().collect())) == sorted(map(tuple, plain.history_findings().collect()))
    assert sorted(map(tuple, salted.findings_by_commit().collect())) == sorted(map(tuple, plain.findings_by_commit().collect()))


def test_registered_queries_scan_blobs_of_any_size(spark, sf_dir, monkeypatch):
    """A document over 512,000 bytes is in the trees, and its secret is found."""
    real = corpus.table

    def longer(session, folder, name):
        frame = real(session, folder, name)
        if name != "documents":
            return frame
        pad = F.when(F.col("doc_id") % 16 == 1, F.repeat(F.lit("word word\n"), F.lit(60_000))).otherwise("")
        return frame.withColumn("text", F.concat(pad, "text"))
    monkeypatch.setattr(corpus, "table", longer)
    assert QUERIES["snapshot_files"](spark, sf_dir).where("size > 512000").count() > 0
    assert QUERIES["scan_commit_snapshots"](spark, sf_dir).where("line > 60000").count() > 0


def test_keys_without_a_hot_one_are_not_counted_one_by_one(spark, monkeypatch):
    """Counting moves a row for each bucket of keys, and a join without hot keys is a plain one."""
    big = spark.range(4000).select((F.col("id") % 2000).alias("k"), "id")
    small = spark.range(2000).select(F.col("id").alias("k"), F.lit("s").alias("s"))
    joined = skew.skew_join(big, small, "k")
    assert "_salt" not in joined._jdf.queryExecution().toString() and joined.count() == 4000
    monkeypatch.setattr(skew, "COUNT_BUCKETS", 1)
    salted = skew.skew_join(big.unionByName(spark.range(90).select(F.lit(7).cast("long").alias("k"), "id")), small, "k")
    assert "_salt" in salted._jdf.queryExecution().toString() and salted.count() == 4090


def test_trees_are_joined_with_numbers_of_secrets(spark, monkeypatch):
    """Between trees and results no digest of 32 bytes moves; results have the digests."""
    contents = [secret(n) for n in range(3)] + [secret(0) + secret(1)]
    scan = HistoryScan(*build(spark, [{"a.py": i % 4, "b.py": (i + 1) % 4} for i in range(6)], contents), load_rules(spark))
    kinds, real = [], history.secret_positions
    monkeypatch.setattr(history, "secret_positions", lambda *given: kinds.append(dict((out := real(*given)).dtypes)) or out)
    digests = {(r.type, r.match): r.secret_id for r in scan.found.collect()}
    for life in (scan.lifecycle, scan.lifecycle_from_runs()):
        assert {(r.type, r.match): r.secret_id for r in life.collect()} == digests
    scan.exposure_intervals()
    assert [k["secret_id"] for k in kinds] == ["bigint", "bigint"]
