"""Lifecycles from a stream against those of the whole history."""

import random

import numpy as np
import pytest

from keysweep import HistoryScan, load_rules
from keysweep.operators import history
from keysweep.streaming import lifecycle
from keysweep.streaming.lifecycle import LifecycleStream, merged
from tests.test_history import build, secret
from tests.test_intervals import runs_of


def test_merged_intervals():
    rng = random.Random(1)
    for _ in range(200):
        given = [(s := rng.randrange(30), s + rng.randrange(5)) for _ in range(rng.randrange(8))]
        first, last = merged(*(np.array([g[k] for g in given], np.int64) for k in (0, 1)))
        assert list(zip(first.tolist(), last.tolist())) == runs_of({n for a, b in given for n in range(a, b + 1)})


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_arrival_equals_the_whole_history(spark, tmp_path, seed):
    rng = random.Random(seed)
    contents = [secret(n) for n in range(5)] + ["clean\n", secret(0) + secret(1)]
    trees = [{f"f{k}.py": rng.randrange(len(contents)) for k in range(4) if rng.random() < 0.5} for _ in range(12)]
    blobs, entries, commits = build(spark, trees, contents, rng)
    scan = HistoryScan(blobs, entries, commits, load_rules(spark))
    want = sorted(map(tuple, scan.lifecycle.collect()))
    rows = entries.collect()
    rng.shuffle(rows)
    source, follow = str(tmp_path / "entries"), LifecycleStream(spark, str(tmp_path / "state"))
    entries.limit(0).write.parquet(source)
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", "1").parquet(source)
    for part in (rows[:9], rows[9:20], rows[20:] + rows[:3]):
        spark.createDataFrame(part, entries.schema).coalesce(1).write.mode("append").parquet(source)
        # Ended after each part and taken up again from its checkpoint.
        follow.start(history.sightings(stream, scan.found, commits)).awaitTermination()
    assert sorted(map(tuple, follow.lifecycle(scan.found, commits).collect())) == want
    seen = {(r.secret_id, i) for r in follow.intervals().collect() for i in range(r.first_index, r.last_index + 1)}
    assert seen == {tuple(r) for r in history.sightings(entries, scan.found, commits).collect()}


def test_many_batches_are_united(spark, tmp_path, monkeypatch):
    """Folders of united intervals stand for the batches before; a batch runs no Python for each secret."""
    monkeypatch.setattr(lifecycle, "UNITED_BATCHES", 2)
    monkeypatch.setattr(lifecycle, "BUCKET", 4)
    rng = random.Random(5)
    source, follow = str(tmp_path / "in"), LifecycleStream(spark, str(tmp_path / "state"))
    schema, seen = "secret_id binary, order_index long", set()
    for n in range(5):
        rows = [(bytes([rng.randrange(3)]), rng.randrange(12)) for _ in range(6)]
        spark.createDataFrame(rows + rows[:2] + [(None, 1), (b"x", None)], schema).coalesce(1).write.mode("append").parquet(source)
        follow.start(spark.readStream.schema(schema).parquet(source)).awaitTermination()
        seen |= set(rows)
    assert follow._done("until") == [1, 3] and follow._done("batch") == list(range(5))
    want = sorted((k, *run) for k in {k for k, _ in seen} for run in runs_of({n for key, n in seen if key == k}))
    got = follow.intervals().collect()
    assert sorted((bytes(r.secret_id), r.first_index, r.last_index) for r in got) == want
