"""Orders from parents against a walk over the whole history."""

import random

import pytest

from keysweep.operators import topology
from keysweep.operators.topology import commit_topology

SCHEMA = "commit string, parents array<string>, time long"


def walk(rows):
    parents, time = {}, {}
    for c, p, t in rows:
        parents.setdefault(c, set()).update(p or ())
        time[c] = min((x for x in (time.get(c), t) if x is not None), default=None)
    known = {}

    def generation(c):
        stack = [c]
        while stack:
            at = stack[-1]
            own = [p for p in parents[at] if p in parents]
            todo = [p for p in own if p not in known]
            if todo:
                stack += todo
            else:
                known[stack.pop()] = 1 + max((known[p] for p in own), default=-1)
        return known[c]
    order = sorted(parents, key=lambda c: (generation(c), time[c] is not None, time[c] or 0, c))
    return sorted((c, known[c], i) for i, c in enumerate(order))


def history(rng, n):
    rows = []
    for i in range(n):
        if i == 0 or rng.random() < 0.03:
            parents = []
        elif rng.random() < 0.75:
            parents = [f"c{i - 1}"]
        else:
            parents = [f"c{rng.randrange(i)}" for _ in range(rng.randint(1, 3))]
        rows.append((f"c{i}", parents, rng.randrange(5)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,local", [(1, 10**6), (2, 10**6), (3, 0)])
def test_against_walk(spark, seed, local):
    rng = random.Random(seed)
    rows = history(rng, 120 if local else 25)
    rows += [rows[3], ("lost", ["nowhere"], None), ("c0", None, 9), ("twice", ["c1", "c1"], 1)]
    got = commit_topology(spark.createDataFrame(rows, SCHEMA), local).collect()
    assert sorted((r.commit, r.generation, r.order_index) for r in got) == walk(rows)


def test_long_lines_take_few_rounds(spark):
    rows = [(f"c{i:05d}", [f"c{i - 1:05d}"] if i else [], 0) for i in range(3000)] + [("m", ["c00010", "c02999"], 0)]
    got = {r.commit: (r.generation, r.order_index) for r in commit_topology(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{f"c{i:05d}": (i, i) for i in range(3000)}, "m": (3000, 3000)}


def test_empty_and_circular(spark):
    assert commit_topology(spark.createDataFrame([], SCHEMA)).collect() == []
    for rows in ([("a", ["b"], 0), ("b", ["a"], 0)], [("r", [], 0), ("a", ["r", "b"], 0), ("b", ["a", "r"], 0)]):
        with pytest.raises(ValueError, match="ancestors"):
            commit_topology(spark.createDataFrame(rows, SCHEMA)).collect()


def test_names_move_in_the_beginning_and_in_the_end_only(spark, monkeypatch):
    rows, tables, real = history(random.Random(4), 40), [], topology.stored
    monkeypatch.setattr(topology, "stored", lambda frame, *codec: tables.append(dict(frame.dtypes)) or real(frame, *codec))
    got = commit_topology(spark.createDataFrame(rows, SCHEMA), 0).collect()
    assert sorted((r.commit, r.generation, r.order_index) for r in got) == walk(rows)
    assert len(tables) > 4 and not any("string" in kinds.values() for kinds in tables[1:-1])


def test_circular_merges_level_by_level(spark):
    for rows in ([("a", ["b", "c"], 0), ("b", ["a", "c"], 0), ("c", ["a", "b"], 0)], [("r", [], 0), ("a", ["r", "b"], 0), ("b", ["a", "r"], 0)]):
        with pytest.raises(ValueError, match="ancestors"):
            commit_topology(spark.createDataFrame(rows, SCHEMA), 0).collect()
