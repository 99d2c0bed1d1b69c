"""Thousands of rules against the plan with every rule in it, and against plain search."""

import random
import re
from collections import Counter

from keysweep import load_rules
from keysweep.catalog import corpus
from keysweep.operators.detect import detect
from keysweep.operators.many_rules import detect_many
from keysweep.sources.rules import Rule


def test_the_given_rules_find_the_same(spark, sf_dir):
    rules = load_rules(spark)
    files = corpus.files(spark, sf_dir)
    want = Counter(map(tuple, detect(files, rules, "doc_id", which=("signature",)).collect()))
    assert Counter(map(tuple, detect_many(files, rules, "doc_id").collect())) == want and want
    assert Counter(map(tuple, detect_many(files, rules, "doc_id", block_bytes=500).collect())) == want


def test_five_thousand_rules(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = sorted({"".join(rng.choice(letters) for _ in range(5)) + "_" for _ in range(5000)})
    rules = [Rule(i, f"rule {i}", f"{s}[0-9]{{4}}", f"{'(?iu)' if i % 7 == 0 else ''}{s}[0-9]{{4}}", "stem", (s,)) for i, s in enumerate(stems)]
    lines = []
    for _ in range(600):
        parts = [rng.choice(stems) + rng.choice(["1234", "12", "x"]) if rng.random() < 0.4 else rng.choice(["plain", "KK", "ſ"]) for _ in range(rng.randrange(6))]
        line = rng.choice([" ", ""]).join(parts)
        lines.append(line.upper() if rng.random() < 0.2 else line)
    lines += [stems[0].replace("s", "ſ") + "1234" for _ in range(2)]
    files = spark.createDataFrame([(1, "\n".join(lines[:300])), (2, "\n".join(lines[300:])), (3, None), (4, "")], "k int, content string")
    want = Counter()
    for at, line in enumerate(lines):
        key, number = (1, at + 1) if at < 300 else (2, at - 299)
        for rule in rules:
            pattern = rule.pattern
            if rule.folds_case:
                hit = re.search(pattern, line.replace("ſ", "s").replace("K", "k"), re.IGNORECASE)
            else:
                hit = rule.stems[0] in line and re.search(pattern, line)
            if hit:
                want[key, number, rule.name, line] += 1
    got = Counter(map(tuple, detect_many(files, rules, "k").collect()))
    assert got == want and len(want) > 100


def test_rules_of_one_name_and_none(spark):
    rules = [Rule(1, "n", "ab", "ab", "stem", ("ab",)), Rule(2, "n", "abc", "abc", "stem", ("ab",)), Rule(3, "open", "[x]y", "[x]y")]
    files = spark.createDataFrame([(1, "abc\nxy")], "k int, content string")
    assert Counter(map(tuple, detect_many(files, rules, "k").collect())) == Counter({(1, 1, "n", "abc"): 2, (1, 2, "open", "xy"): 1})
    assert Counter(map(tuple, detect_many(files, rules, "k", distinct=True).collect())) == Counter({(1, 1, "n", "abc"): 1, (1, 2, "open", "xy"): 1})
    assert detect_many(files, [], "k").collect() == []
