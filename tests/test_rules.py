"""Rule patterns match the same lines in Spark as in an engine of their own dialect."""

import json
import logging
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from keysweep.catalog import oracle
from keysweep.functions.keywords import KEYWORDS, keyword_pattern
from keysweep.functions.regex import UnsupportedPattern, to_java
from keysweep.operators.detect import detect
from keysweep.operators.findings import count_by_rule
from keysweep.sources.rules import load_rules, rules_frame
from tests.sampling import samples


@pytest.fixture(scope="module")
def rules(spark):
    return load_rules(spark)


@pytest.fixture(scope="module")
def sampled(rules):
    lines = samples([r.pattern for r in rules] + [keyword_pattern(k) for k in KEYWORDS], 60, seed=7)
    assert len(lines) > 4000
    return lines


def test_all_rules_load(rules):
    assert [r.rule_id for r in rules] == list(range(1, 53))
    assert all(r.gate for r in rules)


def test_every_pattern_agrees(spark, rules, sampled):
    patterns = [r.pattern for r in rules] + [keyword_pattern(k) for k in KEYWORDS]
    frame = spark.createDataFrame(list(enumerate(sampled)), "i int, line string").repartition(8)
    hits = [F.when(F.col("line").rlike(to_java(p)), F.lit(n)) for n, p in enumerate(patterns)]
    got = {(r.i, r.n) for r in frame.select("i", F.explode(F.array_compact(F.array(*hits))).alias("n")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, line VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(sampled)))
    want = set()
    for n, p in enumerate(patterns):
        want |= {(i, n) for i, in con.execute("SELECT i FROM t WHERE regexp_matches(line, ?)", [p]).fetchall()}
    assert got == want
    assert {n for _, n in want} == set(range(len(patterns)))


@pytest.mark.parametrize("seed", [1, 2])
def test_detection_behind_guards_loses_nothing(spark, rules, sampled, seed):
    """Whole detection, with all its short cuts, against unguarded SQL."""
    rng = random.Random(seed)
    lines = list(sampled)
    rng.shuffle(lines)
    texts = []
    while lines:
        count = rng.randint(1, 6)
        texts.append("".join(line + rng.choice(["\n", "\r\n"]) for line in lines[:count]))
        lines = lines[count:]
    con = duckdb.connect()
    con.execute("CREATE TABLE files (doc_id INTEGER, content VARCHAR)")
    con.executemany("INSERT INTO files VALUES (?, ?)", list(enumerate(texts)))
    sql = f"WITH lines AS ({oracle._CTE['lines']}) SELECT doc_id, line, type, match FROM ({oracle._detect('lines', 'doc_id')})"
    want = Counter(con.execute(sql).fetchall())
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string").repartition(8)
    got = Counter(tuple(r) for r in detect(frame, rules, "doc_id").collect())
    assert got == want
    assert len({t for _, _, t, _ in want}) >= 53


def test_each_detector_alone(spark, rules, sampled):
    frame = spark.createDataFrame(list(enumerate(sampled)), "doc_id int, content string").repartition(8)
    whole = Counter(tuple(r) for r in detect(frame, rules, "doc_id").collect())
    parts = Counter()
    for name in ("signature", "keyword", "entropy"):
        parts += Counter(tuple(r) for r in detect(frame, rules, "doc_id", which=(name,)).collect())
    assert parts == whole


def test_user_rules(spark, tmp_path, caplog):
    """Own rules need no gate; ones that do not compile are skipped with a warning."""
    path = tmp_path / "own.json"
    path.write_text(json.dumps({"signatures": [
        {"name": "ticket", "pattern": r"^T-[0-9]{3}$"},
        {"name": "broken", "pattern": r"a(b"},
        {"name": "look", "pattern": r"(?=x)y"},
        {"name": "named", "pattern": r"(?P<id>id\.[[:digit:]]+)\b"},
        {"name": "ending", "pattern": r"acme_[0-9]{6}$"},
        {"name": "not posix", "pattern": r"[[:^alpha:]]"},
    ]}))
    with caplog.at_level(logging.WARNING):
        own = load_rules(spark, str(path))
    assert [(r.rule_id, r.name) for r in own] == [(1, "ticket"), (4, "named"), (5, "ending")]
    assert all(name in caplog.text for name in ("broken", "look", "not posix"))
    frame = spark.createDataFrame([(1, "x\nT-123\nT-1234\n\tid.77 here")], "doc_id int, content string")
    found = detect(frame, own, "doc_id", which=("signature",))
    assert {(r.line, r.type) for r in found.collect()} == {(2, "ticket"), (4, "named")}
    counts = {r.name: r.n_findings for r in count_by_rule(found, rules_frame(spark, own)).collect()}
    assert counts == {"ticket": 1, "named": 1, "ending": 0}
    lines = spark.createDataFrame([(1, "x acme_123456\r\nx acme_123456\nx acme_123456 \r\n")], "doc_id int, content string")
    assert {r.line for r in detect(lines, own, "doc_id", which=("signature",)).collect()} == {1, 2}


def test_gates_of_user_rules(spark, tmp_path):
    """Gates of one's own rules are used where they can hold, and left aside where they cannot."""
    path = tmp_path / "own.json"
    path.write_text(json.dumps({"signatures": [
        {"name": "folded", "pattern": r"(?i)\bacme-[0-9]+", "gate": "stem", "stems": ["acme-"]},
        {"name": "bare", "pattern": r"zz[0-9]", "gate": "stem"},
        {"name": "plain", "pattern": r"QQ-[0-9]", "gate": "stem", "stems": ["QQ-"]},
        {"name": "unheard", "pattern": r"x\.y", "gate": "moon", "stems": ["x"]},
        {"name": "short", "pattern": r"(?i)k[0-9]{3}://", "gate": "url", "stems": ["k"]},
    ]}))
    own = load_rules(spark, str(path))
    text = "AcMe-7\nzz1\nQQ-1\nqq-1\nx.y\nK123://\nk123://"
    found = detect(spark.createDataFrame([(1, text)], "doc_id int, content string"), own, "doc_id", which=("signature",))
    assert {(r.line, r.type) for r in found.collect()} == {
        (1, "folded"), (2, "bare"), (3, "plain"), (5, "unheard"), (6, "short"), (7, "short")}


@pytest.mark.parametrize("pattern", [r"a**", r"(?<=a)b", r"(?<!a)b", r"(a)\1", r"a{2000}", r"[a", r"a++", r"\pL", "a\\"])
def test_patterns_outside_the_dialect(pattern):
    with pytest.raises(UnsupportedPattern):
        to_java(pattern)


@pytest.mark.parametrize("pattern,line,hit", [
    (r"a.b", "a\rb", True), (r"a.b", "a b", True), (r"a.b", "a\nb", False), (r"(?s)a.b", "a\nb", True),
    (r"a\sb", "a\x0bb", False), (r"a\sb", "a\x0cb", True), (r"[[]x", "[x", True), (r"[&&a]b", "&b", True),
    (r"x{,2}", "x{,2}", True), (r"\bé", "aé", True), (r"a$", "a\r", False), (r"(?i)ſ", "S", True),
    (r"\x41\x{42}", "AB", True), (r"[^\s]", "\x0b", True), (r"a*?b", "aab", True), (r"[\]]", "]", True),
])
def test_dialect_details(spark, pattern, line, hit):
    row = spark.range(1).select(F.lit(line).rlike(to_java(pattern)).alias("hit")).first()
    assert row.hit is hit




def test_leading_word_is_looked_for_once(spark):
    """A megabyte of starts of a ``word.*rest`` pattern is one pass, not one per start."""
    rules = load_rules(spark)
    start = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9."
    lines = ["supabase " * 100_000 + start, "supabase " * 100_000 + f"x key = {start}a.b", f"a key={start}a.b supabase"]
    frame = spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, content string")
    found = detect(frame, rules, "doc_id", which=("signature",))
    assert {(r.line, r.type) for r in found.select("line", "type").collect() if r.type == "Supabase JWT Key"} == {
        (2, "Supabase JWT Key")}
