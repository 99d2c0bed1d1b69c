"""The three detectors over numbered lines, and their union in one pass."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, functions as F

from keysweep.fixed_values import ENTROPY_TYPE, KEYWORD_TYPE
from keysweep.functions.entropy import high_entropy_tokens
from keysweep.functions.keywords import keyword_values
from keysweep.operators.guards import (
    keyword_guard, open_rules, passes_gates, rule_guard, signature_guard, token_guard,
)
from keysweep.operators.lines import RAW_LINE, number_lines, strip_cr
from keysweep.sources.rules import Rule

ALL = ("signature", "keyword", "entropy")
_HITS = "array<struct<type:string,match:string>>"


def _none() -> Column:
    return F.array().cast(_HITS)


def _typed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("match")))


def signature_hits(line: Column, rules: list[Rule]) -> Column:
    """One hit per matching rule; the match is the whole line."""
    names = F.array(*[F.when(rule_guard(line, r) & line.rlike(r.java), F.lit(r.name)) for r in rules])
    return F.transform(F.array_compact(names), lambda n: F.struct(n.alias("type"), line.alias("match")))


def keyword_hits(line: Column) -> Column:
    return _typed(KEYWORD_TYPE, keyword_values(line))


def entropy_hits(line: Column) -> Column:
    return _typed(ENTROPY_TYPE, high_entropy_tokens(line))


def hits_of(line: Column, rules: list[Rule], which=ALL) -> Column:
    """All hits of one line as an array of ``(type, match)``; a guard spares most of the work."""
    table = {
        "signature": (signature_guard(line, rules), signature_hits(line, rules)) if rules else None,
        "keyword": (keyword_guard(line), keyword_hits(line)),
        "entropy": (token_guard(line), entropy_hits(line)),
    }
    chosen = [table[name] for name in which if table[name] is not None]
    return F.concat(*[F.when(guard, hits.cast(_HITS)).otherwise(_none()) for guard, hits in chosen])


@lru_cache(maxsize=64)
def _expressions(app: str, rules: tuple[Rule, ...], which: tuple[str, ...]) -> tuple[Column, Column]:
    """Condition on a raw line, and hits of a line.

    They hold some hundred patterns and name no table, so one application builds them once.
    """
    unknown = open_rules(rules) if "signature" in which else []
    raw = F.col(RAW_LINE)
    keep = reduce(lambda a, b: a | b, [strip_cr(raw).rlike(r.loose) for r in unknown], passes_gates(raw, rules, which))
    return keep, hits_of(F.col("text"), rules, which)


def detect(files: DataFrame, rules: list[Rule], *keys: str, which=ALL, distinct: bool = False,
           partitions: int | None = None, limit: int | None = None, always: Column | None = None) -> DataFrame:
    """All findings ``(*keys, line, type, match)`` of a table with a ``content`` column.

    A bag, in which a token that occurs twice on a line is reported twice; with ``distinct``
    it is reported once. There is no shuffle and no Python worker, and only lines that pass
    a gate leave the stage that splits the contents. Lines of any length are scanned unless a ``limit`` is given.
    Null contents for which ``always`` holds, a condition on the keys, give a row without line, type and match.

    A table in a few large splits leaves all work to the tasks that read them: give the number of
    ``partitions`` to move its contents to first. A table in many splits needs none.
    """
    app = files.sparkSession.sparkContext.applicationId
    keep, hits = _expressions(app, tuple(rules), tuple(which))
    if partitions:
        files = files.repartition(partitions, keys[0])
    return (
        number_lines(files, *keys, keep=keep, limit=limit, always=always)
        .select(*keys, "line", (F.array_distinct(hits) if distinct else hits).alias("_hits"))
        .select(*keys, "line", F.inline_outer("_hits"))
        .where(F.col("type").isNotNull() if always is None else F.col("type").isNotNull() | (F.col("line").isNull() & always))
    )
