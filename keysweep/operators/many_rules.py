"""Signature rules by the thousand: one pass over a line finds the literals of all rules, and only rules whose literal is there are tried.

With every rule in the plan, as for some dozens, the plan grows with the rules and no longer compiles. Here the literals are an automaton in the
tasks, so a line costs the same for ten rules or ten thousand; patterns are a column and run in the JVM on the few candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keysweep.operators.detect import detect
from keysweep.operators.lines import number_lines
from keysweep.sources.rules import Rule

#: Bytes of literals and patterns that a task holds at a time; more rules go in several passes.
BLOCK_BYTES = 16 << 20

# Long s and the Kelvin sign count as letters of other cases, as in patterns that ignore case.
_FOLD = {0x17F: "s", 0x212A: "k"}


def _folded(text: str) -> str:
    """Text in which a folded literal is found wherever a pattern without case would match it."""
    return text.translate(_FOLD).lower()


def _blocks(rules: list[Rule], block_bytes: int) -> Iterator[list[Rule]]:
    block, size = [], 0
    for rule in rules:
        own = len(rule.java) + sum(map(len, rule.stems))
        if block and size + own > block_bytes:
            yield block
            block, size = [], 0
        block.append(rule)
        size += own
    if block:
        yield block


def _automaton(stems: dict[str, list[int]]):
    made = ahocorasick.Automaton()
    for stem, which in stems.items():
        made.add_word(stem, which)
    made.make_automaton()
    return made


def candidates(lines: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """``(*keys, line, text, rules)``: lines that hold a literal of a rule, and the places in ``rules`` of those that they hold one of."""
    plain: dict[str, list[int]] = {}
    folding: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        for stem in rule.stems:
            (folding.setdefault(_folded(stem), []) if rule.folds_case else plain.setdefault(stem, [])).append(i)
    shared = lines.sparkSession.sparkContext.broadcast((plain, folding))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, folded = (_automaton(stems) if stems else None for stems in shared.value)
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column("text")):
                text = text.as_py()
                which = {i for _, held in exact.iter(text) for i in held} if exact else set()
                if folded:
                    which.update(i for _, held in folded.iter(_folded(text)) for i in held)
                if which:
                    rows.append(row)
                    found.append(sorted(which))
            if rows:
                part = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "rules"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.select(*keys, "line", "text").schema)
    return lines.select(*keys, "line", "text").mapInArrow(of, f"{kinds}, rules array<int>")


def detect_many(files: DataFrame, rules: list[Rule], *keys: str, distinct: bool = False, partitions: int | None = None,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Findings ``(*keys, line, type, match)`` of signature rules, as ``detect`` gives them, for any number of rules.

    ``distinct`` drops equal findings of one line, which rules of one name make. Rules need ``stems``: literals of which each match has one. Those without, hopefully few, are tried on every line by the plan of ``detect``. Null
    contents have no lines.
    """
    if partitions:
        files = files.repartition(partitions, keys[0])
    spark = files.sparkSession
    lines = number_lines(files, *keys)
    without = [r for r in rules if not r.stems]
    parts = [detect(files, without, *keys, which=("signature",), distinct=distinct)] if without else []
    for block in _blocks([r for r in rules if r.stems], block_bytes):
        table = spark.createDataFrame([(i, r.name, r.java) for i, r in enumerate(block)], "_rule int, type string, _java string")
        tried = candidates(lines, block, *keys).select(*keys, "line", "text", F.explode("rules").alias("_rule"))
        # At most a block; sorted by rule, each pattern would be compiled once, but candidates are few.
        found = tried.join(F.broadcast(table), "_rule").where(F.regexp_like("text", F.col("_java")))
        found = found.select(*keys, "line", "type", F.col("text").alias("match"))
        parts.append(found.dropDuplicates([*keys, "line", "type"]) if distinct else found)
    if not parts:
        return detect(files, [], *keys, which=("signature", "keyword")).where(F.lit(False))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
