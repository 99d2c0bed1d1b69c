"""Signature rules: load, rewrite for Spark's regex engine, drop the ones that do not compile."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass
from importlib import resources

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from keysweep.functions.regex import UnsupportedPattern, to_java
from keysweep.schemas import RULES

log = logging.getLogger(__name__)

_FILE = T.StructType([T.StructField("signatures", T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("gate", T.StringType()),
    T.StructField("stems", T.ArrayType(T.StringType())),
])))])


@dataclass(frozen=True)
class Rule:
    rule_id: int
    name: str
    pattern: str
    java: str
    gate: str | None = None
    stems: tuple[str, ...] = ()

    @property
    def loose(self) -> str:
        """The pattern without its word boundaries: matches at least the same lines, much faster."""
        return to_java(self.pattern, boundaries=False)

    @property
    def folds_case(self) -> bool:
        return self.java.startswith("(?iu)")


def load_rules(spark: SparkSession, path: str | None = None) -> list[Rule]:
    """Rules of the package, or of a JSON file of the same shape; ids are 1-based file positions.

    A rule table has tens of rows and ends up inside the query as literals, so it
    is held on the driver.
    """
    if path is None:
        raw = json.loads(resources.files("keysweep").joinpath("data/rules.json").read_text())["signatures"]
    else:
        frame = spark.read.schema(_FILE).json(path, multiLine=True)
        raw = [r.asDict() for r in frame.select(F.explode("signatures").alias("r")).select("r.*").collect()]
    rules = []
    for number, row in enumerate(raw, 1):
        try:
            rules.append(Rule(number, row["name"], row["pattern"], to_java(row["pattern"]),
                              row.get("gate"), tuple(row.get("stems") or ())))
        except UnsupportedPattern as problem:
            log.warning("rule %r skipped: %s", row["name"], problem)
    return _compiling(spark, rules)


_known: dict[tuple[str, ...], bool] = {}


def _compile(spark: SparkSession, patterns: tuple[str, ...]) -> bool:
    if patterns not in _known:
        # Literals over one literal row: the optimizer evaluates this without starting a job.
        checks = [F.lit("").rlike(pattern).alias(f"p{i}") for i, pattern in enumerate(patterns)]
        try:
            spark.sql("SELECT 1").select(*checks).collect()
            _known[patterns] = True
        except PySparkException:
            _known[patterns] = False
    return _known[patterns]


def _compiling(spark: SparkSession, rules: list[Rule]) -> list[Rule]:
    if not rules or _compile(spark, tuple(r.java for r in rules)):
        return rules
    good = []
    for rule in rules:
        if _compile(spark, (rule.java,)):
            good.append(rule)
        else:
            log.warning("rule %r skipped: its pattern does not compile", rule.name)
    return good


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, r.name, r.pattern) for r in rules], RULES)
