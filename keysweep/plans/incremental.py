"""Scans that read again only what they have to: contents that are new, and rules that are new to contents seen before."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from keysweep import fixed_values as fixed
from keysweep.functions.paths import is_scanned
from keysweep.operators.detect import detect
from keysweep.plans.skew import BROADCAST_BYTES, skew_join
from keysweep.plans.store import size_in_bytes, stored
from keysweep.sources.rules import Rule

_SCANNED = "digest string, version string, n_units int"
_VERSIONS = "version string, unit string"
_FINDINGS = "digest string, unit string, line long, type string, match string"


def _digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def units(rules: list[Rule]) -> dict[str, str]:
    """The detector's units by the type of their findings, each as a digest of all that decides what it finds.

    Rules of one name are one unit; keywords and entropy are a unit each.
    """
    patterns: dict[str, list[str]] = {}
    for rule in rules:
        patterns.setdefault(rule.name, []).append(rule.pattern)
    out = {name: _digest("rule", name, sorted(p)) for name, p in patterns.items()}
    out[fixed.KEYWORD_TYPE] = _digest("keyword", fixed.COMPOUND_KEYWORDS, fixed.GENERIC_KEYWORDS, fixed.KEYWORD_TAIL, fixed.PLACEHOLDERS, fixed.MIN_VALUE_BYTES)
    out[fixed.ENTROPY_TYPE] = _digest("entropy", fixed.TOKEN_ALPHABET, fixed.MIN_TOKEN_LENGTH, fixed.ENTROPY_BOUND, fixed.MAX_REPEAT_RUN, fixed.NOISE_WORDS, fixed.NOISE_PREFIX)
    return out


class IncrementalScan:
    """Scans of a growing or changing collection, with a memory in the folder ``state``.

    The memory holds the digests of contents that were scanned, the units (rules, keywords, entropy) that each was scanned with,
    and what was found. It is appended to: findings first, then the digests, so a scan that breaks off is only repeated, never trusted
    half. One scan at a time may use a folder. Contents are told apart by SHA-256. Findings hold the secrets themselves: keep the folder as you would them.
    """

    def __init__(self, spark: SparkSession, state: str):
        self.spark, self.state = spark, state.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.state}/{name}"
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.state}/{name}")

    def _versions(self) -> dict[str, set[str]]:
        """Units of each version. There is one for every change of the rules, so they are few."""
        out: dict[str, set[str]] = {}
        for row in self._table("versions", _VERSIONS).distinct().collect():
            out.setdefault(row["version"], set()).add(row["unit"])
        return out

    def scan(self, files: DataFrame, rules: list[Rule], partitions: int | None = None) -> DataFrame:
        """Deduplicated findings ``(file, line, type, match)`` of ``files (path, content)`` under ``rules``, as ``scan_files`` gives them.

        New contents meet all units, contents seen before only units that they have not met; what is known comes from the memory. Null
        contents have no findings; a row without a path is not scanned.
        """
        wanted = files.where(is_scanned(F.col("path")) & F.col("content").isNotNull()) \
            .select(F.col("path").alias("file"), "content", F.sha2("content", 256).alias("digest"))
        places = stored(wanted.select("file", "digest").distinct())
        known = self._table("scanned", _SCANNED).groupBy("digest").agg(F.max_by("version", "n_units").alias("version"))
        # A content is read at one of the places that hold it.
        todo = stored(places.groupBy("digest").agg(F.min("file").alias("file")).join(known, "digest", "left"))
        by_type = units(rules)
        now = set(by_type.values())
        versions: dict[str | None, set[str]] = {None: set(), **self._versions()}
        for row in todo.select("version").distinct().collect():
            met = versions[row["version"]]
            if now - met:
                self._add(wanted, todo.where(F.col("version").eqNullSafe(row["version"])), rules, by_type, met, partitions)
        unit_of = self.spark.createDataFrame([(u,) for u in sorted(now)], "unit string")
        found = self._table("findings", _FINDINGS).join(F.broadcast(unit_of), "unit", "left_semi") \
            .select("digest", "line", "type", "match")
        # One content may be in a third of all places.
        held = stored(found.join(places.select("digest").distinct(), "digest", "left_semi").distinct())
        return skew_join(places, held, "digest", small_bytes=size_in_bytes(held)).select("file", "line", "type", "match").distinct()

    def _add(self, wanted: DataFrame, todo: DataFrame, rules: list[Rule], by_type: dict[str, str], met: set[str], partitions: int | None) -> None:
        missing = {kind: unit for kind, unit in by_type.items() if unit not in met}
        which = [name for name, kind in (("keyword", fixed.KEYWORD_TYPE), ("entropy", fixed.ENTROPY_TYPE)) if kind in missing]
        some = [r for r in rules if r.name in missing]
        which += ["signature"] if some else []
        todo = stored(todo.select("digest", "file"))
        texts = wanted.join(F.broadcast(todo) if size_in_bytes(todo) <= BROADCAST_BYTES else todo, ["digest", "file"], "left_semi")
        # A path that comes several times with one content is one content all the same.
        found = detect(texts.select("digest", "content"), some, "digest", which=tuple(which), distinct=True, partitions=partitions).distinct()
        unit = F.element_at(F.create_map(*(F.lit(x) for pair in sorted(missing.items()) for x in pair)), F.col("type"))
        self._append("findings", found.select("digest", unit.alias("unit"), "line", "type", "match"))
        after = sorted(met | set(missing.values()))
        version = _digest(after)
        self._append("versions", self.spark.createDataFrame([(version, u) for u in after], _VERSIONS))
        self._append("scanned", todo.select("digest", F.lit(version).alias("version"), F.lit(len(after)).alias("n_units")))
