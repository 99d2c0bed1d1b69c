"""Whole scans: a working tree, and a commit history."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from keysweep.functions.paths import is_scanned, relative_to, within_size_cap
from keysweep.operators import history
from keysweep.operators.detect import ALL, detect
from keysweep.operators.findings import dedupe
from keysweep.plans.skew import BROADCAST_BYTES, skew_join
from keysweep.plans.store import size_in_bytes, stored
from keysweep.sources.directory import PIECE_BYTES, list_files, read_files
from keysweep.sources.rules import Rule


def scan_files(files: DataFrame, rules: list[Rule], which=ALL, unique_paths: bool = False,
               partitions: int | None = None, root: str | None = None) -> DataFrame:
    """Deduplicated findings ``(file, line, type, match)`` of a table ``(path, content)``.

    Files are filtered by path before their content is looked at; names of folders above ``root`` do not
    count, its own does. Equal findings of one
    row are dropped in place. If no path occurs twice, say so: nothing is shuffled then.
    Otherwise one shuffle, of findings only, drops the others.
    """
    path = F.col("path")
    if root and "/" in root.rstrip("/"):
        path = relative_to(path, root.rstrip("/").rsplit("/", 1)[0])
    wanted = files.where(is_scanned(path)).select(F.col("path").alias("file"), "content")
    found = detect(wanted, rules, "file", which=which, distinct=True, partitions=partitions)
    return found if unique_paths else dedupe(found)


def _placed(found: DataFrame) -> DataFrame:
    return found.select("file", (F.col("line") + F.col("first_line") - 1).alias("line"), "type", "match")


def scan_directory(spark: SparkSession, root: str, rules: list[Rule], which=ALL) -> DataFrame:
    """Deduplicated findings of a directory tree on storage that all executors reach.

    Every line of a file is in exactly one piece, so equal findings come from one line only
    and are dropped there, without a shuffle. A piece that cannot be read fails the scan; see ``scan_readable`` for another way.
    """
    pieces = read_files(list_files(spark, root)).withColumnRenamed("path", "file")
    return _placed(detect(pieces, rules, "file", "first_line", which=which, distinct=True))


def scan_readable(spark: SparkSession, files: DataFrame, rules: list[Rule], which=ALL,
                  piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Findings of the listed ``files`` (``path, size``) as far as they can be read, and a row
    ``(path, piece, reason)`` for every piece that cannot, after several attempts.

    Files are read once; both tables come from one stored result. Lines behind an unreadable piece of the same file have findings with a null line,
    as nobody knows how many lines the piece has.
    """
    pieces = read_files(files, piece_bytes, on_error="reject").withColumnRenamed("path", "file")
    found = stored(detect(pieces, rules, "file", "piece", "first_line", "reason", which=which, distinct=True, always=F.col("reason").isNotNull()))
    rejects = found.where("type IS NULL").select(F.col("file").alias("path"), "piece", "reason")
    # Equal findings of one file whose lines are unknown cannot be told apart.
    return _placed(found.where("type IS NOT NULL")), rejects


class HistoryScan:
    """Findings and lifecycles over all commits.

    ``blobs(blob_id, size, content)`` holds distinct contents, ``entries(commit, path, blob_id)``
    the full tree of each commit, ``commits(commit, message, log_pos)`` the log.
    Three small tables are stored because several branches read them: the findings per blob,
    the tree entries that have findings, and the order of the commits. Blobs of any size are scanned
    unless ``max_blob_bytes`` is given.
    """

    def __init__(self, blobs: DataFrame, entries: DataFrame, commits: DataFrame, rules: list[Rule],
                 base: str | None = None, include_clean: bool = False, partitions: int | None = None,
                 max_blob_bytes: int | None = None):
        self.blobs, self.entries, self.commits = blobs, entries, commits
        self.rules, self.base, self.include_clean, self.partitions = rules, base, include_clean, partitions
        self.max_blob_bytes = max_blob_bytes

    @cached_property
    def found(self) -> DataFrame:
        """Findings of each distinct blob, whatever the number of commits that hold it."""
        blobs = self.blobs
        if self.max_blob_bytes is not None:
            blobs = blobs.where(within_size_cap(F.col("size"), self.max_blob_bytes))
        return stored(history.with_secret_id(detect(blobs, self.rules, "blob_id", partitions=self.partitions)))

    @cached_property
    def found_bytes(self) -> int:
        """Measured once; it bounds every selection of columns of the findings, too."""
        return size_in_bytes(self.found)

    @cached_property
    def _secrets(self) -> DataFrame:
        """A number for each secret, a fourth of its digest."""
        return stored(self.found.select("secret_id").distinct().withColumn("number", F.monotonically_increasing_id()))

    @cached_property
    def _numbered(self) -> DataFrame:
        """The findings with numbers in place of digests, for joins with trees."""
        return stored(self.found.join(self._secrets, "secret_id").select("blob_id", "line", "type", "match", F.col("number").alias("secret_id")))

    def _digested(self, life: DataFrame) -> DataFrame:
        digests = self._secrets.select(F.col("secret_id").alias("digest"), F.col("number").alias("secret_id"))
        return life.join(digests, "secret_id").withColumn("secret_id", F.col("digest")).select(life.columns)

    @cached_property
    def _raw_hits(self) -> DataFrame:
        return stored(history.entries_with_findings(self.entries, self.found, self.base, self.found_bytes), "zstd")

    @cached_property
    def sequence(self) -> DataFrame:
        return stored(history.commit_sequence(self._raw_hits, self.commits, self.include_clean), "zstd")

    @cached_property
    def sequence_bytes(self) -> int:
        return size_in_bytes(self.sequence)

    @cached_property
    def hits(self) -> DataFrame:
        """Tree entries with findings, with the position of their commit instead of its hash."""
        order = self.sequence.select("commit", "pos")
        placed = skew_join(self._raw_hits, order, "commit", small_bytes=self.sequence_bytes)
        return stored(placed.select("pos", "file", "blob_id"), "zstd")

    def snapshot_findings(self) -> DataFrame:
        return history.snapshot_findings(self.entries, self.found, self.base, self.found_bytes)

    def history_findings(self) -> DataFrame:
        return history.with_message(self.snapshot_findings(), self.commits, weights=self._raw_hits)

    def findings_by_commit(self) -> DataFrame:
        return history.count_by_commit(self.entries, self.found, self.found_bytes)

    def secrets_per_commit(self) -> DataFrame:
        pairs = history.secrets_per_commit(self.entries, self._numbered, self.found_bytes)
        if self.found_bytes > BROADCAST_BYTES:
            pairs = stored(pairs, "zstd")  # the join below reads them twice
        named = self._numbered.select("secret_id", "type", "match").dropDuplicates(["secret_id"])
        return skew_join(pairs, named, "secret_id", small_bytes=self.found_bytes) \
            .select("commit", "type", "match")

    @cached_property
    def _lifecycle(self) -> DataFrame:
        spans = history.secret_spans(self.hits, self._numbered, self.found_bytes)
        return history.secret_lifecycle(stored(spans), self.sequence, self._numbered, self.sequence_bytes)

    @property
    def lifecycle(self) -> DataFrame:
        return self._digested(self._lifecycle)

    def exposure_intervals(self) -> DataFrame:
        """One row for every time that a secret was there, where the lifecycle has one row per secret."""
        positions = history.secret_positions(self.hits, self._numbered, self.found_bytes)
        return history.exposure_intervals(positions, self.sequence, self._numbered, self.sequence_bytes)

    @cached_property
    def runs(self) -> DataFrame:
        """Trees as runs of commits; stored, as later scans of the same history read them in place of the entries."""
        return stored(history.tree_runs(self.entries, self.commits, self.base), "zstd")

    def lifecycle_from_runs(self, runs: DataFrame | None = None) -> DataFrame:
        """The lifecycle from runs of trees, by default those of the entries."""
        runs = self.runs if runs is None else runs
        return self._digested(history.lifecycle_from_runs(runs, self._numbered, self.commits, self.found_bytes))

    def report(self) -> DataFrame:
        """Deduplicated findings over all commits with lifecycle columns; sort and redact them for output."""
        sightings = stored(history.first_sightings(self.hits, self._numbered, self.found_bytes))
        return history.history_report(sightings, self._lifecycle, self.sequence, self.sequence_bytes)
