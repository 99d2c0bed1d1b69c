"""Operators over commits, commit trees and the secrets in them.

Findings are made once per distinct blob and joined to the trees afterwards. From
there on a secret is its 32-byte digest, so that the text of a line, which may be long,
is not carried through the joins with trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from keysweep.functions.exposure import exposure_window
from keysweep.functions.paths import is_scanned, under, within_size_cap
from keysweep.operators.intervals import at_or_before, union_intervals, with_next
from keysweep.plans.skew import skew_join
from keysweep.plans.store import stored, stored_by

# Positions per bucket of the commit order. An order index is below 2**31, so there are at most
# 2**31 / _BUCKET buckets of known commits, and _UNKNOWN_BUCKETS of commits missing from the log.
_BUCKET = 1 << 16
_UNKNOWN_BUCKETS = 4096


def commit_order(commits: DataFrame) -> DataFrame:
    """Order index from the log position: the log lists the newest commit first, index 0 is the oldest."""
    total = commits.agg(F.count("*")).scalar()
    return commits.select("commit", "message", (total - 1 - F.col("log_pos")).alias("order_index"))


def commit_lookup(commits: DataFrame, wanted: DataFrame) -> DataFrame:
    """Message and order index of the commits named in ``wanted``; unknown ones give no row."""
    return commit_order(commits).join(wanted.select("commit").distinct(), "commit", "left_semi")


def with_secret_id(findings: DataFrame) -> DataFrame:
    """Digest of type and match, the identity of a secret across files and commits."""
    text = F.concat("type", F.lit("\x00"), "match")
    return findings.withColumn("secret_id", F.unhex(F.sha2(text, 256)))


def scanned_entries(entries: DataFrame, base: str | None = None) -> DataFrame:
    return entries.where(is_scanned(F.col("path"))).select(
        "commit", under(base, F.col("path")).alias("file"), "blob_id")


def snapshot_files(entries: DataFrame, blobs: DataFrame, base: str | None = None,
                   max_blob_bytes: int | None = None) -> DataFrame:
    """Every file of every commit's tree that is scanned: path filters, then a size cap if one is given."""
    sizes = blobs.select("blob_id", "size")
    if max_blob_bytes is not None:
        sizes = sizes.where(within_size_cap(F.col("size"), max_blob_bytes))
    return skew_join(scanned_entries(entries, base), sizes, "blob_id").select("commit", "file", "blob_id", "size")


def snapshot_findings(entries: DataFrame, found: DataFrame, base: str | None = None,
                      found_bytes: int | None = None) -> DataFrame:
    """Findings of each commit's whole tree: ``(commit, file, line, type, match)``."""
    hits = found.select("blob_id", "line", "type", "match")
    joined = skew_join(scanned_entries(entries, base), hits, "blob_id", small_bytes=found_bytes)
    return joined.select("commit", "file", "line", "type", "match")


def with_message(findings: DataFrame, commits: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Attach the commit's message to findings that carry a commit."""
    return skew_join(findings, commits.select("commit", "message"), "commit", how="left", weights=weights)


def count_by_commit(entries: DataFrame, found: DataFrame, found_bytes: int | None = None) -> DataFrame:
    """Findings per commit; they are counted per blob before the trees multiply them."""
    per_blob = found.groupBy("blob_id").agg(F.count("*").alias("_n"))
    joined = skew_join(scanned_entries(entries), per_blob, "blob_id", small_bytes=found_bytes)
    return joined.groupBy("commit").agg(F.sum("_n").alias("n_findings"))


def entries_with_findings(entries: DataFrame, found: DataFrame, base: str | None = None,
                          found_bytes: int | None = None) -> DataFrame:
    """Tree entries whose blob has a finding: usually a small part of all entries."""
    blobs = found.select("blob_id").distinct()
    return skew_join(scanned_entries(entries, base), blobs, "blob_id", how="left_semi", small_bytes=found_bytes)


def commit_sequence(hits: DataFrame, commits: DataFrame, include_clean: bool = False) -> DataFrame:
    """Commits with at least one finding, oldest first: ``(commit, message, order_index, pos)``.

    A clean commit is not part of the sequence, so a secret that only a clean commit
    removed counts as still present; ``include_clean`` puts every commit of the log in.
    A commit that the log lacks has index 0 and goes before the others. Positions are
    numbered inside buckets of the order index; only one row per bucket, and their number
    is bounded, is ever sorted in one place.
    """
    order = commit_order(commits)
    seen = hits.select("commit").distinct()
    rows = seen.join(order, "commit", "full" if include_clean else "left")
    unknown = F.col("order_index").isNull()
    digest = F.md5("commit")
    bucket = F.when(unknown, F.conv(F.left(digest, F.lit(3)), 16, 10).cast("long") - _UNKNOWN_BUCKETS) \
        .otherwise(F.floor(F.col("order_index") / _BUCKET))
    rows = stored(rows.select("commit", "message", "order_index", bucket.alias("_bucket")), "zstd")
    inside = Window.partitionBy("_bucket").orderBy(F.col("order_index"), "_digest")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n")) \
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        # Commits move to their bucket without the digest.
        rows.repartition("_bucket").withColumn("_digest", digest).withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(sizes), "_bucket")
        .select("commit", "message", F.coalesce("order_index", F.lit(0)).cast("long").alias("order_index"),
                (F.col("_before") + F.col("_inside") - 1).alias("pos"))
    )


def secrets_per_commit(entries: DataFrame, found: DataFrame, found_bytes: int | None = None) -> DataFrame:
    """Distinct secrets in each commit: ``(commit, secret_id)``."""
    pairs = scanned_entries(entries).select("commit", "blob_id").distinct()
    secrets = found.select("blob_id", "secret_id").distinct()
    return skew_join(pairs, secrets, "blob_id", small_bytes=found_bytes).select("commit", "secret_id").distinct()


def secret_positions(hits: DataFrame, found: DataFrame, found_bytes: int | None = None) -> DataFrame:
    """Where every secret is: ``(pos, secret_id)``, each pair once.

    ``hits`` are entries with findings that carry a position: ``(pos, file, blob_id)``.
    """
    pairs = hits.select("pos", "blob_id").distinct()
    secrets = found.select("blob_id", "secret_id").distinct()
    return skew_join(pairs, secrets, "blob_id", small_bytes=found_bytes).select("pos", "secret_id").distinct()


def secret_spans(hits: DataFrame, found: DataFrame, found_bytes: int | None = None) -> DataFrame:
    """First position, last position and number of commits of every secret."""
    return secret_positions(hits, found, found_bytes).groupBy("secret_id").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("exposure_commits"))


def secret_lifecycle(spans: DataFrame, sequence: DataFrame, found: DataFrame,
                     sequence_bytes: int | None = None) -> DataFrame:
    """What happened to each secret, keyed by type and match, wherever it was found.

    It was introduced by its first commit and removed by the commit that follows its
    last one in the sequence; without such a commit it is still present.
    """
    named = found.select("secret_id", "type", "match").dropDuplicates(["secret_id"])
    first = sequence.select(F.col("pos").alias("first_pos"), F.col("commit").alias("introduced_commit"))
    after = sequence.select((F.col("pos") - 1).alias("last_pos"), F.col("commit").alias("removed_commit"))
    # Few commits follow a last one; without the others the sequence need not move.
    after = after.join(spans.select("last_pos").distinct(), "last_pos", "left_semi")
    # Very many secrets can share their first or last commit.
    begun = skew_join(spans, first, "first_pos", small_bytes=sequence_bytes)
    life = skew_join(begun, after, "last_pos", how="left", weights=spans, small_bytes=sequence_bytes)
    active = F.col("removed_commit").isNull()
    return life.join(named, "secret_id").select(
        "secret_id", "type", "match", "introduced_commit", "removed_commit", "exposure_commits",
        exposure_window(F.col("exposure_commits"), active, F.col("removed_commit")).alias("exposure_window"),
        active.alias("still_present_in_head"),
    )


def first_sightings(hits: DataFrame, found: DataFrame, found_bytes: int | None = None) -> DataFrame:
    """Findings deduplicated over all commits; the earliest commit survives: ``(file, line, secret_id, pos)``."""
    earliest = hits.groupBy("file", "blob_id").agg(F.min("pos").alias("pos"))
    places = found.select("blob_id", "line", "secret_id").distinct()
    return (
        skew_join(earliest, places, "blob_id", small_bytes=found_bytes)
        .groupBy("file", "line", "secret_id").agg(F.min("pos").alias("pos"))
    )


def history_report(sightings: DataFrame, lifecycle: DataFrame, sequence: DataFrame,
                   sequence_bytes: int | None = None) -> DataFrame:
    """Deduplicated findings with the commit that first had them and their lifecycle."""
    where = sequence.select("pos", "commit", "message")
    dated = skew_join(sightings, where, "pos", small_bytes=sequence_bytes)
    full = skew_join(dated, lifecycle, "secret_id", weights=sightings)
    return full.select(
        "file", "line", "type", "match", "commit", "message", "introduced_commit", "removed_commit",
        "exposure_commits", "exposure_window", "still_present_in_head",
    )


def exposure_intervals(positions: DataFrame, sequence: DataFrame, found: DataFrame, sequence_bytes: int | None = None) -> DataFrame:
    """Every time that a secret was there: ``(type, match, introduced_commit, removed_commit, exposure_commits)``.

    ``positions`` are those of ``secret_positions``. An interval is a longest run of commits of the sequence that have the
    secret; the commit that follows it removed the secret, and without one (null) the secret is still present. The
    ``exposure_commits`` of a secret's intervals add up to those of its lifecycle.
    """
    runs = union_intervals(positions.select("secret_id", F.col("pos").alias("first_pos"), F.col("pos").alias("last_pos")), ["secret_id"], few=True)
    named = found.select("secret_id", "type", "match").dropDuplicates(["secret_id"])
    runs = stored(runs.withColumn("exposure_commits", F.col("last_pos") - F.col("first_pos") + 1), "zstd")
    return _between_commits(runs, sequence, sequence_bytes).join(named, "secret_id").select(
        "type", "match", "introduced_commit", "removed_commit", "exposure_commits")


def _between_commits(runs: DataFrame, sequence: DataFrame, sequence_bytes: int | None) -> DataFrame:
    """``runs`` with the commit of ``first_pos`` and the one behind ``last_pos``, if any."""
    first = sequence.select(F.col("pos").alias("first_pos"), F.col("commit").alias("introduced_commit"))
    after = sequence.select((F.col("pos") - 1).alias("last_pos"), F.col("commit").alias("removed_commit"))
    begun = skew_join(runs, first, "first_pos", weights=runs, small_bytes=sequence_bytes)
    return skew_join(begun, after, "last_pos", how="left", weights=runs, small_bytes=sequence_bytes)


def tree_runs(entries: DataFrame, commits: DataFrame, base: str | None = None) -> DataFrame:
    """Trees as runs: ``(file, blob_id, first_index, last_index)``, from the first to the last order index of commits in a row
    that have this content at this path. Only files that are scanned; entries of commits that the log lacks are left out.

    One pass over all entries; from then on work grows with what changed, not with commits times files.
    """
    order = commit_order(commits).select("commit", F.col("order_index").alias("first_index"))
    placed = skew_join(scanned_entries(entries, base), order, "commit").withColumn("last_index", F.col("first_index"))
    return union_intervals(placed, ["file", "blob_id"], "first_index", "last_index", few=True)


def runs_from_changes(changes: DataFrame, n_commits: int, base: str | None = None) -> DataFrame:
    """The same from what each commit changed: ``(order_index, path, blob_id)``, a null ``blob_id`` for a path that went.

    A content lasts until the next change of its path, the last one until the last of the ``n_commits``. Trees are never built, and
    only changes are shuffled. Of several changes of a path by one commit, one that sets a content wins, of these the largest id.
    """
    wanted = changes.where(is_scanned(F.col("path"))).select(under(base, F.col("path")).alias("file"), F.col("order_index").cast("long").alias("first_index"), "blob_id")
    once = stored(wanted.groupBy("file", "first_index").agg(F.max("blob_id").alias("blob_id")))
    lasting = with_next(once, ["file"], "first_index", "_next").where("blob_id IS NOT NULL")
    spans = lasting.select("file", "blob_id", "first_index", (F.coalesce("_next", F.lit(n_commits)) - 1).alias("last_index"))
    # A change to the content that is there already begins no run of its own.
    return union_intervals(spans, ["file", "blob_id"], "first_index", "last_index")


def sightings(entries: DataFrame, found: DataFrame, commits: DataFrame) -> DataFrame:
    """``(secret_id, order_index)`` of every commit that has a secret, not necessarily once; ``entries`` may be a stream."""
    order = commit_order(commits).select("commit", "order_index")
    secrets = found.select("blob_id", "secret_id").distinct()
    if entries.isStreaming:
        # Every batch of the stream joins them: they are made and moved once.
        order, secrets = stored_by(order, "commit"), stored(secrets)
    return scanned_entries(entries).select("commit", "blob_id").join(secrets, "blob_id").join(order, "commit").select("secret_id", "order_index")


def lifecycle_from_runs(runs: DataFrame, found: DataFrame, commits: DataFrame, found_bytes: int | None = None) -> DataFrame:
    """The rows of ``secret_lifecycle`` from runs of trees: a sweep over interval ends in place of a row for every commit and file.

    Runs of contents with a finding make intervals per secret. What any secret covers are the commits of the sequence, so a secret is removed
    by the first covered commit behind its last one.
    """
    secrets = found.select("blob_id", "secret_id").distinct()
    held = skew_join(runs.select("blob_id", "first_index", "last_index"), secrets, "blob_id", small_bytes=found_bytes)
    return lifecycle_of_intervals(union_intervals(held, ["secret_id"], "first_index", "last_index"), found, commits)


def lifecycle_of_intervals(spans: DataFrame, found: DataFrame, commits: DataFrame) -> DataFrame:
    """The lifecycle from the disjoint intervals ``(secret_id, first_index, last_index)`` of all secrets."""
    spans = stored(spans, "zstd")
    covered = stored(union_intervals(spans, [], "first_index", "last_index"))
    covered = stored(with_next(covered.withColumnRenamed("last_index", "until"), [], "first_index", "next_index").withColumnRenamed("first_index", "at"))
    lives = stored(spans.groupBy("secret_id").agg(
        F.min("first_index").alias("first_index"), F.max("last_index").alias("at"),
        F.sum(F.col("last_index") - F.col("first_index") + 1).alias("exposure_commits")))
    ends = at_or_before(lives.select("at").distinct(), covered, "at", ["until", "next_index"])
    ends = stored(ends.select("at", F.when(F.col("at") < F.col("until"), F.col("at") + 1).otherwise(F.col("next_index")).alias("removed_index")))
    order = stored(commit_order(commits).select("order_index", "commit"), "zstd")
    first = order.select(F.col("order_index").alias("first_index"), F.col("commit").alias("introduced_commit"))
    after = order.select(F.col("order_index").alias("removed_index"), F.col("commit").alias("removed_commit"))
    # Few commits remove a secret; without the others the order need not move.
    after = ends.join(after.join(ends, "removed_index", "left_semi"), "removed_index", "left").select("at", "removed_commit")
    life = skew_join(skew_join(lives, first, "first_index", weights=lives), after, "at", weights=lives)
    named = found.select("secret_id", "type", "match").dropDuplicates(["secret_id"])
    active = F.col("removed_commit").isNull()
    return life.join(named, "secret_id").select(
        "secret_id", "type", "match", "introduced_commit", "removed_commit", "exposure_commits",
        exposure_window(F.col("exposure_commits"), active, F.col("removed_commit")).alias("exposure_window"),
        active.alias("still_present_in_head"))
