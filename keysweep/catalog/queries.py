"""One query per operator: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from keysweep.catalog import corpus
from keysweep.functions import entropy, keywords, paths, redact
from keysweep.operators import findings as found_ops
from keysweep.operators import blocks, history, report, topology
from keysweep.operators.detect import detect
from keysweep.operators.lines import is_truncated, number_lines
from keysweep.operators.many_rules import detect_many
from keysweep.plans.incremental import IncrementalScan
from keysweep.plans.scan import HistoryScan, scan_files as scan
from keysweep.plans.store import checkpoint_root, stored
from keysweep.sources.rules import load_rules, rules_frame
from keysweep.streaming.lifecycle import LifecycleStream

# The line limit of one mebibyte is not reached in the tables; the query uses a lower one.
SHORT_LINE_LIMIT = 400


def _partitions(spark: SparkSession, sf_dir: str) -> int | None:
    """One per core if the documents come in fewer splits than that; a large table needs none."""
    cores = spark.sparkContext.defaultParallelism
    # On a bare scan this only lists splits.
    return cores if corpus.table(spark, sf_dir, "documents").rdd.getNumPartitions() < cores else None


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    partitions = _partitions(spark, sf_dir)
    files = corpus.files(spark, sf_dir)
    return files.repartition(partitions, "doc_id") if partitions else files


def _detected(spark: SparkSession, sf_dir: str, *which: str) -> DataFrame:
    return detect(corpus.files(spark, sf_dir), load_rules(spark), "doc_id", which=which,
                           partitions=_partitions(spark, sf_dir))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(corpus.files(spark, sf_dir), load_rules(spark), partitions=_partitions(spark, sf_dir))


def _history(spark: SparkSession, sf_dir: str) -> HistoryScan:
    # Trees are tables in practice; stored, their paths are not computed anew for every filter.
    return HistoryScan(corpus.blobs(spark, sf_dir), stored(corpus.entries(spark, sf_dir), "zstd"),
                       corpus.commits(spark, sf_dir), load_rules(spark), partitions=_partitions(spark, sf_dir))


def scan_files(spark, sf_dir):
    return _scanned(spark, sf_dir)


def scan_incremental(spark, sf_dir):
    files, rules, partitions = corpus.files(spark, sf_dir), load_rules(spark), _partitions(spark, sf_dir)
    scan = IncrementalScan(spark, f"{checkpoint_root(spark)}/keysweep/{uuid4().hex}")
    # A part of the tree under half of the rules, then the whole tree under all of them.
    scan.scan(files.where("path LIKE 'repo/pkg/%'"), rules[:len(rules) // 2], partitions)
    return scan.scan(files, rules, partitions)


def scan_raw_tables(spark, sf_dir):
    return scan(corpus.raw_files(spark, sf_dir), load_rules(spark), partitions=_partitions(spark, sf_dir))


def scan_commit_snapshots(spark, sf_dir):
    return _history(spark, sf_dir).snapshot_findings()


def snapshot_files(spark, sf_dir):
    return history.snapshot_files(corpus.entries(spark, sf_dir), corpus.blobs(spark, sf_dir))


def commit_order(spark, sf_dir):
    return history.commit_order(corpus.commits(spark, sf_dir))


def commit_lookup(spark, sf_dir):
    wanted = corpus.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    wanted = spark.sql("SELECT " + corpus._COMMIT.format("l_orderkey") + " AS commit FROM {r}", r=wanted)
    return history.commit_lookup(corpus.commits(spark, sf_dir), wanted)


def commit_topology(spark, sf_dir):
    return topology.commit_topology(corpus.graph(spark, sf_dir))


def path_parts(spark, sf_dir):
    path = F.col("path")
    return corpus.files(spark, sf_dir).select(
        "doc_id", "path", paths.base_name(path).alias("base"), paths.extension(path).alias("ext"),
        paths.relative_to(path, "repo/pkg/").alias("relative"), paths.under("/srv/checkout", path).alias("full"))


def filter_skip_dirs(spark, sf_dir):
    return corpus.files(spark, sf_dir).where(~paths.in_skipped_dir(F.col("path"))).select("doc_id", "path")


def filter_skip_files(spark, sf_dir):
    return corpus.files(spark, sf_dir).where(~paths.is_skipped_file(F.col("path"))).select("doc_id", "path")


def filter_valid_ext(spark, sf_dir):
    return corpus.files(spark, sf_dir).where(paths.has_valid_extension(F.col("path"))).select("doc_id", "path")


def filter_size_cap(spark, sf_dir):
    # No document is as large as the cap, so a size 100 times its own is declared.
    sizes = corpus.table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length("text").cast("long") * 100).alias("size"))
    return sizes.where(paths.within_size_cap(F.col("size")))


def explode_lines(spark, sf_dir):
    return number_lines(_files(spark, sf_dir), "doc_id")


def line_limit(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("truncated", is_truncated(F.col("content"), SHORT_LINE_LIMIT))
    return number_lines(files, "doc_id", "truncated", limit=SHORT_LINE_LIMIT)


def sig_match(spark, sf_dir):
    return _detected(spark, sf_dir, "signature")


def sig_match_many(spark, sf_dir):
    return detect_many(corpus.files(spark, sf_dir), load_rules(spark), "doc_id", partitions=_partitions(spark, sf_dir))


def sig_counts_by_rule(spark, sf_dir):
    rules = load_rules(spark)
    found = detect(corpus.files(spark, sf_dir), rules, "doc_id", which=("signature",),
                            partitions=_partitions(spark, sf_dir))
    return found_ops.count_by_rule(found, rules_frame(spark, rules))


def keyword_match(spark, sf_dir):
    return _detected(spark, sf_dir, "keyword")


def valid_secret_value(spark, sf_dir):
    words = _files(spark, sf_dir).select("doc_id", F.explode_outer(F.split("content", "[ \n]", -1)).alias("word"))
    return words.groupBy("doc_id").agg(
        F.count("*").alias("n_words"), F.count_if(keywords.is_secret_value(F.col("word"))).alias("n_valid"))


def _tokens(spark, sf_dir):
    lines = number_lines(_files(spark, sf_dir), "doc_id")
    return lines.select("doc_id", "line", F.explode_outer(entropy.long_tokens(F.col("text"))).alias("token")) \
        .where("token IS NOT NULL")


def long_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir)


def token_noise(spark, sf_dir):
    token = F.col("token")
    return _tokens(spark, sf_dir).select(
        "doc_id", "line", "token", entropy.has_repeat_run(token).alias("repeats"), entropy.is_noise(token).alias("noise"))


def shannon_entropy(spark, sf_dir):
    files = _files(spark, sf_dir)
    return files.select("doc_id", F.round(entropy.shannon_entropy(F.col("content")), 6).alias("entropy"))


def high_entropy(spark, sf_dir):
    return _detected(spark, sf_dir, "entropy")


def detect_all(spark, sf_dir):
    return _detected(spark, sf_dir, "signature", "keyword", "entropy")


def dedupe_findings(spark, sf_dir):
    bag = detect(corpus.files(spark, sf_dir).withColumnRenamed("path", "file"), load_rules(spark), "file",
                          partitions=_partitions(spark, sf_dir))
    return found_ops.dedupe(bag.unionByName(bag))


def sort_findings(spark, sf_dir):
    return found_ops.sort_findings(_scanned(spark, sf_dir))


def total_findings(spark, sf_dir):
    return found_ops.count_findings(_scanned(spark, sf_dir))


def findings_by_type(spark, sf_dir):
    return found_ops.count_by_type(_scanned(spark, sf_dir))


def findings_by_commit(spark, sf_dir):
    return _history(spark, sf_dir).findings_by_commit()


def secrets_per_commit(spark, sf_dir):
    return _history(spark, sf_dir).secrets_per_commit()


def history_findings(spark, sf_dir):
    return _history(spark, sf_dir).history_findings()


def commit_sequence(spark, sf_dir):
    return _history(spark, sf_dir).sequence


def secret_lifecycle(spark, sf_dir):
    return _history(spark, sf_dir).lifecycle.select(
        "type", "match", "introduced_commit", F.coalesce("removed_commit", F.lit("")).alias("removed_commit"),
        "exposure_commits", "still_present_in_head")


def exposure_intervals(spark, sf_dir):
    return _history(spark, sf_dir).exposure_intervals().withColumn("removed_commit", F.coalesce("removed_commit", F.lit("")))


def tree_runs(spark, sf_dir):
    return history.tree_runs(corpus.entries(spark, sf_dir), corpus.commits(spark, sf_dir))


def lifecycle_from_runs(spark, sf_dir):
    return _history(spark, sf_dir).lifecycle_from_runs().select(
        "type", "match", "introduced_commit", F.coalesce("removed_commit", F.lit("")).alias("removed_commit"),
        "exposure_commits", "still_present_in_head")


def stream_lifecycle(spark, sf_dir):
    """Tree entries arrive in small files, in the order of their files' names."""
    scan = _history(spark, sf_dir)
    arriving = spark.readStream.schema(scan.entries.schema).option("maxFilesPerTrigger", "4").parquet(scan.entries._stored_at)
    follow = LifecycleStream(spark, f"{checkpoint_root(spark)}/keysweep/{uuid4().hex}")
    follow.start(history.sightings(arriving, scan.found, scan.commits)).awaitTermination()
    return follow.lifecycle(scan.found, scan.commits).select(
        "type", "match", "introduced_commit", F.coalesce("removed_commit", F.lit("")).alias("removed_commit"),
        "exposure_commits", "still_present_in_head")


def exposure_window(spark, sf_dir):
    return _history(spark, sf_dir).lifecycle.select("type", "match", "exposure_window")


def history_report(spark, sf_dir):
    return found_ops.sort_findings(_history(spark, sf_dir).report()) \
        .withColumn("removed_commit", F.coalesce("removed_commit", F.lit("")))


def redact_match(spark, sf_dir):
    return _detected(spark, sf_dir, "signature", "keyword", "entropy") \
        .withColumn("redacted", redact.redact(F.col("match")))


def secret_prefix(spark, sf_dir):
    lines = number_lines(_files(spark, sf_dir), "doc_id")
    return lines.groupBy(redact.secret_prefix(F.col("text")).alias("prefix")).agg(F.count("*").alias("n_lines"))


def redact_multiline(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", redact.redact(F.col("content")).alias("redacted"))


def multiline_secrets(spark, sf_dir):
    found = blocks.multiline_secrets(corpus.keys(spark, sf_dir))
    return found.withColumn("redacted", redact.redact(F.col("match")))


def is_fully_masked(spark, sf_dir):
    lines = number_lines(_files(spark, sf_dir), "doc_id")
    shown = redact.redact(F.col("text"))
    return lines.groupBy("doc_id").agg(
        F.count_if(redact.is_fully_masked(F.col("text"))).alias("n_plain"),
        F.count_if(redact.is_fully_masked(shown)).alias("n_masked"))


def report_json(spark, sf_dir):
    rows = report.json_rows(_history(spark, sf_dir).report(), "o/repo")
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def report_markdown(spark, sf_dir):
    return report.markdown_document(stored(_history(spark, sf_dir).report()), "o/repo")


QUERIES = {q.__name__: q for q in (
    scan_files, scan_incremental, scan_raw_tables, scan_commit_snapshots, snapshot_files, commit_order, commit_lookup, commit_topology,
    path_parts, filter_skip_dirs, filter_skip_files, filter_valid_ext, filter_size_cap,
    explode_lines, line_limit, sig_match, sig_match_many, sig_counts_by_rule, keyword_match, valid_secret_value,
    long_tokens, token_noise, shannon_entropy, high_entropy, detect_all,
    dedupe_findings, sort_findings, total_findings, findings_by_type, findings_by_commit, secrets_per_commit,
    history_findings, commit_sequence, secret_lifecycle, exposure_window, history_report,
    exposure_intervals, tree_runs, lifecycle_from_runs, stream_lifecycle,
    redact_match, secret_prefix, redact_multiline, multiline_secrets, is_fully_masked, report_json, report_markdown,
)}
