"""Plans have the shape that holds at scale."""

import re

import pytest

from keysweep import load_rules, scan_files
from keysweep.catalog import corpus
from keysweep.operators.detect import detect
from keysweep.plans.scan import HistoryScan
from keysweep.plans.skew import skew_join


def plan_of(frame, capsys) -> str:
    frame.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture(scope="module")
def rules(spark):
    return load_rules(spark)


def test_detection_is_one_stage_without_python(spark, rules, sf_dir, capsys):
    documents = corpus.table(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    plan = plan_of(detect(documents, rules, "doc_id"), capsys)
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan
    assert re.search(r"ReadSchema: struct<doc_id:bigint,content|ReadSchema: struct<doc_id:bigint,text", plan)
    # Lines are filtered in the stage that makes them, and the content is split once.
    assert re.search(r"\* Filter \(\d+\)\n\s*\+- \* Generate", plan)
    assert plan.count("split(text#") + plan.count("split(content#") == 1


def test_scan_shuffles_findings_only(spark, rules, capsys):
    table = spark.createDataFrame([("a.py", "x")], "path string, content string")
    assert "Exchange" not in plan_of(scan_files(table, rules, unique_paths=True), capsys)
    plan = plan_of(scan_files(table, rules), capsys)
    assert len(re.findall(r"^\(\d+\) Exchange\nInput \[4\]: \[file#\d+, line#\d+L, type#\d+, match#\d+\]", plan, re.M)) == 1
    assert len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) == 1


def test_generated_code_can_be_compiled_to_machine_code(spark, rules, sf_dir):
    """The virtual machine leaves methods of more than 8000 bytes interpreted."""
    documents = corpus.table(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    frame = detect(documents, rules, "doc_id")
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(
        frame._jdf.queryExecution().executedPlan())
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert len(sizes) >= 2 and max(sizes) < 8000


def test_no_cross_join_and_nothing_unbounded_in_one_place(spark, rules, sf_dir, capsys):
    scan = HistoryScan(corpus.blobs(spark, sf_dir), corpus.entries(spark, sf_dir), corpus.commits(spark, sf_dir), rules)
    for frame in (scan.history_findings(), scan.secrets_per_commit(), scan.lifecycle, scan.report()):
        plan = plan_of(frame, capsys)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_skew_join_without_a_size_broadcasts_hot_keys_only(spark, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(1000).selectExpr("id % 7 AS k", "id")
        small = spark.range(7).selectExpr("id AS k", "'s' AS s")
        plan = plan_of(skew_join(big, small, "k"), capsys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"^\(\d+\) SortMergeJoin", plan, re.M)) == 1
    assert len(re.findall(r"^\(\d+\) BroadcastHashJoin", plan, re.M)) == 2


def test_detection_runs_on_a_stream_of_files(spark, rules, sf_dir, tmp_path):
    """Detection keeps no state, so a stream gives the findings of the batch."""
    files = corpus.files(spark, sf_dir)
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    query = (
        detect(stream, rules, "path").writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, detect(files, rules, "path").collect())) and got
