"""Reports as one file, against the rows they are made from."""

import json
import random

import pytest
from pyspark.sql import functions as F

from keysweep import write_report_file
from keysweep.operators import document, report
from keysweep.operators.document import write_document
from keysweep.schemas import FINDING


def some(spark, n):
    rng = random.Random(n)
    rows = [(f"/r/{rng.choice('abc')}/é{rng.randrange(9)}.py", rng.randrange(1, 99), rng.choice(["Keyword Secret", "AWS Access Key ID", "T\"3"]),
             f"v{i}" + "x1" * rng.randrange(40), "c" * 40, "m\n\"q\"", "i" * 40, None, 2, "Exposed for 2 commits", i % 2 == 0) for i in range(n)]
    return spark.createDataFrame(rows, FINDING).repartition(5)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_json_file(spark, tmp_path, n):
    findings = some(spark, n)
    path = tmp_path / "report.json"
    path.write_text("old")
    assert write_report_file(findings, str(path), "json", root="/r") == n
    whole = json.loads(path.read_text())
    assert whole["total_findings"] == n and whole["sanitized"] is True and whole["scan_time"]
    rows = report.json_rows(findings, "/r").orderBy("file", "line", "type", "match")
    want = [json.loads(r.value) for r in rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).collect()]
    key = lambda r: (r["file"].encode(), r["line"], r["type"], r["match"])
    assert [key(r) for r in whole["findings"]] == sorted(map(key, want))
    assert sorted(whole["findings"], key=str) == sorted(want, key=str)
    assert [p.name for p in tmp_path.iterdir()] == ["report.json"]


@pytest.mark.parametrize("n", [0, 300])
def test_markdown_file(spark, tmp_path, n):
    findings = some(spark, n)
    assert write_report_file(findings, f"file://{tmp_path}/report.md") == n
    want = [r.value for r in report.markdown_document(findings).collect()]
    got = (tmp_path / "report.md").read_text()
    assert sorted(got.split("\n")) == sorted(("\n".join(want) + "\n").split("\n"))
    assert got.startswith("# Secret Exposure Report") and got.endswith(want[-1] + "\n")


def test_many_parts_in_order(spark, tmp_path):
    rows = spark.range(20_000, numPartitions=13).select("id", F.concat(F.lit("é"), F.lpad(F.col("id"), 6, "0")).alias("value"))
    rows = rows.unionByName(spark.range(3).select("id", F.lit(None).cast("string").alias("value")))
    assert write_document(rows, str(tmp_path / "out"), ["id"], head="<", between="|", tail=">") == 20_000
    assert (tmp_path / "out").read_text() == "<" + "|".join(f"é{i:06d}" for i in range(20_000)) + ">"


def test_nothing_is_left_of_a_job_that_breaks_off(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") == 70, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="stop"):
        write_document(rows, str(tmp_path / "out"), ["id"])
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(ValueError):
        write_document(rows, "s3://bucket/out", ["id"])
    with pytest.raises(ValueError):
        write_report_file(rows, str(tmp_path / "out"), "xml")
    assert document._local("file:///a/b") == "/a/b"
