"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every query runs to its last
row, which is thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from keysweep.catalog.queries import QUERIES

HEADLINE = [
    "detect_all", "sig_match", "keyword_match", "high_entropy", "explode_lines", "scan_files", "scan_raw_tables",
    "findings_by_type", "sort_findings", "redact_match", "scan_commit_snapshots", "findings_by_commit",
    "commit_sequence", "secret_lifecycle", "history_report", "report_json", "report_markdown",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first query of a session pays for starting the JVM's compilers; this one is not counted.
    QUERIES["detect_all"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
