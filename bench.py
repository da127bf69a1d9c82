"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores. The log
files a query reads are rendered before its clock starts; the clock covers planning, detection, numbering
and the whole result.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from catalog import render
from catalog.queries import QUERIES

HEADLINE = (
    "triage", "triage_full", "entries_prefilter", "entries_full", "scan_hits", "sniff_formats", "lines_numbered", "lines_gzip",
    "parse_chain", "parse_bracket", "parse_access", "parse_syslog5424", "parse_syslog3164", "parse_jsonl", "parse_cef",
    "parse_logfmt", "parse_ltsv", "parse_loose", "window_week", "payload", "redact_documents", "segments", "review_dataset",
    "findings", "triage_with_review",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("bracket", "by_type"):
        render.files(spark, sf_dir, name)
    render.files(spark, sf_dir, "bracket", "gzip")
    events = render.events(spark, sf_dir).count()
    QUERIES["triage"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"), "events": events, "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
