"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "entity_with_lines", "detail_nested", "state_coverage", "ratings_histogram", "trending_topk", "latest_per_key", "first_n_per_key", "run_metrics", "json_props_quality", "upsert_merge", "analytic_windows",
    "asof_events", "session_windows", "term_flags", "uom_convert", "alias_cascade", "classify_longest_keyword", "rule_tags", "place_classifier", "title_similarity_pairs", "quality_verdict", "fingerprint_dupes",
    "knn_join", "html_title_links",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from pantrylake.plans.catalogue import queries
    from pantrylake.session import SETTINGS

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config(map=SETTINGS | {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp()})
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    found, times = queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            t = time.perf_counter()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs[1:]), 4)  # the first run warms up
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
