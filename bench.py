"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores, BENCH_REPEATS the runs per query (the
lower median counts). Results go to the no-op sink, so that every output column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from ledgerline.registry import QUERIES
from ledgerline.session import RECOMMENDED_CONF

HEADLINE = (
    "claims",
    "reconcile",
    "resolve_identifiers",
    "operational_lines",
    "bom_assertions",
    "expected_requirements",
    "expected_vs_observed",
    "state_anomalies",
    "detect_end_to_end",
    "evidence_chain",
    "sku_worklist",
    "scenario_cost",
    "po_boq_coverage",
    "ledger_append",
    "ledger_search",
    "ledger_search_batch",
    "structure_documents",
    "normalize_observations",
    "validate_po_lines",
    "validate_operational_states",
    "ingest_bom_xlsx",
)


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in RECOMMENDED_CONF.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    run(spark, names[0], sf_dir)
    seconds = {
        name: round(statistics.median_low(run(spark, name, sf_dir) for _ in range(repeats)), 3) for name in names
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
