"""Times the headline queries: prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from votelens.queries import QUERIES

#: The same set in every round, so that totals compare; EXTRA ones are timed beside it and not summed.
HEADLINE = (
    "annotator_flags", "scored_records", "route_items", "calibration_sweep", "ablation_table", "layer0_effect", "marginal_cost", "escalated_detail",
    "peer_votes", "order_views", "annotator_history", "evidence_bundle", "history_patterns", "verifier_grades", "validate_verdicts", "retry_resolve",
    "trace_audit", "tool_call_counts", "call_cost", "assign_items", "injection_plan", "upsert_latest", "contract_audit",
)
EXTRA = ("grading_runs", "grading_calls", "judgment_items", "rewrite_slice", "upsert_runs", "protocol_breaches", "contract_breaches", "placed_records")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["annotator_load"](spark, sf_dir).collect()  # starts the JVM's and Python's parts
    took: dict[str, float] = {}
    for name in HEADLINE + EXTRA:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took[name] for name in HEADLINE), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
