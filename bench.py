"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload import page_queries, pii_queries, step_queries, sync_queries  # noqa: E402, F401
from workload.registry import REGISTRY  # noqa: E402

HEADLINE = (
    "page_type_summary", "page_types", "page_elements", "page_links", "page_visible_text", "page_hashes",
    "page_versions", "latest_pages", "account_elements", "account_table_rows", "login_plans", "pagination_plans",
    "replayed_selectors", "redacted_documents", "found_pii", "documents_with_pii", "redacted_records",
    "steps_until_failure", "step_success_rates", "effort_by_action", "dom_changes", "page_runs", "preference_pairs",
    "pending_queue", "completed_tasks", "routed_records", "exported_counts", "train_val_parts", "step_examples",
    "reward_rank_correlation", "mapped_orders", "csv_round_trip", "parquet_round_trip", "upserted_customers",
    "sync_fidelity", "cascaded_delete", "rule_violations", "audit_table_counts", "audit_stream_counts",
    "most_similar_vectors",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("sitetable-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-"))
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    for name in ("page_types", "account_elements", "steps_until_failure"):  # start workers, warm up the JVM
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
