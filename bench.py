"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sievewright import build_session  # noqa: E402
from sievewright.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "check_completeness", "check_uniqueness", "check_range", "check_pattern", "check_referential", "check_custom",
    "check_all", "sample_violations", "profile_table", "gate", "incident", "create_ticket", "propose_rules",
    "top_values", "ewma_fold", "adapt_replay", "apply_rule_events", "embed", "similarity_query", "search",
    "chunked_table", "per_batch_metrics", "stream_check", "scan_csv", "lineage_edges", "parse_rule_suggestions",
    "run_batch",
]


def spread(spark, sf_dir: str, files: int) -> str:
    """The same tables in another folder, the texts in as many files as there are threads; the given file is one task."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            os.symlink(os.path.join(os.path.abspath(sf_dir), name), os.path.join(folder, name))
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(files).write.parquet(f"{folder}/documents.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    tables = spread(spark, sf_dir, int(cpus))
    times, again = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        for run in (times, again):  # the first call of a query also compiles its code
            start = time.perf_counter()
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            run[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "again": again, "again_total": round(sum(again.values()), 3),
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
