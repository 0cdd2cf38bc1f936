"""Wall seconds of the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set data and cores."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from foliant.plans import registry

HEADLINE = (
    "c8_chapters", "d2_chunk_chapters", "d3_fixed_token_windows", "e3_pack_batches", "h3_build_index", "h4_search", "i13_resolve_aliases", "j5_task_status", "l1_retrieval_hits",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    spark.read.parquet(f"{sf}/documents.parquet").write.format("noop").mode("overwrite").save()  # start the executor's code paths
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
