"""Times the headline queries and prints one JSON line. Input: $BENCH_SF_DIR; cores: $BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: The published groups: collect, reduce, find, any iterator, mutable, composition; then what has no published number.
HEADLINE = [
    "filter_collect", "filter_map_collect", "flat_map_collect", "map_filter_collect", "map_collect", "drain_taken",
    "reduce_add", "reduce_xor", "sum_filtered", "count_filter", "count_flat_map", "find_ordered", "iterator_source",
    "mut_update", "long_chain_collect", "long_chain_reduce", "chain_collect", "take_while_collect", "take_while_sum",
    "result_sum", "result_collect_ok", "rec_sum", "enumerate_large",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from weirflow.queries import QUERIES

    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(3):  # the first run compiles
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        took[name] = round(best, 4)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
