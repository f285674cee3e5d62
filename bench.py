"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

QUERIES = [
    "scan_files", "extract_symbols", "occurrence_counts", "name_index", "resolve_tiers", "file_edges", "enclosing_symbols", "references_to", "near_names", "ranked_map", "pagerank_trade", "partition_score",
    "merged_slices", "packed_turns", "vote_clusters", "index_plan", "equal_contents", "equal_bodies", "generation_stamp",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from codeloom.plans import registry

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * cpus)).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took = registry.queries(), {}
    known["scan_files"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the session
    for name in QUERIES:
        began = time.time()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
