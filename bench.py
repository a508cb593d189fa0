"""Time the headline queries: BENCH_SF_DIR (tables), BENCH_CPUS (cores), BENCH_RUNS (warm runs each).

Prints one JSON line. Every time is the median of the warm runs of the whole query, from reading
the parquet files to the last row handed to a sink that discards it.
"""

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "few_shot_eval", "zero_shot_eval", "simpleshot_eval", "knn_vote", "retrieval_metrics", "contrastive_eval",
    "kmeans_fixed_init", "semi_kmeans", "cluster_accuracy", "class_centroids", "prompt_expand", "text_types",
    "encode_corpus", "canonicalize_text", "reduce_random", "kshot_split", "exact_fraction", "epoch_shuffle", "row_index",
    "weighted_resample", "replay_pairing", "group_samples", "scan_tar_shards", "training_mix", "average_meter_windowed",
)


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from speciframe import catalog
    from speciframe.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.load()[0]
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        seen = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            seen.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seen[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries, warm median", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf,
    }))


if __name__ == "__main__":
    main()
