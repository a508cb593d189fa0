"""Throughput of the vector operators on the embeddings table repeated: python tools/scale_vectors.py [copies]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from speciframe.operators import aggregates, clustering, scoring  # noqa: E402
from speciframe.plans import few_shot, zero_shot  # noqa: E402
from speciframe.session import build_session, cut_lineage  # noqa: E402


def main():
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 100
    cpus = os.environ.get("CPUS", "8")
    spark = build_session("scale", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    base = spark.read.parquet(os.environ.get("SF", "/root/testdata/sf0.1") + "/embeddings.parquet")
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    rows = base.select("*", copy.alias("c")).select(
        (F.col("vec_id") * copies + F.col("c")).alias("id"), F.col("embedding").alias("features"), F.col("label").alias("target")
    )
    features = cut_lineage(rows.repartition(int(cpus) * 2))
    n = features.count()
    protos = cut_lineage(zero_shot.ensemble_prototypes(features, "target", "features").withColumnRenamed("target", "class_idx"))

    def timed(name, run):
        run()
        start = time.perf_counter()
        run()
        took = time.perf_counter() - start
        print(f"{name:28s} {took:7.2f} s  {n / took:12,.0f} vectors/s", flush=True)

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    how = dict(vec="features", proto_vec="w", label="class_idx", fixed=True)
    print(f"{n} vectors of 64 dimensions, {cpus} cores")
    timed("class centroids", lambda: noop(aggregates.class_centroids(features, "features", "target")))
    timed("nearest of 10 prototypes", lambda: noop(scoring.nearest_prototype(features, protos, **how)))
    timed("zero-shot accuracy", lambda: noop(zero_shot.zero_shot_eval(features, protos)))
    timed("few-shot, 10 configurations", lambda: noop(few_shot.few_shot_eval(features)))
    many = cut_lineage(features.limit(1000).select(F.col("id").alias("class_idx"), F.col("features").alias("w")))
    timed("nearest of 1000 prototypes", lambda: noop(scoring.nearest_prototype(features, many, **how)))
    start = cut_lineage(clustering.first_k(features, "features", "id", 100))
    timed("one k-means round, k = 100", lambda: clustering.lloyd(features, start, "features", "id", 1))


if __name__ == "__main__":
    main()
