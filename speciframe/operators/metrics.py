"""Scores over predictions and metric logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topk_accuracy(ranked: DataFrame, ks: Sequence[int], n_better: str = "n_better", by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose true class is among the first k, a column per k."""
    hit = lambda k: F.avg(F.when(F.col(n_better) < k, 1.0).otherwise(0.0))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), *[hit(k).alias(f"top{k}") for k in ks])


def accuracy_ks(n_classes: int) -> list[int]:
    """1, 3 and 5, each at most the number of classes."""
    return sorted({1, min(n_classes, 3), min(n_classes, 5)})


def label_accuracy(df: DataFrame, pred: str, true: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of equal labels; over all rows at once this is the micro accuracy."""
    same = F.when(F.col(pred) == F.col(true), 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(same).alias("accuracy"))


def exact_match(df: DataFrame, pred: str, true: str) -> DataFrame:
    """Multi-label rows count only when every label is right."""
    return label_accuracy(df, pred, true)


def macro_f1(df: DataFrame, pred: str, true: str, label_ids: Sequence[int] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """F1 per label, averaged; a label without any positive scores 0. All labels by default."""
    rows = df.select(*by, F.posexplode(F.arrays_zip(F.col(pred).alias("p"), F.col(true).alias("t"))).alias("label_id", "v"))
    if label_ids is not None:
        rows = rows.filter(F.col("label_id").isin(list(label_ids)))
    p, t = F.col("v.p"), F.col("v.t")
    per_label = rows.groupBy(*by, "label_id").agg(
        F.sum(p * t).alias("tp"), F.sum(p * (1 - t)).alias("fp"), F.sum((1 - p) * t).alias("fn")
    )
    total = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(total > 0, 2 * F.col("tp") / total).otherwise(0.0)
    return per_label.groupBy(*by).agg(F.count("*").alias("n_labels"), F.avg(f1).alias("macro_f1"))


def fold_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation over folds or runs."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_folds"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )


def run_summary(scores: DataFrame, value: str) -> DataFrame:
    """Scores of the runs with their mean and population deviation beside them."""
    total = fold_summary(scores.withColumn("_k", F.lit(0)), value, ["_k"]).select("_k", "mean", "std")
    return scores.withColumn("_k", F.lit(0)).join(total, "_k").drop("_k")


def average_meter(df: DataFrame, value: str, weight: str, by: Sequence[str]) -> DataFrame:
    """Weighted mean, total and weight of each metric."""
    total, n = F.sum(F.col(value) * F.col(weight)), F.sum(weight)
    return df.groupBy(*by).agg(total.alias("total"), n.alias("weight"), (total / n).alias("avg"))


def average_meter_windowed(df: DataFrame, value: str, weight: str, step: str, every: int, by: Sequence[str]) -> DataFrame:
    """The meter reset at each log window of ``every`` steps."""
    return average_meter(df.withColumn("window_no", F.floor(F.col(step) / every)), value, weight, [*by, "window_no"])


def throughput(df: DataFrame, samples: str, seconds: str, workers: int, by: Sequence[str]) -> DataFrame:
    """Samples per second, overall and per worker."""
    n, t = F.sum(samples), F.sum(seconds)
    return df.groupBy(*by).agg(
        n.alias("samples"), (n / t).alias("per_second"), (n / t / workers).alias("per_second_per_worker")
    )


def count_samples(df: DataFrame, batch: str, left: str, right: str) -> DataFrame:
    """Samples and batches, and the batches whose two sides differ in number."""
    sides = df.groupBy(batch).agg(
        F.count("*").alias("n"), F.count(left).alias("n_left"), F.count(right).alias("n_right")
    )
    return sides.agg(
        F.sum("n").alias("n_samples"),
        F.count("*").alias("n_batches"),
        F.count_if(F.col("n_left") != F.col("n_right")).alias("n_unequal"),
    )


def contingency(df: DataFrame, pred: str, true: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (predicted, true) pair."""
    return df.groupBy(*by, pred, true).agg(F.count("*").alias("n"))


def cluster_purity(df: DataFrame, pred: str, true: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows that carry the majority label of their cluster."""
    largest = contingency(df, pred, true, by).groupBy(*by, pred).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return largest.groupBy(*by).agg((F.sum("top") / F.sum("n")).alias("purity"), F.sum("n").alias("n"))
