"""Rank of the matching partner among all, in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running_sum
from .scoring import match_prototypes


def match_rank(pairs: DataFrame, query: str, target: str, key: str = "id", **how) -> DataFrame:
    """(id, n_better): how many targets score above the row's own one; ties go to smaller ids."""
    targets = pairs.select(F.col(key).alias("_target"), target)
    ranked = match_prototypes(
        pairs.withColumn("_own_id", F.col(key)),
        targets,
        vec=query,
        proto_vec=target,
        label="_target",
        truth="_own_id",
        keep=[key],
        **{"k": 0, **how},
    )
    return ranked.select(key, "n_better")


def retrieval_metrics(pairs: DataFrame, image: str, text: str, key: str = "id", **how) -> DataFrame:
    """Mean rank, floor(median) + 1 rank and recall at 1, 5, 10 for both directions."""
    forth = match_rank(pairs, image, text, key, **how).withColumn("direction", F.lit("image_to_text"))
    back = match_rank(pairs, text, image, key, **how).withColumn("direction", F.lit("text_to_image"))
    return rank_summary(forth.unionByName(back), "n_better", "direction")


def rank_summary(ranks: DataFrame, rank: str, by: str, ks=(1, 5, 10)) -> DataFrame:
    """(by, mean_rank, median_rank, r_at_k...) from 0-based ranks.

    The ranks are looked at once: everything follows from the number of rows per rank and their
    running sum, which also gives the exact median without bringing the ranks together.
    """
    counts = ranks.groupBy(by, rank).agg(F.count("*").alias("_n"))
    line = running_sum(counts, [by, rank], "_n", "_lo", "_hi")
    spans = line.groupBy(by).agg(F.min("_lo").alias("_start"), F.sum("_n").alias("_all"))
    placed = line.join(spans, by)
    low, high = F.col("_lo") - F.col("_start"), F.col("_hi") - F.col("_start")
    at = lambda place: F.max(F.when((low <= place) & (high > place), F.col(rank)))
    n = F.max("_all")
    median = (at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2
    within = lambda k: F.sum(F.when(F.col(rank) < k, F.col("_n")).otherwise(0)) / n
    return placed.groupBy(by).agg(
        (F.sum(F.col(rank) * F.col("_n")) / n + 1).alias("mean_rank"),
        (F.floor(median) + 1).cast("double").alias("median_rank"),
        *[within(k).alias(f"r_at_{k}") for k in ks],
    )
