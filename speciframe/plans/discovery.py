"""Finding new classes among unlabelled rows with the help of labelled ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clustering import cluster_accuracy, label_runs, semi_kmeans_runs
from ..operators.joins import merge_flagged, unlabelled
from ..operators.metrics import run_summary
from ..operators.ranking import exact_fraction
from ..operators.sampling import relabel_priority
from ..session import cut_lineage


def discovery_sets(features: DataFrame, old_classes: Sequence, fraction: float, seed: int, key: str = "id", cls: str = "target") -> DataFrame:
    """All rows with ``is_labelled`` (an exact fraction of the rows of old classes), ``is_old`` and
    the class renumbered with the old classes first."""
    numbering = relabel_priority(features, cls, old_classes)
    old = F.col(cls).isin(list(old_classes))
    labelled = cut_lineage(exact_fraction(features.filter(old).select(key), fraction, seed, [key]))
    marked = merge_flagged(
        features.join(labelled, key, "left_semi"), unlabelled(features, labelled, key)
    )
    return marked.join(numbering, cls).withColumn("is_old", F.col("class_idx") < len(old_classes))


def discovery_runs(
    sets: DataFrame, k: int, seeds: Sequence[int], key: str = "id", vec: str = "features", max_iterations: int = 10, tolerance: float = 1e-4
) -> DataFrame:
    """(run, is_old, n_rows, n_right, accuracy) on the unlabelled rows; old and new ones are mapped apart."""
    points = sets.withColumn("_label", F.when(F.col("is_labelled") == 1, F.col("class_idx")))
    fitted = semi_kmeans_runs(points, vec, key, "_label", k, seeds, max_iterations, tolerance)
    free = sets.filter("is_labelled = 0").select(key, "class_idx", "is_old")
    return cluster_accuracy(free.join(label_runs(fitted), key), "cluster", "class_idx", ["run", "is_old"])


def category_discovery(
    features: DataFrame, old_classes: Sequence, fraction: float = 0.8, seeds: Sequence[int] = (0, 1, 2), key: str = "id",
    vec: str = "features", cls: str = "target", max_iterations: int = 10, tolerance: float = 1e-4,
) -> DataFrame:
    """(run, n_rows, accuracy, old_accuracy, new_accuracy, mean, std): a row per seed, with the mean and the
    population deviation of the accuracy over the seeds. A side without rows has no accuracy of its own."""
    sets = cut_lineage(discovery_sets(features, old_classes, fraction, 0, key, cls))
    k = sets.select("class_idx").distinct().count()
    parts = cut_lineage(discovery_runs(sets, k, seeds, key, vec, max_iterations, tolerance))
    side = lambda old: F.max(F.when(F.col("is_old") == old, F.col("accuracy")))
    scores = parts.groupBy("run").agg(
        F.sum("n_rows").alias("n_rows"), (F.sum("n_right") / F.sum("n_rows")).alias("accuracy"),
        side(True).alias("old_accuracy"), side(False).alias("new_accuracy"))
    return run_summary(scores, "accuracy")
