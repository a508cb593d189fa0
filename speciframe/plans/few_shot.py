"""Nearest-centroid evaluation from a few examples per class."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import class_centroids, vector_mean
from ..operators.dense import best_hits, centred, matrix
from ..operators.metrics import fold_summary, label_accuracy
from ..operators.sampling import kshot_picks
from ..operators.scoring import centre_rows, collect_means, match_prototypes, nearest_prototype, ship
from ..session import SHIP_LIMIT_BYTES, cut_lineage

KSHOTS, FOLDS = (1, 5), 5


def _explode_ints(values: Sequence[int], name: str):
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)


def require_k(picks: DataFrame, features: DataFrame, cls: str, k: int) -> None:
    """Fail when a class has fewer than ``k`` rows."""
    have = picks.groupBy("fold", cls).agg(F.max("pick").alias("n")).agg(F.min("n")).first()[0]
    if have is not None and have < k:
        raise ValueError(f"a class has only {have} rows, fewer than the {k} needed")


def few_shot_accuracy(
    features: DataFrame, ks: Sequence[int] = KSHOTS, folds: int = FOLDS, key: str = "id", vec: str = "features",
    cls: str = "target", check: bool = True, ship_limit: int = SHIP_LIMIT_BYTES,
) -> DataFrame:
    """(k, fold, n, accuracy) for all pairs of k and fold in one plan.

    Per fold, k rows per class in seeded order are the train rows. Their mean is subtracted from
    train and test rows, which are then scaled to unit length; the nearest class centroid wins.
    Only the picks (at most max(k) rows per class and fold) are shuffled; the test pass reads the
    features once for all pairs and hands on counts.
    """
    ks, fold_ids = list(ks), list(range(folds))
    picks = cut_lineage(kshot_picks(features.select(key, cls), max(ks), fold_ids, cls, key))
    if check:
        require_k(picks, features, cls, max(ks))
    chosen = picks.join(features.select(key, vec), key)
    train = chosen.select("*", _explode_ints(ks, "k")).filter("pick <= k")
    # One mean per (k, fold): a fixed handful of vectors.
    shipped = collect_means(vector_mean(train, vec, ["k", "fold"]), ["k", "fold"])
    centred = centre_rows(train.select("k", "fold", cls, vec), vec, ["k", "fold"], shipped, "_x")
    centroids = class_centroids_by(centred, ["k", "fold"], cls)
    centroids = cut_lineage(centroids.select("k", "fold", F.col(cls).cast("bigint").alias(cls), "centroid"))
    # At which pick each fold uses a row for training; 0 where it does not.
    used = picks.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("fold", "pick"))).alias("_used"))
    place = F.transform(F.lit(fold_ids), lambda f: F.coalesce(F.try_element_at("_used", f), F.lit(0)))
    rows = features.select(key, vec, cls).join(used, key, "left").withColumn("_picks", place).drop("_used")
    prototypes = ship(centroids, ["k", "fold"], cls, "centroid", ship_limit)
    if prototypes is None:
        return _by_configuration(rows, centroids, ks, fold_ids, shipped, key, vec, cls, ship_limit)
    kernel = _count_hits(ks, fold_ids, shipped, prototypes)
    counts = rows.select(F.col(vec).alias("_v"), F.col(cls).cast("bigint").alias("_y"), "_picks").mapInArrow(
        kernel, "k int, fold int, n bigint, hits bigint"
    )
    return counts.groupBy("k", "fold").agg(
        F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy")
    )


def _count_hits(ks: list[int], folds: list[int], means: dict, prototypes: dict):
    """Test rows and right answers of each (k, fold), all in one pass over a task's rows."""
    def run(batches):
        counts = {(k, f): [0, 0] for k in ks for f in folds}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = matrix(batch.column("_v")), batch.column("_y").to_numpy()
            picks = matrix(batch.column("_picks"))
            for (k, fold), count in counts.items():
                pick = picks[:, folds.index(fold)]
                test = (pick == 0) | (pick > k)
                labels, w = prototypes[(k, fold)]
                top, _, _ = best_hits(centred(x[test], means[(k, fold)]), labels, w, 1, "l2")
                count[0] += int(test.sum())
                count[1] += int((top[:, 0] == y[test]).sum())
        if any(n for n, _ in counts.values()):
            table = [(k, f, n, hits) for (k, f), (n, hits) in counts.items()]
            columns = [pa.array(c, t) for c, t in zip(zip(*table), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "fold", "n", "hits"])

    return run


def _by_configuration(rows, centroids, ks, folds, means, key, vec, cls, ship_limit):
    """The same for centroid tables that cannot be shipped: a row per test row and (k, fold)."""
    test = (
        rows.select(key, vec, cls, F.posexplode("_picks").alias("fold", "_pick"))
        .select("*", _explode_ints(ks, "k"))
        .filter("_pick = 0 OR _pick > k")
    )
    predicted = nearest_prototype(
        test, centroids, vec=vec, proto_vec="centroid", label=cls, group=["k", "fold"], metric="l2",
        means=means, keep=[key, cls], fixed=True, ship_limit=ship_limit,
    )
    return label_accuracy(predicted, "pred", cls, ["k", "fold"])


def class_centroids_by(rows: DataFrame, by: Sequence[str], cls: str, vec: str = "_x") -> DataFrame:
    return vector_mean(rows, vec, [*by, cls], "centroid")


def few_shot_eval(features: DataFrame, **how) -> DataFrame:
    """(k, n_folds, mean, std) of the accuracy over folds."""
    return fold_summary(few_shot_accuracy(features, **how), "accuracy", ["k"])


def simpleshot_scores(train: DataFrame, test: DataFrame, key: str = "id", vec: str = "features", cls: str = "target") -> DataFrame:
    """(key, label, pred, score) of separate train and test tables; score is 1 for a hit."""
    shipped = collect_means(vector_mean(train, vec), [])
    centred = centre_rows(train.select(cls, vec), vec, [], shipped, "_x")
    centroids = class_centroids(centred, "_x", cls)
    predicted = nearest_prototype(
        test, centroids, vec=vec, proto_vec="centroid", label=cls, metric="l2", means=shipped, keep=[key, cls]
    )
    return predicted.select(key, cls, "pred", (F.col("pred") == F.col(cls)).cast("int").alias("hit"))


def simpleshot_repeats(
    train: DataFrame, test: DataFrame, k: int = 1, repeats: int = 5, key: str = "id", vec: str = "features", cls: str = "target"
) -> DataFrame:
    """(repeat, n, accuracy): each repeat draws at most k train rows per class anew."""
    ids = list(range(repeats))
    picks = cut_lineage(kshot_picks(train.select(key, cls), k, ids, cls, key))
    chosen = picks.join(train.select(key, vec), key)
    shipped = collect_means(vector_mean(chosen, vec, ["fold"]), ["fold"])
    centred = centre_rows(chosen.select("fold", cls, vec), vec, ["fold"], shipped, "_x")
    centroids = class_centroids_by(centred, ["fold"], cls)
    every = test.select(key, vec, cls, _explode_ints(ids, "fold"))
    predicted = nearest_prototype(
        every, centroids, vec=vec, proto_vec="centroid", label=cls, group=["fold"], metric="l2", means=shipped, keep=[key, cls]
    )
    return label_accuracy(predicted, "pred", cls, ["fold"]).withColumnRenamed("fold", "repeat")


def knn_vote(train: DataFrame, test: DataFrame, n: int = 1, key: str = "id", vec: str = "features", cls: str = "target") -> DataFrame:
    """(key, pred): most frequent class among the n nearest train rows."""
    # Train rows are the prototypes; their ids lead back to the classes.
    protos = train.select(F.col(key).alias("_train_id"), vec)
    near = match_prototypes(test, protos, vec=vec, proto_vec=vec, label="_train_id", k=n, metric="l2", keep=[key])
    voters = near.select(key, F.posexplode("hits").alias("_r", "_h")).select(key, F.col("_h.label").alias("_train_id"))
    votes = voters.join(train.select(F.col(key).alias("_train_id"), cls), "_train_id")
    counts = votes.groupBy(key, cls).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("c"), F.col(cls).alias("v")))["v"].alias("pred"))
