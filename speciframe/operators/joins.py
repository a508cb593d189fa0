"""Relational pieces: alignment, membership, pairing, checks, unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_classes(df: DataFrame, classes: DataFrame, cls: str) -> DataFrame:
    """Rows whose class is listed."""
    return df.join(classes.select(cls), cls, "left_semi")


def unlabelled(everything: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """Rows that are not among the labelled ones."""
    return everything.join(labelled.select(key), key, "left_anti")


def zip_lines(left: DataFrame, right: DataFrame, line: str = "line_no") -> DataFrame:
    """Two line-numbered texts side by side."""
    return left.join(right, line)


def merge_flagged(labelled: DataFrame, unlabelled_rows: DataFrame) -> DataFrame:
    """Both sets with a 0/1 flag telling the labelled ones."""
    return labelled.withColumn("is_labelled", F.lit(1)).unionByName(
        unlabelled_rows.withColumn("is_labelled", F.lit(0))
    )


def except_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def label_consistency(features: DataFrame, samples: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Rows compared and rows whose two labels differ."""
    differs = ~F.col(left).eqNullSafe(F.col(right))
    return features.join(samples, key).agg(
        F.count("*").alias("n_rows"), F.count_if(differs).alias("n_mismatch")
    )


def replay_pairing(main: DataFrame, replay: DataFrame, batch: str = "batch_no") -> DataFrame:
    """Main batch i followed by replay batch i mod m; replay starts over when it is used up.

    Each replay row is repeated for the main batches it serves, which is the size of the result
    anyway, so nothing is joined.
    """
    n = main.agg(F.max(batch)).first()[0]
    m = replay.agg(F.max(batch)).first()[0]
    if n is None or m is None:
        return main.withColumn("segment", F.lit("main"))
    own = F.col(batch).cast("bigint")
    last = F.lit(int(n)).cast("bigint")
    serves = F.when(own <= last, F.sequence(own, last, F.lit(int(m) + 1).cast("bigint")))
    again = replay.withColumn(batch, F.explode(serves))
    return main.withColumn(batch, own).withColumn("segment", F.lit("main")).unionByName(
        again.withColumn("segment", F.lit("replay"))
    )


def old_new_mask(df: DataFrame, class_idx: str, n_train_classes: int) -> DataFrame:
    """Whether the class was among the training classes."""
    return df.withColumn("is_old", F.col(class_idx) < n_train_classes)


def epoch_gate(df: DataFrame, epoch: str, every: int, last: int) -> DataFrame:
    """Epochs due for evaluation: each n-th and the last; none for ``every = 0``."""
    if every == 0:
        return df.filter(F.lit(False))
    return df.filter((F.pmod(F.col(epoch), F.lit(every)) == 0) | (F.col(epoch) == last))
