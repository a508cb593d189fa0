"""Means of vector columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dense import group_totals, matrix, vectors

# Partial sums a task keeps (numbers, not groups) before it hands them on.
PARTIAL_NUMBERS = 1 << 22
# Shares of the tasks whose partial sums of a group are added apart at first.
SHARES = 64


def _schema_of(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


class PartialSums:
    """Counts and vector sums by key inside one task, handed on when they grow too many."""

    def __init__(self, names: Sequence[str]):
        self.names, self.held, self.types, self.width = list(names), {}, None, 0

    def add(self, key: tuple, x: np.ndarray) -> None:
        self.put(key, len(x), x.sum(axis=0))

    def put(self, key: tuple, n: int, total: np.ndarray) -> None:
        self.width = len(total)
        if key in self.held:
            self.held[key][0] += n
            self.held[key][1] += total
        else:
            self.held[key] = [n, total.copy()]

    def full(self) -> bool:
        return len(self.held) * self.width > PARTIAL_NUMBERS

    def flush(self):
        if not self.held:
            return
        keys = list(self.held)
        columns = [pa.array([k[i] for k in keys], type=t) for i, t in enumerate(self.types)]
        counts = pa.array([self.held[k][0] for k in keys], pa.int64())
        sums = vectors(np.stack([self.held[k][1] for k in keys]))
        self.held = {}
        yield pa.RecordBatch.from_arrays([*columns, counts, sums], names=[*self.names, "_n", "_s"])


def _sum_kernel(by: list[str], vec: str):
    def run(batches):
        sums = PartialSums(by)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sums.types = [batch.schema.field(c).type for c in by]
            x = matrix(batch.column(vec))
            for key, n, total in group_totals(batch, by, x):
                sums.put(key, n, total)
            if sums.full():
                yield from sums.flush()
        yield from sums.flush()

    return run


def merge_partials(partial: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n, total) from partial rows, at most a few per group and task. Whole vectors are added,
    first by (group, share of the tasks), then by group, so a group in every task is still spread."""
    spread = partial.select(*by, (F.spark_partition_id() % SHARES).alias("_share"), "_n", "_s")
    for keys in ([*by, "_share"], list(by)):
        spread = spread.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.collect_list("_s").alias("_s")).withColumn("_s", _added("_s"))
    # Without keys an empty table still gives a row, of which nothing was added.
    return spread.filter("_n IS NOT NULL").select(*by, F.col("_n").alias("n"), F.col("_s").alias("total"))


def _added(vectors) -> Column:
    """Element-wise sum of an array of vectors."""
    rest = F.slice(vectors, 2, F.greatest(F.size(vectors), F.lit(1)))
    return F.aggregate(rest, F.get(vectors, F.lit(0)), lambda total, v: F.zip_with(total, v, lambda a, b: a + b))


def vector_sums(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, total) with the element-wise sum of a vector column.

    Every task adds up its rows before anything is shuffled; what travels is one vector per group
    and task, so no group sits in one task.
    """
    by = list(by)
    rows = df.select(*by, F.col(vec).cast("array<double>").alias(vec)).filter(F.col(vec).isNotNull())
    return merge_partials(rows.mapInArrow(_sum_kernel(by, vec), _schema_of(df, by) + "_n bigint, _s array<double>"), by)


def vector_mean(df: DataFrame, vec: str, by: Sequence[str] = (), out: str = "mean") -> DataFrame:
    """(by..., n, mean): the global mean without ``by``, class centroids with the class."""
    sums = vector_sums(df, vec, by)
    return sums.select(*by, "n", F.transform("total", lambda x: x / F.col("n")).alias(out))


def class_centroids(df: DataFrame, vec: str, cls: str, out: str = "centroid") -> DataFrame:
    return vector_mean(df, vec, [cls], out)
