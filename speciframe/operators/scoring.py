"""Samples against prototypes: best classes, rank of the true class.

Prototypes within ``SHIP_LIMIT_BYTES`` travel to the tasks once and every Arrow batch of samples
is one matrix product, without a shuffle. A larger prototype table is cut into blocks, and so
are the samples; cells of the grid are matched as co-groups and hand on only the best k per
sample, which are merged. Neither path emits sample x prototype rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import vectors as V
from ..session import SHIP_LIMIT_BYTES, cut_lineage
from .dense import best_hits, centred, matrix, own_closeness, row_groups, vectors

HITS = "array<struct<label:bigint,score:double>>"
# Rows per side of a grid cell; those of long vectors have fewer, down to 8,192. The vectors are sent once for every
# block of the other side, so larger cells mean fewer copies.
CELL_ROWS = 32768
CELL_NUMBERS = 1 << 21
# Rows of a prototype table that are read before its size is known: a few megabytes at most.
HEAD_ROWS = 1024


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _public_score(score: np.ndarray, metric: str, scale: float) -> np.ndarray:
    return np.sqrt(-score) if metric == "l2" else scale * score


def _hit_lists(labels: np.ndarray, scores: np.ndarray) -> pa.Array:
    n, k = labels.shape
    offsets = pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32) if k else np.zeros(n + 1, np.int32))
    entries = pa.StructArray.from_arrays(
        [pa.array(labels.reshape(-1), pa.int64()), pa.array(scores.reshape(-1), pa.float64())], ["label", "score"]
    )
    return pa.ListArray.from_arrays(offsets, entries)


def ship(protos: DataFrame, group: Sequence[str], label: str, vec: str, ship_limit: int = SHIP_LIMIT_BYTES) -> dict | None:
    """{group key: (labels ascending, matrix)} if the table is within the limit, else None.

    ``protos`` is read up to three times, so it should be a written table. A short table is known
    to be within the limit after reading its head; otherwise the numbers are counted first.
    """
    rows = protos.select(*group, F.col(label).cast("bigint").alias("_l"), F.col(vec).cast("array<double>").alias("_w"))
    collected = rows.limit(HEAD_ROWS + 1).toArrow() if ship_limit else None
    if collected is None or collected.num_rows > HEAD_ROWS:
        numbers = protos.agg(F.sum(F.size(vec))).first()[0] or 0
        if numbers * 8 > ship_limit:
            return None
        collected = rows.toArrow()
    if collected.num_rows == 0:
        return {}
    labels, weights = collected.column("_l").to_numpy(), matrix(collected.column("_w"))
    if weights.nbytes > ship_limit:
        return None
    shipped = {}
    for key, at in row_groups(collected, list(group)):
        at = at[np.argsort(labels[at], kind="stable")]
        shipped[key] = (labels[at], weights[at])
    return shipped


def collect_means(means: DataFrame, group: Sequence[str], vec: str = "mean") -> dict:
    """{group key: vector}. One vector per evaluation configuration, never per class."""
    return {tuple(r[g] for g in group): np.array(r[vec], dtype=np.float64) for r in means.select(*group, vec).collect()}


def centre_rows(rows: DataFrame, vec: str, group: Sequence[str], means: dict, out: str) -> DataFrame:
    """Rows with ``out``: the vector less the mean of its group, scaled to unit length."""
    named = rows.withColumnRenamed(vec, "_v") if vec != "_v" else rows
    return _centre_frame(named, list(group), means).withColumnRenamed("_v", out)


def match_prototypes(
    samples: DataFrame,
    protos: DataFrame | dict,
    *,
    vec: str,
    proto_vec: str,
    label: str,
    group: Sequence[str] = (),
    k: int = 1,
    metric: str = "dot",
    scale: float = 1.0,
    truth: str | None = None,
    keep: Sequence[str] = ("id",),
    means: dict | None = None,
    ship_limit: int = SHIP_LIMIT_BYTES,
    fixed: bool = False,
) -> DataFrame:
    """(keep..., group..., hits[, own_score, n_better]) for every sample.

    ``hits`` are the k best (label, score): dot product times ``scale``, or distance for
    ``metric='l2'``. ``protos`` may be prototypes already collected by ``ship``; ``fixed``
    tells that they are a written table already. With ``truth``, ``n_better`` labels rank before the true one (NULL if it has
    no prototype). A sample without a vector, or whose group has no prototype, has empty ``hits`` and
    NULL for the others. ``means`` centres and normalises the samples of a group first. ``keep`` must
    identify a sample within its group.
    """
    group, keep = list(group), list(keep)
    columns = list(dict.fromkeys([*keep, *group, *([truth] if truth else [])]))
    rows = samples.select(*columns, F.col(vec).cast("array<float>").alias("_v") if _type(samples, vec) == "array<float>"
                          else F.col(vec).cast("array<double>").alias("_v"))
    out_columns = list(dict.fromkeys([*keep, *group]))
    schema = ", ".join([f"`{c}` {_type(samples, c)}" for c in out_columns] + [f"hits {HITS}"])
    if truth:
        schema += ", own_score double, n_better bigint"
    shipped = protos if isinstance(protos, dict) else None
    if shipped is None:
        protos = protos.select(*group, F.col(label).cast("bigint").alias(label), proto_vec)
        protos = protos if fixed else cut_lineage(protos)
        shipped = ship(protos, group, label, proto_vec, ship_limit)
    if shipped is not None:
        run = _shipped_kernel(shipped, out_columns, group, k, metric, scale, truth, means)
        if sum(len(labels) for labels, _ in shipped.values()) > HEAD_ROWS:
            # much work for each row: a table of few files is dealt to all cores
            rows = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
        return rows.mapInArrow(run, schema)
    return _grid_match(rows, protos, proto_vec, label, group, k, metric, scale, truth, out_columns, means, schema)


def _shipped_kernel(shipped, columns, group, k, metric, scale, truth, means):
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            there = np.flatnonzero(batch.column("_v").is_valid().to_numpy(zero_copy_only=False))
            given = batch.take(pa.array(there)) if len(there) < batch.num_rows else batch
            x_all, left = matrix(given.column("_v")), np.ones(batch.num_rows, bool)
            for key, rows in row_groups(given, group):
                if key not in shipped or not len(rows):
                    continue
                left[there[rows]] = False
                labels, w = shipped[key]
                part = given.take(pa.array(rows)) if len(rows) < given.num_rows else given
                x = centred(x_all[rows], means[key] if means else None)
                own = y = at = None
                if truth:
                    y = part.column(truth).to_numpy(zero_copy_only=False).astype(np.int64)
                    at = np.minimum(np.searchsorted(labels, y), len(labels) - 1)
                    own = own_closeness(x, w[at], metric)
                top_l, top_s, better = best_hits(x, labels, w, k, metric, own, y)
                arrays = [part.column(c) for c in columns]
                arrays.append(_hit_lists(top_l, _public_score(top_s, metric, scale)))
                names = [*columns, "hits"]
                if truth:
                    known = labels[at] == y
                    arrays.append(pa.array(_public_score(own, metric, scale), pa.float64(), mask=~known))
                    arrays.append(pa.array(better, pa.int64(), mask=~known))
                    names += ["own_score", "n_better"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            if left.any():
                yield unmatched(batch.filter(pa.array(left)))

    def unmatched(part):
        arrays = [*[part.column(c) for c in columns], _hit_lists(np.zeros((part.num_rows, 0), np.int64), np.zeros((part.num_rows, 0)))]
        names = [*columns, "hits"]
        if truth:
            arrays += [pa.nulls(part.num_rows, pa.float64()), pa.nulls(part.num_rows, pa.int64())]
            names += ["own_score", "n_better"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _grid_match(rows, protos, proto_vec, label, group, k, metric, scale, truth, columns, means, schema):
    every = rows.select(*columns)
    rows = rows.filter(F.col("_v").isNotNull())
    if means:
        rows = _centre_frame(rows, group, means)
    if truth:
        own = protos.select(*group, F.col(label).alias(truth), F.col(proto_vec).alias("_own_w"))
        rows = rows.withColumn(truth, F.col(truth).cast("bigint")).join(own, [*group, truth], "left")
        rows = _own_scores(rows, metric)
    # The numbers of rows only steer how finely the grid is cut.
    n_rows, count = rows.count(), protos.count()
    length = (protos.select(F.max(F.size(F.col(proto_vec)))).first()[0] or 1) if count else 1
    side = min(CELL_ROWS, max(8192, CELL_NUMBERS // max(length, 1)))
    s_blocks, p_blocks = -(-n_rows // side) or 1, -(-count // side) or 1
    cores = rows.sparkSession.sparkContext.defaultParallelism
    s_blocks = max(s_blocks, min(-(-4 * cores // p_blocks), -(-n_rows // 1024)))
    zero = F.lit(0).cast("bigint")
    left = rows.select(
        "*",
        F.pmod(F.xxhash64(*columns), F.lit(s_blocks)).alias("_sb"),
        F.explode(F.sequence(zero, F.lit(p_blocks - 1).cast("bigint"))).alias("_pb"),
    )
    right = protos.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col(label).alias("_label"),
        (F.col(proto_vec) if _type(protos, proto_vec) == "array<float>" else F.col(proto_vec).cast("array<double>")).alias("_w"),
        F.pmod(F.xxhash64(label), F.lit(p_blocks)).alias("_pb"),
        F.explode(F.sequence(zero, F.lit(s_blocks - 1).cast("bigint"))).alias("_sb"),
    )
    left_keys = [*group, "_sb", "_pb"]
    right_keys = [*[f"_g_{g}" for g in group], "_sb", "_pb"]

    def cell(left_table: pa.Table, right_table: pa.Table) -> pa.Table:
        labels = right_table.column("_label").to_numpy() if right_table.num_rows else np.zeros(0, np.int64)
        names = [*columns, "hits"] + (["own_score", "n_better"] if truth else [])
        if left_table.num_rows == 0 or len(labels) == 0:
            return target.empty_table()
        order = np.argsort(labels, kind="stable")
        w = matrix(right_table.column("_w"))[order]
        x = matrix(left_table.column("_v"))
        own = y = None
        if truth:
            own = left_table.column("_own").to_numpy()
            y = left_table.column(truth).to_numpy()
        top_l, top_s, better = best_hits(x, labels[order], w, k, metric, own, y)
        arrays = [left_table.column(c).combine_chunks() for c in columns]
        arrays.append(_hit_lists(top_l, top_s))
        if truth:
            unknown = np.isnan(own.astype(np.float64))
            arrays.append(pa.array(own, pa.float64(), from_pandas=True))
            arrays.append(pa.array(better, pa.int64(), mask=unknown))
        return pa.Table.from_arrays(arrays, names=names).cast(target)

    target = to_arrow_schema(T._parse_datatype_string(schema))
    cells = left.groupBy(*left_keys).cogroup(right.groupBy(*right_keys)).applyInArrow(cell, schema)
    cells = cut_lineage(cells)
    flat = cells.select(*columns, F.inline("hits"))
    best = Window.partitionBy(*columns).orderBy(F.desc("score"), "label")
    ranked = flat.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k)
    shown = F.sqrt(-F.col("score")) if metric == "l2" else F.col("score") * scale
    packed = F.array_sort(F.collect_list(F.struct("_r", "label", shown.alias("score"))))
    lists = ranked.groupBy(*columns).agg(packed.alias("hits")).select(
        *columns, F.transform("hits", lambda h: F.struct(h["label"].alias("label"), h["score"].alias("score"))).alias("hits")
    )
    if truth:
        own_shown = F.sqrt(-F.max("own_score")) if metric == "l2" else F.max("own_score") * scale
        better = cells.groupBy(*columns).agg(own_shown.alias("own_score"), F.sum("n_better").alias("n_better"))
        lists = lists.join(better, columns) if k else better.withColumn("hits", F.array().cast(HITS))
    out = every.join(lists, columns, "left")
    return out.withColumn("hits", F.coalesce("hits", F.array().cast(HITS)))


def _own_scores(rows: DataFrame, metric: str) -> DataFrame:
    """``_own``: closeness of a sample to the prototype beside it, in the arithmetic of the kernel."""
    def run(batches):
        for batch in batches:
            known = batch.column("_own_w").is_valid().to_numpy(zero_copy_only=False)
            own = np.zeros(batch.num_rows)
            if known.any():
                part = batch.filter(pa.array(known))
                own[known] = own_closeness(matrix(part.column("_v")), matrix(part.column("_own_w")), metric)
            yield batch.drop_columns(["_own_w"]).append_column("_own", pa.array(own, pa.float64(), mask=~known))

    kept = [f for f in rows.schema if f.name != "_own_w"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", _own double"
    return rows.select(*[f.name for f in kept], F.col("_own_w").cast("array<double>").alias("_own_w")).mapInArrow(run, schema)


def _centre_frame(rows: DataFrame, group: list[str], means: dict) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column("_v"))
            for key, at in row_groups(batch, group):
                part = batch.take(pa.array(at))
                place = batch.schema.get_field_index("_v")
                yield part.set_column(place, "_v", vectors(centred(x[at], means[key])))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_v") + ", _v array<double>"
    return rows.select(*[c for c in rows.columns if c != "_v"], "_v").mapInArrow(run, schema)


def topk_classes(samples: DataFrame, protos: DataFrame, k: int, **how) -> DataFrame:
    """The k best classes per sample, one row each, ranked from 1."""
    keep = list(how.get("keep", ("id",)))
    matched = match_prototypes(samples, protos, k=k, **how)
    return matched.select(*keep, F.posexplode("hits").alias("rank", "hit")).select(
        *keep, (F.col("rank") + 1).alias("rank"), F.col("hit.label").alias("label"), F.col("hit.score").alias("score")
    )


def nearest_prototype(samples: DataFrame, protos: DataFrame, **how) -> DataFrame:
    """The best label per sample as ``pred``."""
    matched = match_prototypes(samples, protos, k=1, **how)
    extra = [c for c in matched.columns if c != "hits"]
    best = F.get("hits", 0)
    return matched.select(*extra, best["label"].alias("pred"), best["score"].alias("score"))
