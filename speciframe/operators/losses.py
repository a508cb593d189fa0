"""In-batch image-text scores: every row of a batch against every other, without the pairs.

A batch is cut into blocks of rows. One task multiplies one image block with one text block and
hands on, per row and per column, only the pieces of a log-sum-exp. A batch of any size is
therefore spread over many tasks, and what is shuffled after the products is one small record
per row and block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dense import BLOCK_CELLS, matrix

CELL_ROWS = 4096
_NUMBERS = ("m", "s", "own", "pos", "neg", "tm", "ts", "tx")


def _summarise(logits, teacher, row_ids, col_ids):
    """Pieces per row of a block of logits."""
    m = logits.max(axis=1)
    out = {"m": m, "s": np.exp(logits - m[:, None]).sum(axis=1)}
    order = np.argsort(col_ids, kind="stable")
    at = order[np.minimum(np.searchsorted(col_ids[order], row_ids), len(order) - 1)]
    here = col_ids[at] == row_ids
    rows = np.arange(len(row_ids))
    own = logits[rows, at]
    out["own"] = np.where(here, own, np.nan)
    soft = np.logaddexp(0.0, logits).sum(axis=1)
    out["neg"] = np.where(here, soft - np.logaddexp(0.0, own), soft)
    out["pos"] = np.where(here, np.logaddexp(0.0, -own), 0.0)
    if teacher is not None:
        tm = teacher.max(axis=1)
        weight = np.exp(teacher - tm[:, None])
        out.update(tm=tm, ts=weight.sum(axis=1), tx=(weight * logits).sum(axis=1))
    return out


def in_batch_rows(
    pairs: DataFrame,
    *,
    batch: Sequence[str],
    key: str = "id",
    image: str = "image",
    text: str = "text",
    scale: float = 100.0,
    bias: float = 0.0,
    teacher: tuple[str, str, float] | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(batch..., side, id, own, top, lse, pos_loss, neg_loss[, cross_entropy]) per row and side.

    ``side`` is ``image`` (one image against the texts of its batch) or ``text``. ``own`` is the
    logit of the matching pair, ``top`` the largest, ``lse`` the log-sum-exp. With ``teacher``
    (image column, text column, scale) there is also the cross-entropy between the two softmaxes.
    """
    batch = list(batch)
    vec = {"_im": image, "_tx": text}
    if teacher:
        vec.update({"_tim": teacher[0], "_ttx": teacher[1]})
    # Sizes are counted per batch; a hot batch gets more blocks, not a bigger task.
    sizes = pairs.groupBy(*batch).agg(F.ceil(F.count("*") / F.lit(cell_rows)).alias("_nb"))
    rows = pairs.select(*batch, F.col(key).alias("_id"), *[F.col(c).alias(a) for a, c in vec.items()]).join(sizes, batch)
    home = F.pmod(F.xxhash64("_id"), F.col("_nb")).cast("int")
    each = F.explode(F.sequence(F.lit(0), (F.col("_nb") - 1).cast("int")))
    left = rows.select(*batch, home.alias("_ib"), each.alias("_tb"), "_id", *[c for c in vec if c in ("_im", "_tim")])
    right = rows.select(
        *[F.col(b).alias(f"_r_{b}") for b in batch], each.alias("_ib"), home.alias("_tb"), F.col("_id").alias("_rid"),
        *[c for c in vec if c in ("_tx", "_ttx")],
    )
    id_type = pairs.schema[key].dataType.simpleString()
    by = ", ".join(f"`{b}` {pairs.schema[b].dataType.simpleString()}" for b in batch)
    schema = f"{by}, side string, `_id` {id_type}, " + ", ".join(f"{n} double" for n in _NUMBERS)
    teacher_scale = float(teacher[2]) if teacher else 0.0

    def cell(cell_key, images: pa.Table, texts: pa.Table) -> pa.Table:
        pieces = []
        if images.num_rows and texts.num_rows:
            i_ids = images.column("_id").to_numpy()
            t_ids = texts.column("_rid").to_numpy()
            x, y = matrix(images.column("_im")), matrix(texts.column("_tx"))
            p, q = (matrix(images.column("_tim")), matrix(texts.column("_ttx"))) if teacher else (None, None)
            tall = max(1, BLOCK_CELLS // max(len(t_ids), 1))
            for r in range(0, len(i_ids), tall):
                part = slice(r, r + tall)
                logits = scale * (x[part] @ y.T) + bias
                t_logits = teacher_scale * (p[part] @ q.T) if teacher else None
                pieces.append(("image", i_ids[part], _summarise(logits, t_logits, i_ids[part], t_ids)))
                pieces.append(
                    ("text", t_ids, _summarise(logits.T, None if t_logits is None else t_logits.T, t_ids, i_ids[part]))
                )
        tables = []
        for side, ids, numbers in pieces:
            n = len(ids)
            arrays = [pa.array([k.as_py()] * n, k.type) for k in cell_key[: len(batch)]]
            arrays += [pa.array([side] * n, pa.string()), pa.array(ids)]
            arrays += [
                pa.array(numbers[c], pa.float64(), from_pandas=True) if c in numbers else pa.nulls(n, pa.float64())
                for c in _NUMBERS
            ]
            tables.append(pa.Table.from_arrays(arrays, names=[*batch, "side", "_id", *_NUMBERS]))
        if tables:
            return pa.concat_tables(tables)
        empty = [pa.nulls(0, k.type) for k in cell_key[: len(batch)]]
        empty += [pa.nulls(0, pa.string()), pa.nulls(0, images.column("_id").type)]
        return pa.Table.from_arrays(
            empty + [pa.nulls(0, pa.float64()) for _ in _NUMBERS], names=[*batch, "side", "_id", *_NUMBERS]
        )

    cells = (
        left.groupBy(*batch, "_ib", "_tb")
        .cogroup(right.groupBy(*[f"_r_{b}" for b in batch], "_ib", "_tb"))
        .applyInArrow(cell, schema)
    )
    line = Window.partitionBy(*batch, "side", "_id")
    levelled = cells.withColumn("_top", F.max("m").over(line)).withColumn("_tt", F.max("tm").over(line))
    shift, t_shift = F.exp(F.col("m") - F.col("_top")), F.exp(F.col("tm") - F.col("_tt"))
    merged = levelled.groupBy(*batch, "side", "_id").agg(
        F.max("own").alias("own"),
        F.max("_top").alias("top"),
        (F.max("_top") + F.log(F.sum(F.col("s") * shift))).alias("lse"),
        F.sum("pos").alias("pos_loss"),
        F.sum("neg").alias("neg_loss"),
        (F.sum(F.col("tx") * t_shift) / F.sum(F.col("ts") * t_shift)).alias("_expected"),
    )
    out = merged.withColumnRenamed("_id", key)
    if teacher:
        return out.withColumn("cross_entropy", F.col("lse") - F.col("_expected")).drop("_expected")
    return out.drop("_expected")


def contrastive_by_batch(rows: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Loss and accuracy of each batch. A tie at the largest logit counts as correct."""
    image = F.col("side") == "image"
    loss = F.col("lse") - F.col("own")
    return rows.groupBy(*batch).agg(
        F.count_if(image).alias("batch_size"),
        ((F.avg(F.when(image, loss)) + F.avg(F.when(~image, loss))) / 2).alias("loss"),
        F.avg(F.when(image, (F.col("own") == F.col("top")).cast("double"))).alias("accuracy"),
    )


def contrastive_eval(rows: DataFrame, batch: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Batch losses and accuracies weighted by batch size."""
    n = F.sum("batch_size")
    return contrastive_by_batch(rows, batch).groupBy(*by).agg(
        n.alias("num_samples"),
        (F.sum(F.col("loss") * F.col("batch_size")) / n).alias("val_loss"),
        (F.sum(F.col("accuracy") * F.col("batch_size")) / n).alias("val_acc"),
    )


def sigmoid_pair_loss(rows: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Sum of -log sigmoid(+-logit) over all pairs of a batch, divided by its size."""
    images = rows.filter(F.col("side") == "image")
    return images.groupBy(*batch).agg(
        F.count("*").alias("batch_size"),
        (F.sum(F.col("pos_loss") + F.col("neg_loss")) / F.count("*")).alias("loss"),
    )


def distill_loss(rows: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Teacher-student cross-entropy of a batch, mean over both directions."""
    image = F.col("side") == "image"
    ce = F.col("cross_entropy")
    return rows.groupBy(*batch).agg(
        F.count_if(image).alias("batch_size"),
        ((F.avg(F.when(image, ce)) + F.avg(F.when(~image, ce))) / 2).alias("loss"),
    )
