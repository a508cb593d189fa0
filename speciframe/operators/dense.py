"""Arrow batches to numpy blocks and back, for work inside Spark tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Cells of one score block (rows x prototypes) held at a time by a task.
BLOCK_CELLS = 1 << 21
# Scores are compared after rounding to this many digits, so that equal vectors tie whatever
# block they were multiplied in; ties go to the smaller label.
SCORE_DIGITS = 9
# Prototypes of a score block, neighbours that are found by a product first, and pairs worked out again at a time.
WIDE = 4096
FEW = 64
_PAIRS = 1 << 16


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1)


def vectors(values: np.ndarray) -> pa.Array:
    """A matrix as a list<double> column."""
    n, d = values.shape
    offsets = np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).reshape(-1)))


def unit_rows(x: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(length, 1e-12)[:, None]


def centred(x: np.ndarray, mean) -> np.ndarray:
    return x if mean is None else unit_rows(x - mean)


def closeness(x: np.ndarray, w: np.ndarray, metric: str) -> np.ndarray:
    """Larger is better: dot product, or negative squared distance. Distances are sums of squared
    differences, one coordinate at a time: the expanded product loses them far from the origin."""
    if metric != "l2":
        return np.round(x @ w.T, SCORE_DIGITS)
    s = np.zeros((len(x), len(w)))
    for j in range(x.shape[1]):
        gap = np.subtract.outer(x[:, j], w[:, j])
        gap *= gap
        s -= gap
    return np.round(s, SCORE_DIGITS)


def own_closeness(x: np.ndarray, w: np.ndarray, metric: str) -> np.ndarray:
    """Closeness of each row to its own partner."""
    if metric != "l2":
        return np.round(np.einsum("ij,ij->i", x, w), SCORE_DIGITS)
    s = np.zeros(len(x))
    for j in range(x.shape[1]):
        gap = x[:, j] - w[:, j]
        s -= gap * gap
    return np.round(s, SCORE_DIGITS)


def best_hits(x, labels, w, k, metric, own=None, truth=None):
    """The ``k`` best labels and scores per row, and, given the score of the true label, how many
    labels rank before it. ``labels`` ascend, so the first of equal scores is the smaller label.

    Works through blocks of rows and prototypes; memory stays at ``BLOCK_CELLS`` scores.
    """
    n, c = len(x), len(labels)
    k = min(k, c)
    plain = np.isfinite(x).all() and np.isfinite(w).all()
    if plain and metric == "l2" and own is None and 0 < k <= FEW and c > WIDE:
        return (*_nearest(x, labels, w, k), np.zeros(n, dtype=np.int64))
    top_l = np.zeros((n, k), dtype=np.int64)
    top_s = np.zeros((n, k))
    better = np.zeros(n, dtype=np.int64)
    wide = min(max(c, 1), WIDE)
    tall = max(1, BLOCK_CELLS // (wide + k))
    for r in range(0, n, tall):
        rows = slice(r, min(r + tall, n))
        have_l = np.zeros((rows.stop - r, 0), dtype=np.int64)
        have_s = np.zeros((rows.stop - r, 0))
        for start in range(0, c, wide):
            names = labels[start : start + wide]
            if k == 0 and own is not None and plain and metric != "l2":
                better[rows] += _ahead(x[rows] @ w[start : start + wide].T, own[rows], truth[rows], names)
                continue
            s = closeness(x[rows], w[start : start + wide], metric)
            if own is not None:
                t, y = own[rows, None], truth[rows, None]
                ahead = (s > t) | ((s == t) & (names[None, :] < y))
                better[rows] += (ahead & (names[None, :] != y)).sum(axis=1)
            all_s = np.concatenate([have_s, s], axis=1)
            all_l = np.concatenate([have_l, np.broadcast_to(names, s.shape)], axis=1)
            take = min(k, all_s.shape[1])
            have_s, have_l = _leaders(all_s, all_l, take)
        top_s[rows], top_l[rows] = have_s, have_l
    return top_l, top_s, better


def _ahead(s, own, truth, names):
    """How many columns rank before the own one, as on rounded scores: only those about as good are rounded."""
    own_column = np.minimum(np.searchsorted(names, truth), len(names) - 1)
    if not np.isfinite(own).all() or (names[1:] == names[:-1]).any():
        s, t, y = np.round(s, SCORE_DIGITS), own[:, None], truth[:, None]
        return (((s > t) | ((s == t) & (names[None, :] < y))) & (names[None, :] != y)).sum(axis=1)
    slack = 2 * 10.0**-SCORE_DIGITS + 1e-14 * np.abs(own)
    above = s > (own + slack)[:, None]
    count = np.count_nonzero(above, axis=1)
    count -= above[np.arange(len(s)), own_column] & (names[own_column] == truth)
    near = s >= (own - slack)[:, None]
    near ^= above
    i, j = np.divmod(np.flatnonzero(near), len(names))
    close = np.round(s[i, j], SCORE_DIGITS)
    counts = ((close > own[i]) | ((close == own[i]) & (names[j] < truth[i]))) & (names[j] != truth[i])
    return count + np.bincount(i[counts], minlength=len(s))


def _nearest(x, labels, w, k):
    """The ``k`` nearest labels and their scores, those of ``closeness``. A product gives all distances up to a known
    error; the pairs that may be among the nearest by it are worked out coordinate by coordinate."""
    n, c = len(x), len(labels)
    centre = w.mean(axis=0)
    top_l, top_s = np.empty((n, k), dtype=np.int64), np.empty((n, k))
    w_near = w - centre
    w_square = np.einsum("ij,ij->i", w_near, w_near)
    error = 8 * (w.shape[1] + 8) * np.finfo(float).eps
    tall = max(1, BLOCK_CELLS // WIDE)
    for r in range(0, n, tall):
        part = x[r : r + tall]
        x_near = part - centre
        x_square = np.einsum("ij,ij->i", x_near, x_near)
        slack = 2 * 10.0**-SCORE_DIGITS + error * (np.sqrt(x_square) + np.sqrt(w_square.max())) ** 2
        x_near *= -2
        row, score, at = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        limit = np.full(len(part), np.inf)
        for start in range(0, c, WIDE):
            far = x_near @ w_near[start : start + WIDE].T
            far += w_square[start : start + WIDE]
            wide = far.shape[1]
            near = far <= limit[:, None]
            if np.count_nonzero(near) > 8 * k * len(part) and wide >= k:
                kth = np.partition(far, k - 1, axis=1)[:, k - 1]
                near = far <= np.minimum(limit, kth + 2 * slack)[:, None]
            many = np.flatnonzero(np.count_nonzero(near, axis=1) > max(wide // 16, k))
            if len(many):
                # copies and near ties: all pairs of these rows, of which the best k go on
                every = closeness(part[many], w[start : start + WIDE], "l2")
                best = _leaders(every, np.broadcast_to(np.arange(wide), every.shape), k)[1]
                near[many] = False
                near[many[:, None], best] = True
            found = np.flatnonzero(near)
            if not len(found):
                continue
            for some in np.array_split(found, -(-len(found) // _PAIRS)):
                i, j = np.divmod(some, wide)
                j += start
                row, at = np.concatenate([row, i]), np.concatenate([at, j])
                score = np.concatenate([score, own_closeness(part[i], w[j], "l2")])
                order = np.lexsort((at, -score, row))
                row, score, at = row[order], score[order], at[order]
                first = np.searchsorted(row, np.arange(len(part)))
                kept = np.arange(len(row)) - first[row] < k
                row, score, at = row[kept], score[kept], at[kept]
            full = np.bincount(row, minlength=len(part)) == k
            last = np.cumsum(np.bincount(row, minlength=len(part))) - 1
            limit[full] = (-score[last[full]] - x_square[full]) + slack[full]
        top_l[r : r + tall], top_s[r : r + tall] = labels[at].reshape(-1, k), score.reshape(-1, k)
    return top_l, top_s


def _leaders(scores, names, k):
    """First k columns in (score descending, position ascending) order; k passes of arg-max."""
    if k <= 8:
        scores = scores.copy()
        at = np.arange(len(scores))
        out_s = np.empty((len(scores), k))
        out_l = np.empty((len(scores), k), dtype=np.int64)
        for i in range(k):
            best = scores.argmax(axis=1)
            out_s[:, i], out_l[:, i] = scores[at, best], names[at, best]
            scores[at, best] = -np.inf
        return out_s, out_l
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)


def row_groups(batch: pa.RecordBatch | pa.Table, keys: list[str]):
    """(key tuple, row numbers) for each distinct key in the batch."""
    if not keys:
        yield (), np.arange(batch.num_rows)
        return
    frame = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    for key, rows in frame.select(keys).to_pandas().groupby(keys, sort=False).indices.items():
        yield (key if isinstance(key, tuple) else (key,)), rows


def group_totals(batch: pa.RecordBatch, keys: list[str], x: np.ndarray):
    """(key tuple, number of rows, sum of their vectors) for each distinct key in the batch; rows with a
    null key are left out."""
    if not keys:
        yield (), len(x), x.sum(axis=0)
        return
    frame = batch.select(keys).to_pandas()
    codes = frame.groupby(keys, sort=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")[int((codes < 0).sum()) :]
    if not len(order):
        return
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    totals = np.add.reduceat(x[order], starts, axis=0)
    names = frame.iloc[order[starts]].itertuples(index=False, name=None)
    yield from zip(names, np.diff(starts, append=len(order)).tolist(), totals)
