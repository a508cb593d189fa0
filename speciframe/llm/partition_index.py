"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph; the graph is cut into partitions of equal size that keep
neighbours together, and a small network learns to tell from a vector alone in which partitions its
neighbours lie. Every row of the table then goes to its most probable partition, and a query is compared,
exactly, with all rows of as many of its most probable partitions as a measured recall asks for: the true
neighbours of a few hundred rows among all rows, found block by block, say how many that are.

Rows of a partition are dealt by hash into blocks that one task holds at a time while the queries stream
past, so a partition of any size, copies of one vector included, is many tasks. No pair leaves a task but the
best of a query in a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speciframe.session import cut_lineage

#: Rows that the partitions and their network are learned from, at most, and numbers in them.
SAMPLE = 16_384
SAMPLE_NUMBERS = 4 * 1024 * 1024
#: Rows per partition that are aimed at, and sample rows that each partition needs.
ROWS, SUPPORT = 1_024, 32
#: Neighbours of a sample row in the graph.
DEGREE = 12
#: Rows that the recall is measured with, and the recall that the number of partitions per query must reach there.
TRIALS, RECALL = 384, 0.96
#: Rows of a partition that a task holds at a time, and queries it compares with them at once.
BLOCK, QUERIES = 8_192, 256
_FOUND = "query_id bigint, vec_id bigint, score double"


def usable(vector: Column) -> Column:
    """Neither null nor empty nor all zero, and every component finite."""
    number = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(number, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(len(column), -1)


def neighbours(own: np.ndarray, all_rows: np.ndarray, skip: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` nearest among ``all_rows`` for each of ``own``, itself (``skip``) left out."""
    far = (all_rows * all_rows).sum(1)[None, :] - 2 * own @ all_rows.T
    far[np.arange(len(own)), skip] = np.inf
    return np.argpartition(far, k - 1, axis=1)[:, :k]


def halves(rows: np.ndarray, parts: int) -> np.ndarray:
    """A first balanced partition: cuts across the widest direction, in proportion to the parts on either side."""
    label, todo = np.zeros(len(rows), "i4"), [(np.arange(len(rows)), 0, parts)]
    while todo:
        at, first, n = todo.pop()
        if n == 1:
            label[at] = first
            continue
        centred = rows[at] - rows[at].mean(0)
        axis = np.ones(rows.shape[1])
        for _ in range(12):
            axis = centred.T @ (centred @ axis)
            axis /= np.linalg.norm(axis) or 1.0
        order = at[np.argsort(centred @ axis, kind="stable")]
        cut = len(at) * (n // 2) // n
        todo += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    return label


def refine(label: np.ndarray, links: np.ndarray, parts: int, sweeps: int = 12, slack: float = 0.05) -> np.ndarray:
    """Move rows to the partition that holds most of their neighbours, as far as all stay of nearly equal size."""
    label, size = label.copy(), np.bincount(label, minlength=parts)
    most, least = int(np.ceil(len(label) / parts * (1 + slack))), int(len(label) / parts * (1 - slack))
    ends = np.concatenate([links.ravel(), np.repeat(np.arange(len(links)), links.shape[1])])
    starts = np.concatenate([np.repeat(np.arange(len(links)), links.shape[1]), links.ravel()])
    order = np.argsort(starts, kind="stable")
    ends, first = ends[order], np.searchsorted(starts[order], np.arange(len(label) + 1))
    for _ in range(sweeps):
        votes = np.bincount(starts * parts + label[np.concatenate([links.ravel(), np.repeat(np.arange(len(links)), links.shape[1])])],
                            minlength=len(label) * parts).reshape(len(label), parts)
        gain = votes.max(1) - votes[np.arange(len(label)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            near = np.bincount(label[ends[first[i] : first[i + 1]]], minlength=parts)
            near[size >= most] = -1
            own, to = label[i], int(near.argmax())
            if to != own and size[own] > least and near[to] > (near[own] if near[own] >= 0 else np.count_nonzero(label[ends[first[i] : first[i + 1]]] == own)):
                label[i] = to
                size[own] -= 1
                size[to] += 1
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A network of one hidden layer: logits of the partitions for vectors of any length but zero."""

    def __init__(self, rows: np.ndarray, wanted: np.ndarray, hidden: int = 128, epochs: int = 40, batch: int = 256, rate: float = 3e-3):
        rng = np.random.default_rng(7)
        self.centre, self.scale = rows.mean(0), max(float(rows.std()), 1e-300)
        x = ((rows - self.centre) / self.scale).astype("f4")
        y = wanted.astype("f4")
        sizes = [(x.shape[1], hidden), (hidden, y.shape[1]), (x.shape[1], y.shape[1])]
        # the third matrix goes past the hidden layer
        weights = [rng.normal(0, a**-0.5, (a, b)).astype("f4") * (0 if k == 2 else 1) for k, (a, b) in enumerate(sizes)]
        weights += [np.zeros(hidden, "f4"), np.zeros(y.shape[1], "f4")]
        mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                xs, ys = x[order[at : at + batch]], y[order[at : at + batch]]
                a, b, c, ba, bb = weights
                inner = np.maximum(xs @ a + ba, 0)
                out = inner @ b + xs @ c + bb
                out = np.exp(out - out.max(1, keepdims=True))
                error = (out / out.sum(1, keepdims=True) - ys) / len(xs)
                back = (error @ b.T) * (inner > 0)
                grads = [xs.T @ back, inner.T @ error, xs.T @ error, back.sum(0), error.sum(0)]
                step += 1
                pace = rate * (1 - step / steps) + 1e-5
                for w, m, s, g in zip(weights, mean, square, grads):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.weights = weights

    def logits(self, rows: np.ndarray) -> np.ndarray:
        x = ((rows - self.centre) / self.scale).astype("f4")
        a, b, c, ba, bb = self.weights
        return np.maximum(x @ a + ba, 0) @ b + x @ c + bb


def wanted(label: np.ndarray, links: np.ndarray, parts: int) -> np.ndarray:
    """What the network should answer for each row: where its neighbours and, counted twice, itself are."""
    out = np.zeros((len(label), parts))
    np.add.at(out, (np.repeat(np.arange(len(label)), links.shape[1]), label[links.ravel()]), 1)
    out[np.arange(len(label)), label] += 2
    return out / out.sum(1, keepdims=True)


class Index:
    """``rows`` (vec_id, vector, part) of all usable vectors, the network, and the number of partitions a query
    visits (``probes``) with the ``recall`` measured for it."""

    def __init__(self, rows: DataFrame, router: Router | None, sizes: list[int], probes: int, recall: float):
        self.rows, self.router, self.sizes, self.probes, self.recall = rows, router, sizes, probes, recall


def _graph(spark, rows: np.ndarray) -> np.ndarray:
    """Neighbour lists of the sample, found in blocks by tasks that hold all of it."""
    k, step = min(DEGREE, len(rows) - 1), 512
    if k < 1:
        return np.empty((len(rows), 0), "i8")
    narrow = rows.astype("f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                own = narrow[at : at + step]
                near = neighbours(own, narrow, np.arange(at, at + len(own)), k)
                yield pa.record_batch([pa.array([at]), pa.array([near.ravel().tolist()], pa.list_(pa.int64()))], ["at", "near"])

    blocks = -(-len(rows) // step)
    found = spark.range(0, len(rows), step, blocks).mapInArrow(run, "at bigint, near array<bigint>").collect()
    return np.array([x for r in sorted(found) for x in r["near"]], "i8").reshape(-1, k)


def _assign(rows: DataFrame, router: Router) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.logits(matrix(batch.column(1))).argmax(1)
                yield pa.record_batch([*batch.columns, pa.array(part.astype("i4"))], ["vec_id", "vector", "part"])

    return rows.mapInArrow(run, f"vec_id bigint, vector {rows.schema['vector'].dataType.simpleString()}, part int")


def _true_parts(rows: DataFrame, ids: np.ndarray, trials: np.ndarray, k: int) -> np.ndarray:
    """(trial, part) of the ``k`` nearest among all rows, a block of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, part, lengths = np.full((len(trials), k), np.inf), np.zeros((len(trials), k), "i4"), (trials * trials).sum(1)[:, None]
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                block = batch.slice(at, 2_048)
                here = matrix(block.column(1))
                d = np.maximum(lengths + (here * here).sum(1)[None, :] - 2 * trials @ here.T, 0)
                d[ids[:, None] == block.column(0).to_numpy()[None, :]] = np.inf
                far = np.hstack([far, d])
                part = np.hstack([part, np.broadcast_to(block.column(2).to_numpy()[None, :], d.shape)])
                best = np.argpartition(far, k - 1, axis=1)[:, :k]
                far, part = np.take_along_axis(far, best, 1), np.take_along_axis(part, best, 1)
        trial = np.repeat(np.arange(len(trials)), k)
        keep = np.isfinite(far.ravel())
        yield pa.record_batch([pa.array(trial[keep]), pa.array(far.ravel()[keep]), pa.array(part.ravel()[keep])], ["trial", "far", "part"])

    best = Window.partitionBy("trial").orderBy("far", "part")
    found = rows.mapInArrow(run, "trial bigint, far double, part int").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    return np.array([(r["trial"], r["part"]) for r in found.select("trial", "part").collect()], "i8").reshape(-1, 2)


def fit(vectors: DataFrame, k: int = 10) -> Index:
    """Index of (vec_id, vector). Null ids, unusable vectors, and vectors that have not the commonest length
    (of equally common ones the greatest) take no part; an empty table gives an index without rows. Repeated
    ids are rows each. Components must lie below 1e150, so that their squares are finite."""
    spark = vectors.sparkSession
    good = vectors.select("vec_id", "vector").filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    top = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if top is None:
        return Index(good.withColumn("part", F.lit(0)), None, [0], 1, 1.0)
    n, good = top["count"], good.filter(F.size("vector") == top["d"])
    most = max(2, min(SAMPLE, SAMPLE_NUMBERS // top["d"]))
    mixed = F.xxhash64("vec_id")
    share = int(min(1.0, 1.2 * most / n) * (1 << 62))
    sample = good.filter(F.shiftrightunsigned(mixed, 2) < share).orderBy(mixed, "vector").limit(most).toArrow()
    ids, rows = sample.column(0).to_numpy(), matrix(sample.column(1).combine_chunks())
    parts = max(1, min(n // ROWS, len(rows) // SUPPORT))
    links = _graph(spark, rows)
    label = refine(halves(rows, parts), links, parts)
    router = Router(rows, wanted(label, links, parts))
    assigned = cut_lineage(_assign(good, router))
    held = {r["part"]: r["count"] for r in assigned.groupBy("part").count().collect()}
    sizes = [held.get(p, 0) for p in range(parts)]
    found = _true_parts(assigned, ids[:TRIALS], rows[:TRIALS], k)
    if not len(found):
        return Index(assigned, router, sizes, parts, 1.0)
    places = np.argsort(np.argsort(-router.logits(rows[:TRIALS]), axis=1, kind="stable"), axis=1)[found[:, 0], found[:, 1]]
    reached = np.cumsum(np.bincount(places, minlength=parts)) / len(found)
    probes = int(np.argmax(reached >= RECALL)) + 1
    return Index(assigned, router, sizes, probes, float(reached[probes - 1]))


def _route(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """Queries with the partitions they visit: the most probable ones, and more while these hold no ``k`` others."""
    router, probes, sizes = index.router, index.probes, np.array(index.sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-router.logits(matrix(batch.column(1))), axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) <= k).sum(1) + 1
            visits = [o[: max(probes, e)].tolist() for o, e in zip(order, enough)]
            yield pa.record_batch([*batch.columns, pa.array(visits, pa.list_(pa.int32()))], ["vec_id", "vector", "parts"])

    return queries.mapInArrow(run, f"vec_id bigint, vector {queries.schema['vector'].dataType.simpleString()}, parts array<int>")


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, distances) of the ``k`` nearest rows, ties to smaller ids, rows with the query's id left
    out. A product finds who can be among them; their distances are then taken from the differences, added up
    in the order of the components."""
    lengths, own = (rows * rows).sum(1), (queries * queries).sum(1)
    far = lengths[None, :] + own[:, None] - 2 * queries @ rows.T
    far[query_ids[:, None] == ids[None, :]] = np.inf
    slack = 1e-14 * rows.shape[1] * (own + lengths.max())
    last = np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] > k else np.full(len(far), np.finfo("f8").max)
    for q, (near, bound) in enumerate(zip(far, last + slack)):
        at = np.flatnonzero((near <= bound) & (near < np.inf))
        if len(at):
            apart = rows[at] - queries[q]
            score = np.sqrt(np.cumsum(apart * apart, axis=1)[:, -1])
            best = np.lexsort((ids[at], score))[:k]
            yield query_ids[q], ids[at][best], score[best]


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query (vec_id, vector), by Euclidean
    distance, ties to the smaller id; all rows, if there are fewer. A row with the query's own id is none of its
    candidates. Unusable queries have no answer; of queries with the same id the least vector counts."""
    spark = queries.sparkSession
    if index.router is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    length = len(index.router.centre)
    asked = queries.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")) & (F.size("vector") == length))
    asked = asked.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = F.array(*[F.lit(max(1, -(-n // BLOCK))) for n in index.sizes])
    of_part = F.element_at(blocks, F.col("part") + 1)
    rows = index.rows.select("part", F.pmod(F.xxhash64("vec_id"), of_part).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "vector")
    visits = _route(asked, index, k).select("vec_id", "vector", F.explode("parts").alias("part"))
    visits = visits.select("part", F.explode(F.sequence(F.lit(0), of_part - 1)).alias("block"), F.lit(1).alias("kind"), "vec_id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("part", "block", "kind")], 1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                here, kind = tuple(marks[start, :2]), marks[start, 2]
                if here != key:
                    key, ids, vectors = here, [], []
                piece = batch.slice(start, end - start)
                own = piece.column("vec_id").to_numpy()
                if kind == 0:
                    ids.append(own)
                    vectors.append(matrix(piece.column("vector")))
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                asking = matrix(piece.column("vector"))
                for at in range(0, len(own), QUERIES):
                    found = list(nearest(own[at : at + QUERIES], asking[at : at + QUERIES], ids[0], vectors[0], k))
                    if found:
                        yield pa.record_batch([
                            pa.array(np.concatenate([np.full(len(i), q) for q, i, _ in found])), pa.array(np.concatenate([i for _, i, _ in found])),
                            pa.array(np.concatenate([s for _, _, s in found]))], ["query_id", "vec_id", "score"])

    met = rows.unionByName(visits).repartition("part", "block").sortWithinPartitions("part", "block", "kind")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.mapInArrow(run, _FOUND).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
