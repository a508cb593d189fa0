"""K-means, with and without labelled points, and cluster accuracy.

Points stay distributed. Centres (k x d) are held by the driver only within the ship limit;
beyond it they are a table in the shared folder and points are matched to it block by block.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_key, seeded_uniform
from ..functions.vectors import euclidean_distance
from ..session import SHIP_LIMIT_BYTES, cut_lineage
from .aggregates import PartialSums, merge_partials, vector_mean, vector_sums
from .dense import best_hits, closeness, matrix, own_closeness, vectors
from .metrics import contingency
from .ranking import row_index
from .scoring import match_prototypes, ship

# Rows that are put in order at the end of a search by running share.
FEW = 4096


@dataclass
class Clustering:
    centers: DataFrame | dict  # (cluster, center), or the shipped form
    inertia: float
    iterations: int
    points: DataFrame
    vec: str
    key: str
    pinned: str | None

    def labels(self) -> DataFrame:
        """(key, cluster): pinned rows keep their cluster, the others go to the nearest centre."""
        return assign(self.points, self.centers, self.vec, [self.key], self.pinned).select(self.key, "cluster")


def assign(points: DataFrame, centers: DataFrame | dict, vec: str, keep: Sequence[str], pinned: str | None = None,
           ship_limit: int = SHIP_LIMIT_BYTES) -> DataFrame:
    """(keep..., cluster, sq_dist) under the given centres."""
    rows = points if pinned is None else points.withColumn("_truth", F.coalesce(F.col(pinned), F.lit(-1)).cast("bigint"))
    matched = match_prototypes(
        rows, centers, vec=vec, proto_vec="center", label="cluster", metric="l2",
        truth=None if pinned is None else "_truth", keep=list(keep) + ([] if pinned is None else [pinned]),
        ship_limit=ship_limit,
    )
    near, dist = F.get("hits", 0)["label"], F.get("hits", 0)["score"]
    if pinned is not None:
        near, dist = F.coalesce(F.col(pinned).cast("bigint"), near), F.coalesce(F.col("own_score"), dist)
    return matched.select(*keep, near.alias("cluster"), (dist * dist).alias("sq_dist"))


def _pinnable(points: DataFrame, vec: str, pinned: str | None, *keep: str) -> DataFrame:
    pin = F.lit(None) if pinned is None else F.col(pinned)
    return points.select(*keep, F.col(vec).cast("array<double>").alias("_v"), pin.cast("bigint").alias("_pin"))


def _run_sums(points: DataFrame, runs: dict[int, tuple[np.ndarray, np.ndarray]], vec: str, pinned: str | None = None) -> DataFrame:
    rows = _pinnable(points, vec, pinned)
    return merge_partials(rows.mapInArrow(_assign_kernel(runs), "run bigint, cluster bigint, _n bigint, _s array<double>"), ["run", "cluster"])


def cluster_sums(points: DataFrame, centers: dict, vec: str, pinned: str | None = None) -> DataFrame:
    """(cluster, n, total) in one map-side pass; the last number of ``total`` is the sum of the
    squared distances, the others are the coordinates."""
    return _run_sums(points, {0: centers[()]}, vec, pinned).drop("run")


def shift_of(old: np.ndarray, new: np.ndarray) -> float:
    """Sum of the distances the centres moved."""
    return float(np.sqrt(((new - old) ** 2).sum(axis=1)).sum())


def lloyd_round(points: DataFrame, centers: dict, vec: str, pinned: str | None = None) -> tuple[dict, float, float]:
    """New centres, the inertia under the old ones, and the shift. One job; k sums come back. A
    cluster without points keeps its centre."""
    labels, old = centers[()]
    sums = cluster_sums(points, centers, vec, pinned).toArrow()
    new, total = old.copy(), matrix(sums.column("total"))
    at = np.searchsorted(labels, sums.column("cluster").to_numpy())
    new[at] = total[:, :-1] / sums.column("n").to_numpy()[:, None]
    return {(): (labels, new)}, float(total[:, -1].sum()), shift_of(old, new)


def _table_round(points: DataFrame, centers: DataFrame, vec: str, key: str, pinned: str | None, ship_limit: int):
    """The same with the centres as a table."""
    near = points.select(key, vec).join(assign(points, centers, vec, [key], pinned, ship_limit), key)
    measured = F.concat(F.col(vec).cast("array<double>"), F.array("sq_dist"))
    sums = vector_sums(near.select("cluster", measured.alias("_x")), "_x", ["cluster"])
    mean = F.transform(F.slice("total", F.lit(1), F.size("total") - 1), lambda x: x / F.col("n"))
    fresh = sums.select("cluster", mean.alias("_c"), F.element_at("total", -1).alias("inertia"))
    old = F.col("center").cast("array<double>")
    moved = cut_lineage(
        centers.join(fresh, "cluster", "left").select("cluster", F.coalesce("_c", old).alias("center"), old.alias("_old"), "inertia")
    )
    inertia, shift = moved.agg(F.sum("inertia"), F.sum(euclidean_distance("center", "_old"))).first()
    return moved.select("cluster", "center"), inertia, shift


def centers_table(spark, centers: dict) -> DataFrame:
    labels, w = centers[()]
    rows = pa.table({"cluster": pa.array(labels), "center": vectors(w)})
    return spark.createDataFrame(rows, "cluster bigint, center array<double>")


def _nearest(batch: pa.RecordBatch, x: np.ndarray, labels: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of a batch's rows; pinned rows stay in theirs."""
    top, score, _ = best_hits(x, labels, w, 1, "l2")
    cluster, dist = top[:, 0], -score[:, 0]
    pin = batch.column("_pin")
    if pin.null_count < len(pin):
        is_pinned = pin.is_valid().to_numpy(zero_copy_only=False)
        to = pin.fill_null(0).to_numpy()[is_pinned]
        cluster[is_pinned] = to
        dist[is_pinned] = -own_closeness(x[is_pinned], w[np.searchsorted(labels, to)], "l2")
    return cluster, dist


def _assign_kernel(runs: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Nearest centre and the sums per (run, centre) in one pass over a task's batches."""
    def run(batches):
        sums = PartialSums(["run", "cluster"])
        sums.types = [pa.int64(), pa.int64()]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column("_v"))
            for r, (labels, w) in runs.items():
                cluster, dist = _nearest(batch, x, labels, w)
                measured = np.column_stack([x, dist])
                order = np.argsort(cluster, kind="stable")
                names, starts = np.unique(cluster[order], return_index=True)
                for name, rows in zip(names, np.split(order, starts[1:])):
                    sums.add((r, int(name)), measured[rows])
            if sums.full():
                yield from sums.flush()
        yield from sums.flush()

    return run


def lloyd_runs(points: DataFrame, starts: Sequence[dict | DataFrame], vec: str, key: str, max_iterations: int = 100, tolerance: float = 1e-4,
               pinned: str | None = None, ship_limit: int = SHIP_LIMIT_BYTES) -> list[tuple[dict | DataFrame, float, int]]:
    """``lloyd`` from several starts: one pass over the points a round moves the centres of all that have not settled."""
    if not all(isinstance(c, dict) for c in starts):
        return [lloyd(points, c, vec, key, max_iterations, tolerance, pinned, ship_limit) for c in starts]
    centers, best = [c[()] for c in starts], [(c, None, 0) for c in starts]
    going = set(range(len(starts)))
    for rounds in range(1, max_iterations + 1):
        if not going:
            break
        sums = _run_sums(points, {r: centers[r] for r in sorted(going)}, vec, pinned).toArrow()
        run, cluster, n = (sums.column(c).to_numpy() for c in ("run", "cluster", "n"))
        total = matrix(sums.column("total"))
        for r in sorted(going):
            mine, (labels, old) = run == r, centers[r]
            inertia, new = float(total[mine, -1].sum()) if mine.any() else 0.0, old.copy()
            new[np.searchsorted(labels, cluster[mine])] = total[mine, :-1] / n[mine, None] if mine.any() else new[:0]
            if best[r][1] is None or inertia < best[r][1]:
                best[r] = ({(): (labels, old)}, inertia, rounds)
            best[r] = (*best[r][:2], rounds)
            centers[r] = (labels, new)
            if shift_of(old, new) ** 2 < tolerance:
                going.discard(r)
    return best


def lloyd(points: DataFrame, centers: DataFrame | dict, vec: str, key: str, max_iterations: int = 100, tolerance: float = 1e-4,
          pinned: str | None = None, ship_limit: int = SHIP_LIMIT_BYTES):
    """Rounds until the squared total shift is below ``tolerance``. Returns the centres of lowest
    inertia (those that produced it), that inertia, and the number of rounds."""
    if not isinstance(centers, dict):
        table = cut_lineage(centers.select(F.col("cluster").cast("bigint").alias("cluster"), "center"))
        centers = ship(table, [], "cluster", "center", ship_limit) or table
    best, best_inertia, rounds = centers, None, 0
    for rounds in range(1, max_iterations + 1):
        if isinstance(centers, dict):
            moved, inertia, shift = lloyd_round(points, centers, vec, pinned)
        else:
            moved, inertia, shift = _table_round(points, centers, vec, key, pinned, ship_limit)
        if best_inertia is None or inertia < best_inertia:
            best, best_inertia = centers, inertia
        centers = moved
        if shift * shift < tolerance:
            break
    return best, best_inertia, rounds


# -- first centres -----------------------------------------------------------------------------


def first_k(points: DataFrame, vec: str, key: str, k: int) -> DataFrame:
    """The first k points as centres. ``k`` rows by a top-k sort."""
    head = points.select(key, F.col(vec).cast("array<double>").alias("center")).orderBy(key).limit(k)
    return head.withColumn("cluster", (F.row_number().over(Window.orderBy(key)) - 1).cast("bigint")).select("cluster", "center")


def random_k(points: DataFrame, vec: str, key: str, k: int, seed) -> DataFrame:
    """k distinct random points as centres."""
    drawn = points.select(key, F.col(vec).cast("array<double>").alias("center"), seeded_key(seed, key).alias("_h"))
    head = drawn.orderBy("_h", key).limit(k)
    return head.withColumn("cluster", (F.row_number().over(Window.orderBy("_h", key)) - 1).cast("bigint")).select("cluster", "center")


def _share_picks(rows: DataFrame, key: str, goals: Sequence[float], seeds: Sequence) -> DataFrame:
    """Per run, the first of ``rows`` (columns, and ``_best``: an array with a weight per run) in seeded order whose
    running share of the weights reaches the run's goal; the last one if rounding leaves it short.

    Sums by the first digits of the seeded hash tell where the row lies, two digits more at a time, until at
    most ``FEW`` rows are left; only those are put in order.
    """
    hashed = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), seeded_key(s, key).alias("_h")) for r, s in enumerate(seeds)]))
    lines = rows.withColumn("_line", hashed).select("*", "_line.*").drop("_line").withColumn("_w", F.element_at("_best", F.col("run") + 1)).drop("_best")
    place: dict[int, tuple[str, float, float]] = {}  # run: digits so far, weight before them, weight to reach
    open_runs = set(range(len(seeds)))

    def inside(runs) -> DataFrame:
        if not place:
            return lines
        keep = F.lit(False)
        for r in runs:
            keep = keep | ((F.col("run") == r) & F.col("_h").startswith(place[r][0]))
        return lines.filter(keep)

    while open_runs:
        digits = len(place[min(open_runs)][0]) if place else 0  # the same for all that go on
        found: dict[int, list] = {}
        cells = inside(open_runs).groupBy("run", F.substring("_h", 1, digits + 2).alias("_p")).agg(F.sum("_w").alias("w"), F.count("*").alias("n"))
        for run, prefix, weight, n in cells.collect():
            found.setdefault(run, []).append((prefix, weight, n))
        for r in list(open_runs):
            held = sorted(found.get(r, []))
            if not held:
                open_runs.discard(r)
                continue
            _, before, goal = place.get(r, ("", 0.0, None))
            upto = before + np.cumsum([w for _, w, _ in held])
            goal = goals[r] * upto[-1] if goal is None else goal
            # Rounding may leave the last running sum a hair below the goal.
            at = min(int(np.searchsorted(upto, goal)), len(held) - 1)
            place[r] = (held[at][0], float(upto[at - 1]) if at else before, goal)
            if held[at][2] <= FEW or len(held[at][0]) >= 32:
                open_runs.discard(r)
    if not place:
        return lines.drop("_h", "_w")
    order = Window.partitionBy("run").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0)
    left = F.element_at(F.create_map(*[x for r, (_, before, goal) in place.items() for x in (F.lit(r), F.lit(float(goal - before)))]), F.col("run"))
    summed = inside(list(place)).withColumn("_cum", F.sum("_w").over(order)).withColumn("_reached", F.col("_cum") >= left)
    first = Window.partitionBy("run").orderBy(F.desc("_reached"), F.when(F.col("_reached"), F.col("_h")).asc(), F.desc("_h"), key)
    return summed.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_h", "_w", "_cum", "_reached", "_r")


def d2_pick(distances: DataFrame, key: str, sq_dist: str, r: float, seed) -> DataFrame:
    """The first row, in seeded order, whose running share of the squared distance reaches ``r``."""
    return _share_picks(distances.withColumn("_best", F.array(sq_dist)), key, [r], [seed]).drop("run")


def _closer(rows: DataFrame, key: str, fresh: np.ndarray) -> DataFrame:
    """Best squared distance of every run after one more centre each."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, best = matrix(batch.column("_v")), matrix(batch.column("_best"))
                gap = np.column_stack([-closeness(x, c[None, :], "l2")[:, 0] for c in fresh])
                yield pa.record_batch([batch.column(key), batch.column("_v"), vectors(np.minimum(best, gap))], [key, "_v", "_best"])

    return rows.select(key, "_v", "_best").mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, _v array<double>, _best array<double>")


def d2_seeds_runs(points: DataFrame, vec: str, key: str, k: int, seeds: Sequence, centers: DataFrame | None = None,
                  ship_limit: int = SHIP_LIMIT_BYTES) -> list[DataFrame | dict]:
    """Centres grown to ``k`` for every seed at once, by drawing points with probability proportional to their
    squared distance from the run's centres so far (or from one random point).

    The distances are a kept table that only the newest centre of each run meets, so k centres take k passes.
    """
    spark = points.sparkSession
    runs = len(seeds)
    rows = points.select(key, F.col(vec).cast("array<double>").alias("_v"))
    if centers is None:
        far = F.array(*[F.lit(float("inf"))] * runs)
        heads = rows.agg(*[F.min(F.struct(seeded_key(s, key).alias("h"), F.col(key).alias("k"), F.col("_v").alias("v"))).alias(f"r{r}") for r, s in enumerate(seeds)]).first()
        if heads[0] is None:
            return [centers_table(spark, {(): (np.zeros(0, "i8"), np.zeros((0, 0)))}) for _ in seeds]
        grown = [np.array([h["v"]]) for h in heads]
        kept = cut_lineage(_closer(rows.withColumn("_best", far), key, np.stack([g[0] for g in grown])))
        names = np.arange(1)
    else:
        table = cut_lineage(centers.select(F.col("cluster").cast("bigint").alias("cluster"), F.col("center").cast("array<double>").alias("center")))
        near = assign(points, ship(table, [], "cluster", "center", ship_limit) or table, vec, [key, vec], ship_limit=ship_limit)
        kept = cut_lineage(near.select(key, F.col(vec).cast("array<double>").alias("_v"), F.array_repeat("sq_dist", runs).alias("_best")))
        grown = None
    first = table.count() if centers is not None else 1
    added = [[] for _ in seeds]
    shares = {r: [x[0] for x in spark.range(first, k).select(seeded_uniform(s, F.lit("d2"), "id")).collect()] if first < k else [] for r, s in enumerate(seeds)}
    for number in range(first, k):
        picked = {r["run"]: r["_v"] for r in _share_picks(kept, key, [shares[r][number - first] for r in range(runs)], seeds).select("run", "_v").collect()}
        if not picked:
            break
        for r in range(runs):
            added[r].append(picked[r])
        if number + 1 < k:
            kept = cut_lineage(_closer(kept, key, np.array([picked[r] for r in range(runs)])))
    out = []
    for r in range(runs):
        if centers is None:
            w = np.vstack([grown[r], *[np.array(v)[None, :] for v in added[r]]])
            held = {(): (np.arange(len(w)), w)}
            out.append(held if w.nbytes <= ship_limit else centers_table(spark, held))
            continue
        fresh = spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(added[r])], "cluster bigint, center array<double>")
        whole = table.unionByName(fresh)
        out.append(ship(whole, [], "cluster", "center", ship_limit) or cut_lineage(whole))
    return out


def d2_seeds(points: DataFrame, vec: str, key: str, k: int, seed, centers: DataFrame | None = None,
             ship_limit: int = SHIP_LIMIT_BYTES) -> DataFrame | dict:
    """``d2_seeds_runs`` for one seed."""
    return d2_seeds_runs(points, vec, key, k, [seed], centers, ship_limit)[0]


def _best_of(fitted: list[tuple[dict | DataFrame, float, int]], points: DataFrame, vec: str, key: str, pinned: str | None) -> Clustering:
    centers, inertia, rounds = min(fitted, key=lambda f: f[1])  # the first of equal ones
    return Clustering(centers, inertia, rounds, points, vec, key, pinned)


def kmeans(points: DataFrame, vec: str, key: str, k: int, init: str = "k-means++", max_iterations: int = 100,
           tolerance: float = 1e-4, n_init: int = 10, seed: int = 0) -> Clustering:
    """The restart with the lowest inertia. ``init``: ``k-means++``, ``random`` or ``first``."""
    seeds = [seed + i for i in range(n_init)]
    starts = {
        "k-means++": lambda: d2_seeds_runs(points, vec, key, k, seeds),
        "random": lambda: [random_k(points, vec, key, k, s) for s in seeds],
        "first": lambda: [first_k(points, vec, key, k)],
    }
    if init not in starts:
        raise ValueError(f"init must be one of {', '.join(starts)}, not {init!r}")
    return _best_of(lloyd_runs(points, [_shipped(c) for c in starts[init]()], vec, key, max_iterations, tolerance), points, vec, key, None)


def _shipped(centers: dict | DataFrame, ship_limit: int = SHIP_LIMIT_BYTES) -> dict | DataFrame:
    if isinstance(centers, dict):
        return centers
    table = cut_lineage(centers.select(F.col("cluster").cast("bigint").alias("cluster"), "center"))
    return ship(table, [], "cluster", "center", ship_limit) or table


def semi_kmeans_runs(points: DataFrame, vec: str, key: str, label: str, k: int, seeds: Sequence[int], max_iterations: int = 100,
                     tolerance: float = 1e-4) -> list[Clustering]:
    """K-means with labelled rows held in the cluster of their class, from every seed, all in the same passes.

    ``label`` is NULL for unlabelled rows. Clusters 0.. are the labelled classes in ascending
    order, started at the class means; further centres come from the unlabelled rows.
    """
    labelled, free = points.filter(F.col(label).isNotNull()), points.filter(F.col(label).isNull())
    # Written inside the numbering.
    means = vector_mean(labelled, vec, [label], "center").select(label, "center")
    classes = row_index(means, [label], "cluster")
    # One row per class: joined by size, the adaptive skew join splits a hot class.
    pinned = points.join(classes.select(label, F.col("cluster").alias("_pin")), label, "left")
    starts = d2_seeds_runs(free, vec, key, k, seeds, classes.select("cluster", "center"))
    fitted = lloyd_runs(pinned, starts, vec, key, max_iterations, tolerance, "_pin")
    return [Clustering(*f, pinned, vec, key, "_pin") for f in fitted]


def semi_kmeans(points: DataFrame, vec: str, key: str, label: str, k: int, max_iterations: int = 100,
                tolerance: float = 1e-4, n_init: int = 10, seed: int = 0) -> Clustering:
    """The restart of ``semi_kmeans_runs`` with the lowest inertia."""
    runs = semi_kmeans_runs(points, vec, key, label, k, [seed + i for i in range(n_init)], max_iterations, tolerance)
    return min(runs, key=lambda c: c.inertia)


def label_runs(fitted: Sequence[Clustering]) -> DataFrame:
    """(key, run, cluster) of clusterings of the same points, in one pass over them."""
    one = fitted[0]
    if not all(isinstance(c.centers, dict) for c in fitted):
        told = [c.labels().withColumn("run", F.lit(r)) for r, c in enumerate(fitted)]
        return functools.reduce(DataFrame.unionByName, told).select(one.key, "run", "cluster")
    centers, key = [c.centers[()] for c in fitted], one.key

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("_v"))
                found = np.column_stack([_nearest(batch, x, *c)[0] for c in centers])
                yield pa.record_batch([batch.column(key), pa.array(found.tolist(), pa.list_(pa.int64()))], [key, "_c"])

    rows = _pinnable(one.points, one.vec, one.pinned, key)
    told = rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, _c array<bigint>")
    return told.select(key, F.posexplode("_c").alias("run", "cluster"))


def best_restart(runs: DataFrame, inertia: str, by: Sequence[str] = ()) -> DataFrame:
    """The run of lowest inertia; the earlier one on ties."""
    rest = [c for c in runs.columns if c not in by and c != inertia]
    row = F.min(F.struct(F.col(inertia).alias(inertia), *[F.col(c).alias(c) for c in rest])).alias("_r")
    return runs.groupBy(*by).agg(row).select(*by, "_r.*")


# -- cluster accuracy --------------------------------------------------------------------------


def assignment(person: Sequence, thing: Sequence, gain: Sequence[int]) -> dict:
    """{person: thing} of largest total gain, one to one, from the cells (person, thing, gain > 0) of a sparse table.

    People are placed one after the other, each along the cheapest chain of moves that ends at a free thing or
    leaves someone without one. Whole prices keep every move's cost from falling below 0, so the search stops
    at the first such end, and after as many searches as there are people the total is the largest possible.
    """
    cells: dict = {}
    for p, t, g in zip(person, thing, gain):
        cells.setdefault(p, []).append((t, -int(g)))
    level = {p: min(c for _, c in own) for p, own in cells.items()}
    price: dict = {}
    owner: dict = {}
    placed: dict = {}
    for start in sorted(cells):
        near, via, settled, people = {}, {}, {}, [(start, 0)]
        heap: list = []
        end, last, at = -level[start], None, start  # so far cheapest: the starter goes without
        here, d = start, 0
        while True:
            offset = d - level[here]
            for t, c in cells[here]:
                if t not in settled:
                    reach = offset + c - price.get(t, 0)
                    if reach < near.get(t, reach + 1):
                        near[t], via[t] = reach, here
                        heappush(heap, (reach, t))
            if offset < end:
                end, last, at = offset, None, here
            while heap and (heap[0][1] in settled or heap[0][0] > near[heap[0][1]]):
                heappop(heap)
            if not heap or heap[0][0] >= end:
                break
            d, t = heappop(heap)
            if t not in owner:
                end, last, at = d, t, via[t]
                break
            settled[t] = d
            here = owner[t]
            people.append((here, d))
        for p, reach in people:
            level[p] += end - reach
        for t, reach in settled.items():
            price[t] = price.get(t, 0) - (end - reach)
        while True:  # back along the chain: each one takes what the next has left
            left = placed.get(at)
            if last is None:
                placed.pop(at, None)
            else:
                placed[at], owner[last] = last, at
            if at == start:
                break
            last, at = left, via[left]
    return placed


def best_mapping(counts: DataFrame, pred: str, true: str, by: Sequence[str]) -> DataFrame:
    """(by..., pred, true): the one-to-one mapping of clusters to classes with most rows, per subset. What is
    brought together is the counts of a subset, which grow with clusters and classes, not with rows."""
    by = list(by)
    schema = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in [*by, pred, true])

    def solve(table: pa.Table) -> pa.Table:
        found = assignment(*[table.column(c).to_pylist() for c in (pred, true, "n")])
        keys = [pa.array([table.column(c)[0].as_py()] * len(found), table.schema.field(c).type) for c in by]
        sides = [pa.array(list(side), table.schema.field(c).type) for c, side in ((pred, found.keys()), (true, found.values()))]
        return pa.table([*keys, *sides], [*by, pred, true])

    small = counts.filter("n > 0").select(*by, pred, true, "n")
    return small.groupBy(*by).applyInArrow(solve, schema)


def cluster_accuracy(df: DataFrame, pred: str, true: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows that are right under the best one-to-one mapping of clusters to classes,
    found separately in every subset given by ``by``. Rows without cluster or class are never right."""
    by = list(by)
    work = df if by else df.withColumn("_whole", F.lit(0))
    keys = by or ["_whole"]
    counts = cut_lineage(contingency(work, pred, true, keys))
    known = counts.filter(F.col(pred).isNotNull() & F.col(true).isNotNull())
    mapping = best_mapping(known, pred, true, keys).withColumn("_ok", F.lit(1))
    scored = counts.join(mapping, [*keys, pred, true], "left")
    out = scored.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("_ok") == 1, F.col("n")).otherwise(0)).alias("n_right"),
    )
    return out.select(*by, "n_rows", "n_right", (F.col("n_right") / F.col("n_rows")).alias("accuracy"))
