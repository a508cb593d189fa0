"""Probes on stored features: many small kernel machines, and linear models for many labels, fitted at once.

Every fit here is a sequence of ridge problems with one matrix. Tasks add up the matrix of their rows once and, a
step at a time, the right-hand sides of all models; what travels is sums, never rows of another model. There is no
loop over tasks, folds, draws or labels on the driver, only over steps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.hashing import seeded_key, seeded_uniform
from ..operators.aggregates import merge_partials, vector_mean, vector_sums
from ..operators.dense import matrix, vectors
from ..operators.metrics import label_accuracy, macro_f1, run_summary
from ..session import cut_lineage

# fixed values: the search space of the per-task probe
KERNELS = ("rbf", "linear", "sigmoid", "poly")
C_RANGE, GAMMA_RANGE = (1e-3, 1e1), (1e-4, 1e-3)
# Rows of a task that are worked on together.
GROUP = 8192
# Numbers in the systems that are solved together.
SYSTEMS = 1 << 22


def log_uniform_draws(low: float, high: float, n: int, seed: int) -> list[float]:
    """n values whose logarithm is uniform between the bounds."""
    draws = np.random.default_rng(seed).uniform(math.log(low), math.log(high), n)
    return [float(v) for v in np.exp(draws)]


@dataclass(frozen=True)
class Draws:
    """Candidates of all runs side by side: candidate i belongs to run ``run[i]``."""

    run: np.ndarray
    kernel: np.ndarray
    c: np.ndarray
    gamma: np.ndarray


def search_draws(n_draws: int, seeds: Sequence[int], kernels: Sequence[str] = KERNELS) -> Draws:
    """``n_draws`` candidates per seed: a kernel at random, C and gamma log-uniform."""
    per_seed = [
        (np.full(n_draws, i), np.random.default_rng([seed, 0]).choice(np.array(kernels), n_draws),
         log_uniform_draws(*C_RANGE, n_draws, [seed, 1]), log_uniform_draws(*GAMMA_RANGE, n_draws, [seed, 2]))
        for i, seed in enumerate(seeds)
    ]
    return Draws(*[np.concatenate(column) for column in zip(*per_seed)])


class Expansion:
    """Features in which all four kernels are weighted dot products: the constant, the coordinates, and random
    products of two and of three coordinates' sums, whose dot products estimate the second and third power of
    that of the coordinates. The same random signs serve every task, fold and candidate.

    The exponential of rbf and the hyperbolic tangent are taken as far as the third and first power, which the
    gammas in use allow on standardised coordinates, and the norms in rbf at their mean, the dimension.
    """

    def __init__(self, dim: int, width: int, seed: int = 0):
        self.dim, self.width, self.size = dim, width, 1 + dim + 2 * width
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (5, dim, width))

    def of(self, z: np.ndarray) -> np.ndarray:
        a, b, c, d, e = (z @ s for s in self.signs)
        root = math.sqrt(self.width)
        return np.hstack([np.ones((len(z), 1)), z, a * b / root, c * d * e / root])

    def weights(self, draws: Draws) -> np.ndarray:
        """A row per candidate: the weight of every feature, 0 where its kernel has none."""
        g, flat = draws.gamma, np.exp(-draws.gamma * self.dim)
        parts = {
            "linear": (np.ones_like(g), 0 * g, 0 * g),
            "sigmoid": (np.sqrt(g), 0 * g, 0 * g),
            "poly": (0 * g, 0 * g, g**1.5),
            "rbf": (flat * np.sqrt(2 * g), flat * math.sqrt(2) * g, flat * (2 * g) ** 1.5 / math.sqrt(6)),
        }
        each = np.array([[parts[k][p][i] for p in range(3)] for i, k in enumerate(draws.kernel)]).reshape(len(g), 3)
        return np.repeat(np.hstack([np.ones((len(g), 1)), each]), [1, self.dim, self.width, self.width], axis=1)


def solve_all(gram: np.ndarray, sums: np.ndarray, c: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients (features x candidates) that minimise |v|^2 / 2 + c * sum of squared errors, the constant not
    counted in |v|, where features are ``weight`` times those of ``gram`` and ``sums``."""
    out = np.zeros((len(gram), len(c)))
    kinds, kind = np.unique(weight > 0, axis=0, return_inverse=True)
    for k, active in enumerate(kinds):
        at, mine = np.flatnonzero(active), np.flatnonzero(kind.ravel() == k)
        ridge = np.diag(np.r_[1e-9, np.ones(len(at) - 1)])
        step = max(1, SYSTEMS // len(at) ** 2)
        for i in range(0, len(mine), step):
            some = mine[i : i + step]
            s, c2 = weight[np.ix_(some, at)], 2 * c[some]
            system = c2[:, None, None] * s[:, :, None] * gram[np.ix_(at, at)] * s[:, None, :] + ridge
            right = c2[:, None] * s * sums[np.ix_(at, some)].T
            out[np.ix_(at, some)] = (s * np.linalg.solve(system, right[:, :, None])[:, :, 0]).T
    return out


def task_tables(features: DataFrame, tasks: DataFrame, vec: str = "features") -> DataFrame:
    """Task rows with their feature vector, centred by the train mean of the task and scaled to
    unit length. A feature row may serve many tasks."""
    rows = tasks.join(features, "row_idx")
    means = vector_mean(rows.filter("split = 'train'"), vec, ["task"])
    return rows.join(means.select("task", "mean"), "task").withColumn("x", V.cl2n(vec, "mean")).drop("mean", vec)


def _scalers(rows: DataFrame, folds: int) -> DataFrame:
    """(task, held, at, w): mean (at -1) and deviation (at -2) of the train rows outside fold ``held``; -1 holds none."""
    wide = F.concat(F.array(F.lit(1.0)), "x", F.transform("x", lambda v: v * v))
    per_fold = vector_sums(rows.filter("fold >= 0").select("task", "fold", wide.alias("_x")), "_x", ["task", "fold"])
    held = per_fold.withColumn("held", F.explode(F.sequence(F.lit(-1), F.lit(folds - 1)))).filter("fold <> held")
    total = merge_partials(held.select("task", "held", F.col("n").alias("_n"), F.col("total").alias("_s")), ["task", "held"])
    dim = ((F.size("total") - 1) / 2).cast("int")
    mean = F.transform(F.slice("total", F.lit(2), dim), lambda s: s / F.col("n"))
    square = F.transform(F.slice("total", dim + 2, dim), lambda s: s / F.col("n"))
    spread = F.zip_with(square, "mean", lambda s, m: F.when(s - m * m > 1e-12, F.sqrt(s - m * m)).otherwise(1.0))
    return (
        total.withColumn("mean", mean).withColumn("spread", spread)
        .select("task", "held", F.explode(F.array(F.struct(F.lit(-1).alias("at"), F.col("mean").alias("w")),
                                                  F.struct(F.lit(-2).alias("at"), F.col("spread").alias("w")))).alias("_e"))
        .select("task", "held", "_e.*")
    )


def _models(right: pa.Table):
    """(held, mean, deviation, coefficients or None) of a task."""
    held, at, w = right.column("held").to_numpy(), right.column("at").to_numpy(), right.column("w")
    for h in np.unique(held):
        mine = np.flatnonzero(held == h)
        mine = mine[np.argsort(at[mine], kind="stable")]
        parts = [np.array(w[int(i)].as_py()) for i in mine]
        yield int(h), parts[1], parts[0], np.stack(parts[2:]) if len(parts) > 2 else None


def _meet(dealt: DataFrame, models: DataFrame, shares: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel`` on every share of a task's rows with the models of the task."""
    copies = models.join(shares, "task").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    return dealt.groupBy("task", "share").cogroup(copies.groupBy("task", "share")).applyInArrow(kernel, schema)


def task_probe(
    features: DataFrame, tasks: DataFrame, n_draws: int = 100, seeds: Sequence[int] = (0, 1, 2), kernels: Sequence[str] = KERNELS,
    vec: str = "features", folds: int = 5, steps: int = 4, width: int = 64,
) -> DataFrame:
    """(run, task, row_idx, label, pred) of the test rows: per task and run a support vector machine on
    standardised features, its kernel, C and gamma the best of ``n_draws`` by cross-validated accuracy.

    The machines have the squared hinge loss, minimised over all tasks, folds and candidates at once: the first
    step is least squares, and each further one replaces the targets of rows beyond their margin by their
    scores, which leaves the matrix as it is and never raises the loss. Kernels are those of ``Expansion``.
    Equal candidates rank by number; a task without train rows has no result; a null label takes no part.
    """
    draws = search_draws(n_draws, seeds, kernels)
    fold = F.when(F.col("split") == "train", F.floor(seeded_uniform("fold", "row_idx") * folds)).otherwise(-1).cast("int")
    rows = cut_lineage(
        task_tables(features, tasks, vec).filter(F.col("label").isNotNull())
        .select("task", "row_idx", (F.col("label") > 0).cast("int").alias("label"), fold.alias("fold"), "x"))
    first = rows.select(F.size("x").alias("d")).first()
    types = {c: rows.schema[c].dataType.simpleString() for c in ("task", "row_idx")}
    if first is None:
        return rows.sparkSession.createDataFrame([], f"run int, task {types['task']}, row_idx {types['row_idx']}, label int, pred int")
    expand = Expansion(first["d"], width)
    weight, n_models, size = expand.weights(draws), len(draws.c), expand.size
    shares = cut_lineage(rows.groupBy("task").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("shares")))
    share = F.pmod(F.xxhash64("row_idx"), "shares").cast("int")
    dealt = cut_lineage(rows.join(shares, "task").withColumn("share", share).drop("shares").repartition("task", "share"))
    scalers = cut_lineage(_scalers(rows, folds))
    key = f"task {types['task']}, held int"

    def trained(left: pa.Table, right: pa.Table):
        """Features, targets and folds of a share's train rows for every model of the task."""
        fold = left.column("fold").to_numpy()
        x, y = matrix(left.column("x")), 2.0 * left.column("label").to_numpy() - 1
        for held, mean, spread, w in _models(right):
            use = (fold >= 0) & (fold != held)
            if use.any():
                yield held, expand.of((x[use] - mean) / spread), y[use], w

    def sums_table(left: pa.Table, parts: list) -> pa.Table:
        """A row per (fold held out, feature) with sums over a share."""
        task = pa.array([left.column("task")[0].as_py()] * (size * len(parts)), left.schema.field("task").type)
        held = np.repeat(np.array([h for h, _, _ in parts], "i4"), size)
        count = np.repeat(np.array([n for _, n, _ in parts], "i8"), size)
        values = vectors(np.vstack([v for _, _, v in parts]) if parts else np.zeros((0, 1)))
        return pa.table([task, pa.array(held), pa.array(np.tile(np.arange(size, dtype="i4"), len(parts))), pa.array(count), values],
                        ["task", "held", "at", "_n", "_s"])

    def first_sums(left: pa.Table, right: pa.Table) -> pa.Table:
        return sums_table(left, [(h, len(y), np.column_stack([f.T @ f, f.T @ y])) for h, f, y, _ in trained(left, right)])

    def next_sums(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for h, f, y, w in trained(left, right):
            target = y[:, None] * np.maximum(1.0, y[:, None] * (f @ w))
            parts.append((h, len(y), f.T @ target))
        return sums_table(left, parts)

    def solve(grams: pa.Table, sums: pa.Table) -> pa.Table:
        if not grams.num_rows or not sums.num_rows:
            return grams.slice(0, 0).select(["task", "held", "at"]).append_column("w", vectors(np.zeros((0, 1))))
        gram = matrix(grams.column("gram"))[np.argsort(grams.column("at").to_numpy())]
        right = matrix(sums.column("total"))[np.argsort(sums.column("at").to_numpy())]
        w = solve_all(gram, np.broadcast_to(right, (size, n_models)), draws.c, weight)
        ids = grams.select(["task", "held"])
        return pa.table([*ids.columns, pa.array(np.arange(size, dtype="i4")), vectors(w)], ["task", "held", "at", "w"])

    def solved(sums: DataFrame) -> DataFrame:
        met = grams.groupBy("task", "held").cogroup(sums.groupBy("task", "held")).applyInArrow(solve, f"{key}, at int, w array<double>")
        return cut_lineage(scalers.unionByName(met))

    sums_schema = f"{key}, at int, _n bigint, _s array<double>"
    by = ["task", "held", "at"]
    both = cut_lineage(merge_partials(_meet(dealt, scalers, shares, first_sums, sums_schema), by))
    grams = both.select(*by, F.slice("total", 1, size).alias("gram"))
    models = solved(both.select(*by, F.slice("total", size + 1, 1).alias("total")))
    for _ in range(steps - 1):
        models = solved(merge_partials(_meet(dealt, models, shares, next_sums, sums_schema), by))

    def validate(left: pa.Table, right: pa.Table) -> pa.Table:
        fold, x, y = left.column("fold").to_numpy(), matrix(left.column("x")), left.column("label").to_numpy()
        out = []
        for held, mean, spread, w in _models(right):
            use = (fold == held) & (fold >= 0)
            if use.any() and w is not None:
                hits = ((expand.of((x[use] - mean) / spread) @ w > 0) == (y[use] > 0)[:, None]).sum(0)
                out.append((held, int(use.sum()), hits.astype("f8")))
        task = pa.array([left.column("task")[0].as_py()] * len(out), left.schema.field("task").type) if out else left.column("task").slice(0, 0)
        return pa.table([task, pa.array([h for h, _, _ in out], pa.int32()), pa.array([n for _, n, _ in out], pa.int64()),
                         vectors(np.stack([v for _, _, v in out]) if out else np.zeros((0, 1)))], ["task", "held", "_n", "_s"])

    def predict(left: pa.Table, right: pa.Table) -> pa.Table:
        test = left.filter(pa.compute.less(left.column("fold"), 0))
        told = {h: m for h, *m in _models(right)}.get(-1)
        if not test.num_rows or told is None or told[2] is None:
            test, preds = test.slice(0, 0), []
        else:
            preds = (expand.of((matrix(test.column("x")) - told[0]) / told[1]) @ told[2] > 0).astype("i4").tolist()
        return test.select(["task", "row_idx", "label"]).append_column("preds", pa.array(preds, pa.list_(pa.int32())))

    right_of = merge_partials(_meet(dealt.filter("fold >= 0"), models, shares, validate, f"{key}, _n bigint, _s array<double>"), ["task", "held"])
    per_model = right_of.select("task", "n", F.posexplode("total").alias("model", "hits")).groupBy("task", "model").agg(F.avg(F.col("hits") / F.col("n")).alias("score"))
    runs = F.array(*[F.lit(int(r)) for r in draws.run])
    best = per_model.withColumn("run", F.element_at(runs, F.col("model") + 1)).groupBy("task", "run").agg(
        F.max(F.struct(F.round("score", 12).alias("score"), (-F.col("model")).alias("first"))).alias("_b"))
    chosen = best.select("task", "run", (-F.col("_b.first")).alias("model"))
    told = _meet(dealt.filter("fold < 0"), models.filter("held = -1"), shares, predict, f"task {types['task']}, row_idx {types['row_idx']}, label int, preds array<int>")
    return told.join(chosen, "task").select("run", "task", "row_idx", "label", F.element_at("preds", F.col("model") + 1).alias("pred"))


def task_probe_eval(features: DataFrame, tasks: DataFrame, **how) -> DataFrame:
    """(run, n, accuracy, mean, std): accuracy over the test rows of all tasks, a row per run."""
    return run_summary(label_accuracy(cut_lineage(task_probe(features, tasks, **how)), "pred", "label", ["run"]), "accuracy")


# -- many labels -------------------------------------------------------------------------------


def _kept(digests: list[str], dim: int) -> np.ndarray:
    """0/1 per coordinate from hex digests: the bits, highest first."""
    return np.unpackbits(np.frombuffer(bytes.fromhex("".join(digests)), "u1"))[:dim]


def multilabel_probe(
    train: DataFrame, test: DataFrame, n_labels: int, seeds: Sequence[int] = (0, 1, 2), key: str = "id", vec: str = "features",
    labels: str = "labels", ridge: float = 1e-3, steps: int = 20, threshold: float = 0.5,
) -> DataFrame:
    """(run, key, labels, pred): linear logistic models of all labels; a label is predicted when its raw score
    exceeds ``threshold``.

    A layer, dropout and a layer without a nonlinearity between them are one matrix with dropout. Each run
    drops half of a row's coordinates, by bits of a seeded hash of its key, and doubles the others; nothing is
    dropped in the test. The logistic curve is nowhere steeper than a quarter, so a quarter of the matrix of
    products bounds the curvature of every label: it is added up once per run, inverted once, and every step
    adds up gradients of all labels and runs in one pass. Coefficients are runs x features x labels, on the
    driver. Rows with a null vector or null labels take no part; an empty train table predicts nothing.
    """
    runs, good = len(seeds), F.col(vec).isNotNull() & F.col(labels).isNotNull()
    first = train.filter(good).select(F.size(vec).alias("d")).first()
    types = {c: test.schema[c].dataType.simpleString() for c in (key, labels)}
    if first is None:
        return test.sparkSession.createDataFrame([], f"run int, `{key}` {types[key]}, `{labels}` {types[labels]}, pred array<int>")
    dim = first["d"]
    words = range(-(-dim // 128))
    digests = F.array(*[F.array(*[seeded_key(s, F.lit(w), key) for w in words]) for s in seeds])
    rows = cut_lineage(train.filter(good).select(V.as_double(vec).alias("x"), F.col(labels).cast("array<double>").alias("y"), digests.alias("kept")))

    def noisy(batch: pa.RecordBatch) -> list[np.ndarray]:
        """The rows as each run sees them, with a constant in front."""
        x, kept = matrix(batch.column("x")), batch.column("kept").to_pylist()
        one = np.ones((len(x), 1))
        return [np.hstack([one, x * (2.0 * np.stack([_kept(k[r], dim) for k in kept]))]) for r in range(runs)]

    def added(per_batch, width: int) -> np.ndarray:
        """Sums of ``per_batch`` over all rows: (runs, features, width)."""

        def run(batches):
            total, n = np.zeros((runs, dim + 1, width)), 0
            for batch in batches:
                if batch.num_rows:
                    n += batch.num_rows
                    total += per_batch(batch)
            if n:
                at = np.arange(runs * (dim + 1), dtype="i4")
                yield pa.record_batch([pa.array(at), pa.array(np.full(len(at), n)), vectors(total.reshape(len(at), width))], ["at", "_n", "_s"])

        sums = merge_partials(rows.mapInArrow(run, "at int, _n bigint, _s array<double>"), ["at"]).toArrow().sort_by("at")
        return matrix(sums.column("total")).reshape(runs, dim + 1, width)

    gram = added(lambda batch: np.stack([x.T @ x for x in noisy(batch)]), dim + 1)
    n = gram[0, 0, 0]
    step = np.linalg.inv(gram / 4 + ridge * n * np.eye(dim + 1))
    w = np.zeros((runs, dim + 1, n_labels))

    def gradient(batch: pa.RecordBatch) -> np.ndarray:
        y = matrix(batch.column("y"))
        return np.stack([x.T @ (y - 1 / (1 + np.exp(-(x @ w[r])))) for r, x in enumerate(noisy(batch))])

    for _ in range(steps):
        w = w + step @ (added(gradient, n_labels) - ridge * n * w)

    def predict(batches):
        for batch in batches:
            x = np.hstack([np.ones((batch.num_rows, 1)), matrix(batch.column("x")).reshape(batch.num_rows, -1)]) if batch.num_rows else np.zeros((0, dim + 1))
            told = [(np.round(x @ w[r], 9) > threshold).astype("i4").tolist() for r in range(runs)]
            preds = pa.array([[t[i] for t in told] for i in range(batch.num_rows)], pa.list_(pa.list_(pa.int32())))
            yield pa.record_batch([batch.column(key), batch.column(labels), preds], [key, labels, "preds"])

    scored = test.filter(good).select(key, labels, V.as_double(vec).alias("x")).mapInArrow(predict, f"`{key}` {types[key]}, `{labels}` {types[labels]}, preds array<array<int>>")
    return scored.select(F.posexplode("preds").alias("run", "pred"), key, labels).select("run", key, labels, "pred")


def multilabel_eval(train: DataFrame, test: DataFrame, n_labels: int, **how) -> DataFrame:
    """(run, n, exact, macro_f1) and, of each score, mean and population deviation over the runs."""
    told = cut_lineage(multilabel_probe(train, test, n_labels, **how))
    labels = how.get("labels", "labels")
    exact = label_accuracy(told, "pred", labels, ["run"]).withColumnRenamed("accuracy", "exact")
    scores = exact.join(macro_f1(told, "pred", labels, by=["run"]), "run").withColumn("_k", F.lit(0))
    spread = scores.groupBy("_k").agg(*[f(c).alias(f"{c}_{name}") for c in ("exact", "macro_f1") for name, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return scores.join(spread, "_k").drop("_k", "n_labels")
