"""Evaluation and clustering behave as they should on small made-up points."""

import numpy as np
from pyspark.sql import functions as F

from speciframe.operators import clustering as C
from speciframe.operators import metrics
from speciframe.plans import discovery, few_shot, probes, zero_shot


def blobs(spark):
    rng = np.random.default_rng(1)
    centres = [(-8.0, -8.0), (8.0, 8.0), (-8.0, 8.0), (8.0, -8.0)]
    rows = [(i, [float(x) for x in rng.normal(centres[i % 4], 1.0)], i % 4) for i in range(500)]
    return spark.createDataFrame(rows, "id bigint, features array<double>, target int")


def test_kmeans_finds_blobs(spark):
    points = blobs(spark)
    for init in ("k-means++", "random"):
        fitted = C.kmeans(points, "features", "id", 4, init=init, n_init=3, max_iterations=20, seed=2)
        scored = points.join(fitted.labels(), "id")
        accuracy = C.cluster_accuracy(scored, "cluster", "target").first()["accuracy"]
        purity = metrics.cluster_purity(scored, "cluster", "target").first()["purity"]
        assert accuracy <= purity + 1e-12
        if init == "k-means++":
            assert accuracy >= 0.95


def test_inertia_falls(spark):
    points = blobs(spark)
    start = C.first_k(points, "features", "id", 4)
    seen = [C.lloyd(points, start, "features", "id", n, 0.0)[1] for n in (1, 2, 4)]
    assert seen[0] >= seen[1] >= seen[2]


def test_empty_cluster_keeps_its_centre(spark):
    points = blobs(spark)
    centers = {(): (np.array([0, 1]), np.array([[0.0, 0.0], [1e6, 1e6]]))}
    moved, _, _ = C.lloyd_round(points, centers, "features")
    assert moved[()][1][1].tolist() == [1e6, 1e6]


def test_pinned_rows_never_move(spark):
    # Labels contrary to the geometry stay where they are put.
    points = blobs(spark).withColumn("label", F.when(F.col("id") < 100, 10 + (F.col("id") % 2)))
    fitted = C.semi_kmeans(points, "features", "id", "label", 4, max_iterations=5, n_init=1)
    got = {r["id"]: r["cluster"] for r in fitted.labels().filter("id < 100").collect()}
    assert got == {i: i % 2 for i in range(100)}


def test_category_discovery_on_blobs(spark):
    out = discovery.category_discovery(blobs(spark), [0, 1], 0.8, seeds=(0, 5)).collect()
    assert [r["run"] for r in sorted(out)] == [0, 1]
    for r in out:
        assert r["n_rows"] == 500 - int(0.8 * 250) and min(r["accuracy"], r["old_accuracy"], r["new_accuracy"]) >= 0.95
    assert abs(out[0]["mean"] - np.mean([r["accuracy"] for r in out])) < 1e-12


def test_runs_together_equal_runs_alone(spark, points):
    rows = points.withColumnRenamed("v", "features").withColumn("known", F.when((F.col("label") < 2) & (F.col("id") % 2 == 0), F.col("label")))
    together = C.semi_kmeans_runs(rows, "features", "id", "known", 5, [3, 8, 9], max_iterations=6, tolerance=0.0)
    told = {}
    for r in C.label_runs(together).collect():
        told.setdefault(r["run"], {})[r["id"]] = r["cluster"]
    for run, seed in enumerate([3, 8, 9]):
        alone = C.semi_kmeans_runs(rows, "features", "id", "known", 5, [seed], max_iterations=6, tolerance=0.0)[0]
        assert abs(alone.inertia - together[run].inertia) < 1e-9
        assert {r["id"]: r["cluster"] for r in alone.labels().collect()} == told[run]


def test_share_picks_at_any_depth(spark, monkeypatch):
    import hashlib

    weights = {i: float((i * 37) % 11) for i in range(400)}
    df = spark.createDataFrame([(i, w) for i, w in weights.items()], "id bigint, sq double")
    for few in (1, 20, 4096):
        monkeypatch.setattr(C, "FEW", few)
        for share in (0.0, 0.3, 0.999999, 1.0):
            order = sorted(weights, key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
            upto = np.cumsum([weights[i] for i in order])
            want = order[int(np.searchsorted(upto, share * upto[-1]))]
            assert C.d2_pick(df, "id", "sq", share, 7).select("id").collect() == [(want,)]
    assert C.d2_pick(df.filter("id < 0"), "id", "sq", 0.5, 7).collect() == []


def test_few_shot_on_blobs(spark):
    points = blobs(spark)
    got = few_shot.few_shot_eval(points, ks=(1, 5), folds=3).collect()
    assert all(r["mean"] > 0.9 for r in got)


def reference_few_shot(rows, k, fold):
    """The same evaluation in plain numpy."""
    import hashlib

    def place(r):
        return hashlib.md5(f"{fold}:{r[0]}".encode()).hexdigest(), r[0]

    train, test = [], []
    for c in sorted({r[2] for r in rows}):
        mine = sorted((r for r in rows if r[2] == c), key=place)
        train += mine[:k]
        test += mine[k:]
    x = np.array([r[1] for r in train])
    mean = x.mean(axis=0)
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    x, y = unit(x - mean), np.array([r[2] for r in train])
    t, z = unit(np.array([r[1] for r in test]) - mean), np.array([r[2] for r in test])
    labels = np.unique(y)
    centres = np.array([x[y == c].mean(axis=0) for c in labels])
    pred = labels[np.linalg.norm(t[:, None] - centres, axis=2).argmin(axis=1)]
    return len(test), float((pred == z).mean())


def test_few_shot_against_numpy(spark, points):
    rows = [(r["id"], r["v"], r["label"]) for r in points.collect()]
    table = points.select("id", F.col("v").alias("features"), F.col("label").alias("target"))
    for r in few_shot.few_shot_accuracy(table, ks=(1, 5), folds=3).collect():
        n, accuracy = reference_few_shot(rows, r["k"], r["fold"])
        assert r["n"] == n and abs(r["accuracy"] - accuracy) < 1e-12


def test_top_k_grows_with_k(spark, points):
    table = points.select("id", F.col("v").alias("features"), F.col("label").alias("target"))
    protos = zero_shot.ensemble_prototypes(table, "target", "features").withColumnRenamed("target", "class_idx")
    r = zero_shot.zero_shot_eval(table, protos).first()
    assert r["top1"] <= r["top3"] <= r["top5"] == 1.0
    # A class without prototype is never right.
    r = zero_shot.zero_shot_eval(table, protos.filter("class_idx > 0"), ks=[4]).first()
    assert abs(r["top4"] - table.filter("target > 0").count() / r["n"]) < 1e-12


def probe_rows(n=240, dim=5):
    """Three tasks: a line, a ring and a product of signs; a row may serve two."""
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (n, dim))
    labels = {"line": x[:, 0] + 0.3 * x[:, 1] > 0, "ring": (x[:, :2] ** 2).sum(1) > 1.4, "signs": x[:, 0] * x[:, 1] * x[:, 2] > 0}
    rows = [(t, i, int(y[i]), "test" if i % 4 == 0 else "train") for t, y in labels.items() for i in range(n) if (i + len(t)) % 5]
    return x, rows


def reference_probe(x, rows, n_draws, seeds, folds, steps, width):
    """One machine after the other."""
    import hashlib

    def fold_of(i):
        return int(int(hashlib.md5(f"fold:{i}".encode()).hexdigest()[:8], 16) / 2**32 * folds)

    draws, out = probes.search_draws(n_draws, seeds), {}
    expand = probes.Expansion(x.shape[1], width)
    weight = expand.weights(draws)

    def fit(f, y, m):
        s, c = weight[m], draws.c[m]
        on = s > 0
        a = (f * s)[:, on]
        ridge = np.eye(on.sum())
        ridge[0, 0] = 1e-9
        target = y.copy()
        for _ in range(steps):
            v = np.linalg.solve(2 * c * a.T @ a + ridge, 2 * c * a.T @ target)
            target = y * np.maximum(1, y * (a @ v))
        return lambda g: (g * s)[:, on] @ v

    for task in sorted({r[0] for r in rows}):
        ids = {split: [r for r in rows if r[0] == task and r[3] == split] for split in ("train", "test")}
        mean = x[[r[1] for r in ids["train"]]].mean(0)
        cut = lambda part: ((x[[r[1] for r in part]] - mean) / np.linalg.norm(x[[r[1] for r in part]] - mean, axis=1)[:, None], np.array([2.0 * r[2] - 1 for r in part]))

        def machine(train, test, m):
            (z, y), (t, _) = cut(train), cut(test)
            centre, spread = z.mean(0), z.std(0)
            return fit(expand.of((z - centre) / spread), y, m)(expand.of((t - centre) / spread)) > 0

        scores = np.zeros(len(draws.c))
        for h in range(folds):
            inner = [r for r in ids["train"] if fold_of(r[1]) != h]
            held = [r for r in ids["train"] if fold_of(r[1]) == h]
            for m in range(len(scores)):
                scores[m] += np.mean(machine(inner, held, m) == np.array([r[2] == 1 for r in held])) / folds
        for run in range(len(seeds)):
            mine = np.flatnonzero(draws.run == run)
            best = mine[np.argmax(np.round(scores[mine], 12))]
            for r, p in zip(ids["test"], machine(ids["train"], ids["test"], best)):
                out[run, task, r[1]] = (r[2], int(p))
    return out


def test_probe_against_one_machine_after_the_other(spark, monkeypatch):
    x, rows = probe_rows()
    features = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "row_idx bigint, features array<double>")
    tasks = spark.createDataFrame(rows, "task string, row_idx bigint, label int, split string").repartition(5)
    how = dict(n_draws=9, seeds=(1, 4), folds=3, steps=3, width=8)
    want = reference_probe(x, rows, **how)
    for group in (8192, 50):  # a task in one share, and in several
        monkeypatch.setattr(probes, "GROUP", group)
        got = {(r["run"], r["task"], r["row_idx"]): (r["label"], r["pred"]) for r in probes.task_probe(features, tasks, **how).collect()}
        assert got == want


def test_probe_search_separates_lines_and_rings(spark):
    x, rows = probe_rows(600)
    features = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "row_idx bigint, features array<double>")
    tasks = spark.createDataFrame([r for r in rows if r[0] == "line"], "task string, row_idx bigint, label int, split string")
    out = probes.task_probe_eval(features, tasks, n_draws=20, seeds=(0, 1)).collect()
    assert len(out) == 2 and all(r["accuracy"] > 0.9 for r in out) and out[0]["std"] == out[1]["std"]


def test_probe_without_rows(spark):
    features = spark.createDataFrame([], "row_idx bigint, features array<double>")
    tasks = spark.createDataFrame([], "task string, row_idx bigint, label int, split string")
    assert probes.task_probe(features, tasks, n_draws=2).collect() == []


def test_expansion_estimates_the_kernels():
    rng = np.random.default_rng(3)
    z = rng.normal(0, 1, (40, 24))
    expand = probes.Expansion(24, 40_000)
    f, dots = expand.of(z), z @ z.T
    draws = probes.Draws(np.zeros(4, int), np.array(probes.KERNELS), np.ones(4), np.full(4, 8e-4))
    want = {"linear": dots, "sigmoid": np.tanh(8e-4 * dots), "poly": (8e-4 * dots) ** 3,
            "rbf": np.exp(-8e-4 * ((z[:, None] - z[None]) ** 2).sum(2))}
    for kernel, s in zip(draws.kernel, expand.weights(draws)):
        s[0] = 1.0 * (kernel == "rbf") * np.exp(-8e-4 * 24)  # the constant term, which the machines leave free
        got = (f * s) @ (f * s).T
        assert np.abs(got - want[kernel]).max() < 0.06 * np.abs(want[kernel]).max()


def test_steps_lower_the_squared_hinge_loss():
    rng = np.random.default_rng(8)
    f = np.hstack([np.ones((150, 1)), rng.normal(0, 1, (150, 6))])
    y = np.sign(f[:, 1] + 0.4 * rng.normal(0, 1, 150))
    one = np.ones((1, 7))
    target, seen = y.copy(), []
    for _ in range(12):
        w = probes.solve_all(f.T @ f, (f.T @ target)[:, None], np.array([0.7]), one)[:, 0]
        seen.append((w[1:] ** 2).sum() / 2 + 0.7 * (np.maximum(0, 1 - y * (f @ w)) ** 2).sum())
        target = y * np.maximum(1, y * (f @ w))
    assert all(a >= b - 1e-9 for a, b in zip(seen, seen[1:])) and seen[-2] - seen[-1] < 0.05 * (seen[0] - seen[1])


def test_multilabel_probe_finds_two_labels(spark):
    sides = F.array((F.col("target") % 2), F.col("target").isin(1, 2).cast("int"))
    points = blobs(spark).withColumn("labels", sides).withColumn("half", F.floor(F.col("id") / 4) % 2)
    out = probes.multilabel_eval(points.filter("half = 0"), points.filter("half = 1"), 2, seeds=(0, 1)).collect()
    assert all(r["n"] == 248 and r["macro_f1"] > 0.95 and r["exact"] > 0.95 for r in out)


def test_multilabel_probe_without_train_rows(spark):
    points = blobs(spark).withColumn("labels", F.array(F.lit(1)))
    assert probes.multilabel_probe(points.filter("id < 0"), points, 1).collect() == []
