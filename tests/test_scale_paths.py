"""The ways that only large inputs take must give what the short ways give."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from speciframe.operators import clustering as C
from speciframe.operators import losses, ranking, retrieval, samples, sampling, scoring
from speciframe.operators.aggregates import class_centroids
from speciframe.plans import few_shot


def collected(df, *order):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_grid_equals_shipped(spark, points, metric, monkeypatch):
    monkeypatch.setattr(scoring, "CELL_ROWS", 70)
    how = dict(vec="v", proto_vec="v", label="id", k=4, metric=metric, truth="id", keep=["id"], scale=3.0)
    near = scoring.match_prototypes(points, points, **how)
    grid = scoring.match_prototypes(points, points, ship_limit=0, **how)
    short = {r["id"]: r for r in near.collect()}
    wide = {r["id"]: r for r in grid.collect()}
    assert short.keys() == wide.keys() and len(wide) == 300
    for key, row in short.items():
        other = wide[key]
        assert [h["label"] for h in row["hits"]] == [h["label"] for h in other["hits"]]
        assert np.allclose([h["score"] for h in row["hits"]], [h["score"] for h in other["hits"]], atol=1e-6)
        assert row["n_better"] == other["n_better"]
        assert abs(row["own_score"] - other["own_score"]) < 1e-6


def test_grid_with_groups_and_means(spark, points, monkeypatch):
    monkeypatch.setattr(scoring, "CELL_ROWS", 50)
    rows = points.withColumn("g", F.explode(F.array(F.lit(0), F.lit(1))))
    protos = class_centroids(points, "v", "label").withColumn("g", F.explode(F.array(F.lit(0), F.lit(1))))
    means = {(0,): np.zeros(6), (1,): np.arange(6.0)}
    how = dict(vec="v", proto_vec="centroid", label="label", group=["g"], metric="dot", keep=["id"], means=means)
    short = scoring.nearest_prototype(rows, protos, **how).select("id", "g", "pred")
    wide = scoring.match_prototypes(rows, protos, ship_limit=0, **how).select("id", "g", F.col("hits")[0]["label"])
    assert collected(short) == collected(wide)


def test_hits_against_brute_force(spark, points):
    local = {r["id"]: np.array(r["v"]) for r in points.collect()}
    near = scoring.match_prototypes(points, points, vec="v", proto_vec="v", label="id", k=12, metric="l2", keep=["id"])
    for row in near.collect():
        want = sorted((round(((local[row["id"]] - w) ** 2).sum(), 9), i) for i, w in local.items())[:12]
        assert [h["label"] for h in row["hits"]] == [i for _, i in want]


@pytest.mark.parametrize("digits,far", [(1, 0.0), (9, 0.0), (9, 1e6)])
def test_product_first_gives_the_neighbours_of_all_pairs(digits, far, monkeypatch):
    from speciframe.operators import dense

    rng = np.random.default_rng(3)
    w = rng.normal(size=(900, 5)).round(digits) + far
    w[300:600] = w[7]
    x, labels = np.concatenate([w[::3], w[:9] + 0.1]), np.sort(rng.permutation(3000)[:900])
    truth = np.arange(len(x)) * 2 % 900
    own = dense.own_closeness(x, w[truth], "dot")
    every = dense.closeness(x, w, "l2")
    order = np.argsort(-every, axis=1, kind="stable")[:, :4]
    monkeypatch.setattr(dense, "WIDE", 128)
    told, pairs = dense.closeness, []
    monkeypatch.setattr(dense, "closeness", lambda x, w, metric: pairs.append(len(x) * len(w)) or told(x, w, metric))
    top_l, top_s, _ = dense.best_hits(x, labels, w, 4, "l2")
    assert (top_l == labels[order]).all() and (top_s == np.take_along_axis(every, order, 1)).all()
    assert digits == 1 or sum(pairs) < x.shape[0] * w.shape[0] / 2
    score = told(x, w, "dot")
    before = (score > own[:, None]) | ((score == own[:, None]) & (labels[None, :] < labels[truth][:, None]))
    want = (before & (labels[None, :] != labels[truth][:, None])).sum(axis=1)
    assert (dense.best_hits(x, labels, w, 0, "dot", own, labels[truth])[2] == want).all()


def test_ranks_on_the_grid_need_no_hits(spark, points, monkeypatch):
    monkeypatch.setattr(scoring, "CELL_ROWS", 70)
    pairs = points.select("id", F.col("v").alias("image"), F.transform("v", lambda x: x + 0.5).alias("text"))
    short = retrieval.match_rank(pairs, "image", "text")
    assert collected(short) == collected(retrieval.match_rank(pairs, "image", "text", ship_limit=0)) and short.count() == 300


def test_ties_go_to_the_smaller_label(spark, points):
    near = scoring.match_prototypes(points.filter("id = 7"), points, vec="v", proto_vec="v", label="id", k=2, metric="l2", keep=["id"])
    assert [h["label"] for h in near.first()["hits"]] == [5, 7]


def test_center_table_rounds_equal_shipped_rounds(spark, points):
    start = C.first_k(points, "v", "id", 4)
    best, inertia, rounds = C.lloyd(points, start, "v", "id", 5, 0.0)
    table, inertia2, rounds2 = C.lloyd(points, start, "v", "id", 5, 0.0, ship_limit=0)
    assert rounds == rounds2 == 5 and abs(inertia - inertia2) < 1e-6
    got = np.array([r["center"] for r in table.orderBy("cluster").collect()])
    assert np.allclose(got, best[()][1], atol=1e-9)


def test_seeds_from_table_equal_shipped(spark, points):
    shipped = C.d2_seeds(points, "v", "id", 4, 3)
    table = C.d2_seeds(points, "v", "id", 4, 3, ship_limit=0)
    got = np.array([r["center"] for r in table.orderBy("cluster").collect()])
    assert np.allclose(got, shipped[()][1])


def brute_force_best(weight):
    n, m = weight.shape
    size = max(n, m)
    padded = np.zeros((size, size))
    padded[:n, :m] = weight
    return max(sum(padded[i, p[i]] for i in range(size)) for p in itertools.permutations(range(size)))


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_assignment_is_optimal(spark, seed):
    rng = np.random.default_rng(seed)
    shape = [(6, 6), (4, 6), (6, 3), (5, 5)][seed]
    weight = rng.integers(0, 9, shape)
    cells = [("s", int(i), int(j), int(weight[i, j])) for i, j in zip(*np.nonzero(weight))]
    counts = spark.createDataFrame(cells, "part string, p int, t int, n bigint")
    value = {(i, j): n for _, i, j, n in cells}
    pairs = [(r["p"], r["t"]) for r in C.best_mapping(counts, "p", "t", ["part"]).collect()]
    assert len({p for p, _ in pairs}) == len(pairs) == len({t for _, t in pairs})
    assert sum(value.get(x, 0) for x in pairs) == brute_force_best(weight)


def test_assignment_of_5000_clusters_with_large_counts():
    import time

    rng = np.random.default_rng(11)
    n = 5_000
    hidden = rng.permutation(n)
    # each cluster mostly one class, with strays of every size, and some clusters that want the same class
    own = np.where(rng.random(n) < 0.8, hidden, rng.integers(0, n, n))
    i = np.concatenate([np.arange(n), rng.integers(0, n, 40_000)])
    j = np.concatenate([own, rng.integers(0, n, 40_000)])
    keep = np.unique(i * n + j, return_index=True)[1]
    i, j = i[keep], j[keep]
    gain = rng.integers(1, 10**9, len(i))
    start = time.time()
    found = C.assignment(i, j, gain)
    assert time.time() - start < 120 and len(set(found.values())) == len(found)
    value = dict(zip(zip(i.tolist(), j.tolist()), gain.tolist()))
    total = sum(value[x] for x in found.items())
    # no change along a cycle or chain of up to three clusters is better
    by_class = {c: p for p, c in found.items()}
    for (p, c), v in value.items():
        if found.get(p) != c:
            other = by_class.get(c)
            lost = value.get((p, found.get(p)), 0) + (value[other, c] if other is not None else 0)
            back = value.get((other, found.get(p)), 0) if other is not None else 0
            assert v + back <= lost
    assert total > 0.7 * gain[:n].sum() / 2


def test_assignment_beyond_one_billion_against_all_permutations():
    rng = np.random.default_rng(2)
    for _ in range(20):
        weight = rng.integers(0, 10**9, (5, 5)) * (rng.random((5, 5)) < 0.7)
        i, j = np.nonzero(weight)
        found = C.assignment(i, j, weight[i, j])
        assert sum(int(weight[p, t]) for p, t in found.items()) == brute_force_best(weight)


def test_cluster_accuracy_counts_rows_without_cluster(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (None, 6), (3, None)], "c int, y int")
    assert tuple(C.cluster_accuracy(df, "c", "y").first()) == (5, 2, 0.4)
    assert C.cluster_accuracy(df.filter("c > 9"), "c", "y").collect() == []


def greedy(members):
    """[(url, no, key, suffix)] -> sample start position of each, one after the other."""
    out, last, seen, start = [], None, set(), 0
    for place, (url, _, key, suffix) in enumerate(members):
        if (url, key) != last or suffix in seen:
            last, seen, start = (url, key), set(), place
        seen.add(suffix)
        out.append(start)
    return out


@pytest.mark.parametrize("limit,chunk", [(512, 1 << 16), (3, 16), (0, 7)])
def test_samples_of_long_runs(spark, monkeypatch, limit, chunk):
    monkeypatch.setattr(samples, "_CHUNK", chunk)
    rng = np.random.default_rng(2)
    rows, key = [], 0
    for url in ("a.tar", "b.tar", "c.tar"):
        n = 400 if url == "b.tar" else 30
        for no in range(n):
            # One key holds most of the second shard.
            if url != "b.tar" and rng.random() < 0.4 or no in (10, 390):
                key += 1
            rows.append((url, no, f"k{key}.{'abcde'[int(rng.integers(0, 5)) if no % 50 else 0]}"))
    members = spark.createDataFrame(rows, "url string, member_no bigint, fname string").repartition(6)
    marked = samples.mark_samples(members, run_limit=limit).orderBy("url", "member_no").collect()
    want = greedy([(u, n, *f.split(".")) for u, n, f in rows])
    assert [r["sample"] for r in marked] == want


def test_suffix_filter_and_names_without_suffix(spark):
    rows = [("u", 0, "x/1.JPG"), ("u", 1, "x/1.txt"), ("u", 2, "noext"), ("u", 3, "x/1.log"), ("u", 4, "x/1.log"), ("u", 5, "x/1.jpg")]
    members = spark.createDataFrame(rows, "url string, member_no bigint, fname string").withColumn("d", F.col("member_no"))
    grouped = samples.group_samples(members, "d", suffixes=["jpg", "txt"])
    got = sorted((r["key"], r["sample"], dict(r["parts"])) for r in grouped.collect())
    assert got == [("x/1", 0, {"jpg": 0, "txt": 1}), ("x/1", 4, {"jpg": 5})]


def test_blocks_of_a_large_batch(spark, points):
    other = points.select((F.col("id") - 1).alias("id"), F.col("v").alias("t"))
    pairs = points.join(other, "id").withColumn("b", F.when(F.col("id") < 20, 1).otherwise(0))
    how = dict(batch=["b"], image="v", text="t", scale=0.3, bias=0.2, teacher=("t", "v", 0.1))
    whole = {(r["side"], r["id"]): r for r in losses.in_batch_rows(pairs, **how).collect()}
    cut = {(r["side"], r["id"]): r for r in losses.in_batch_rows(pairs, cell_rows=40, **how).collect()}
    assert whole.keys() == cut.keys()
    for key, row in whole.items():
        for name in ("own", "top", "lse", "pos_loss", "neg_loss", "cross_entropy"):
            assert abs(row[name] - cut[key][name]) < 1e-8, (key, name)


def test_match_rank_in_blocks(spark, points, monkeypatch):
    monkeypatch.setattr(scoring, "CELL_ROWS", 64)
    other = points.select((F.col("id") - 1).alias("id"), F.col("v").alias("t"))
    pairs = points.join(other, "id")
    assert collected(retrieval.match_rank(pairs, "v", "t")) == collected(retrieval.match_rank(pairs, "v", "t", ship_limit=0))


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_order_does_not_depend_on_partitions(spark, parts):
    df = spark.range(2000).repartition(parts)
    ranks = ranking.rank_by_hash(df, 3, ["id"]).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(2000))
    base = ranking.rank_by_hash(spark.range(2000), 3, ["id"]).orderBy("rank").collect()
    assert [r["id"] for r in ranks] == [r["id"] for r in base]
    index = ranking.row_index(df.withColumn("back", -F.col("id")), ["back"], "i").collect()
    assert all(r["i"] == 1999 - r["id"] for r in index)
    equal = ranking.row_index(df.withColumn("third", F.when(F.col("id") % 3 > 0, F.col("id") % 3)), ["third"], "i").orderBy("i").collect()
    assert [r["i"] for r in equal] == list(range(2000)) and [r["third"] for r in equal] == [None] * 667 + [1] * 667 + [2] * 666


def test_numbering_over_many_levels_of_buckets(spark, monkeypatch):
    plain = [r["id"] for r in ranking.rank_by_hash(spark.range(3000), 5, ["id"]).orderBy("rank").collect()]
    for rows in (200, 10, 1):  # two, three and four digits
        monkeypatch.setattr(ranking, "BUCKET_ROWS", rows)
        assert [(r["rank"], r["id"]) for r in ranking.rank_by_hash(spark.range(3000), 5, ["id"]).orderBy("rank").collect()] == list(enumerate(plain))
    monkeypatch.setattr(ranking, "FEW", 3)
    for p in (0.0001, 0.25, 0.6181, 1.0):
        kept = ranking.exact_fraction(spark.range(3000), p, 5, ["id"]).collect()
        assert {r["id"] for r in kept} == set(plain[: int(p * 3000)])
    repeated = spark.range(3000).withColumn("g", F.col("id") % 4)
    assert ranking.exact_fraction(repeated, 0.4, 5, ["g"]).count() == 1200


def test_running_sum(spark):
    df = spark.range(1000).repartition(7).withColumn("w", F.col("id") % 5)
    rows = {r["id"]: (r["lo"], r["hi"]) for r in ranking.running_sum(df, ["id"], "w").collect()}
    total = 0
    for i in range(1000):
        assert rows[i] == (total, total + i % 5)
        total += i % 5


def test_exact_fraction_sizes(spark):
    for n, p in ((0, 0.5), (1, 0.9), (999, 0.333), (5000, 0.8), (10, 1.0)):
        assert ranking.exact_fraction(spark.range(n), p, 1, ["id"]).distinct().count() == int(p * n)


def test_resample_follows_weights(spark):
    shards = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 6.0), ("d", 3.0)], "url string, w double")
    drawn = sampling.weighted_resample(spark, shards, 4000, 1, 0, "w", ["url"])
    counts = {r["url"]: r["count"] for r in drawn.groupBy("url").count().collect()}
    assert sum(counts.values()) == 4000 and "b" not in counts
    spread = sampling.weighted_resample(spark, shards.withColumn("w", F.when(F.col("url") == "c", 990.0).otherwise(F.col("w"))), 4000, 1, 0, "w", ["url"])
    assert {r["draw"] for r in spread.collect()} == set(range(4000))
    assert abs(counts["c"] - 2400) < 150 and abs(counts["d"] - 1200) < 150


def test_hot_class_keeps_all_rows(spark):
    df = spark.range(3000).withColumn("c", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50))
    split = sampling.kshot_split(df, [1, 5], [0, 1], "c", "id")
    assert split.count() == 3000 * 4
    train = split.filter("role = 'train' AND k = 5").groupBy("fold", "c").count()
    assert {r["count"] for r in train.collect()} == {5}


@pytest.mark.parametrize("k", [1, 40, 700])
def test_large_k_per_class(spark, k):
    df = spark.range(3000).withColumn("c", F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 7)).repartition(6)
    short = sampling.first_per_class(df, k, 4, ["c"], "id")
    spread = sampling.first_per_class(df, k, 4, ["c"], "id", window_limit=0)
    assert collected(short) == collected(spread)


def test_rank_summary(spark):
    rng = np.random.default_rng(0)
    ranks = {n: rng.integers(0, 20, n) for n in (1, 2, 7, 100)}
    df = spark.createDataFrame([(n, int(r)) for n, rs in ranks.items() for r in rs], "g int, r bigint")
    got = {r["g"]: r for r in retrieval.rank_summary(df, "r", "g").collect()}
    assert got.keys() == ranks.keys()
    for n, rs in ranks.items():
        assert abs(got[n]["mean_rank"] - (rs.mean() + 1)) < 1e-9
        assert got[n]["median_rank"] == np.floor(np.median(rs)) + 1
        assert abs(got[n]["r_at_5"] - (rs < 5).mean()) < 1e-12


def test_few_shot_by_configuration(spark, points, monkeypatch):
    monkeypatch.setattr(scoring, "CELL_ROWS", 100)
    table = points.select("id", F.col("v").alias("features"), F.col("label").alias("target"))
    how = dict(ks=(1, 5), folds=2)
    short = {(r["k"], r["fold"]): (r["n"], round(r["accuracy"], 9)) for r in few_shot.few_shot_accuracy(table, **how).collect()}
    wide = {(r["k"], r["fold"]): (r["n"], round(r["accuracy"], 9)) for r in few_shot.few_shot_accuracy(table, ship_limit=0, **how).collect()}
    assert short == wide and len(short) == 4


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_samples_without_a_match_stay(spark, limit):
    """A group without prototypes and a null vector give empty hits on the shipped path and on the grid."""
    samples = spark.createDataFrame([(1, 0, [1.0, 0.0], 3), (2, 1, [0.0, 1.0], 3), (3, 0, None, 3)], "id long, g int, v array<double>, y long")
    protos = spark.createDataFrame([(0, 3, [1.0, 0.0]), (0, 4, [0.0, 1.0])], "g int, label long, w array<double>")
    for truth in (None, "y"):
        found = scoring.match_prototypes(
            samples, protos, vec="v", proto_vec="w", label="label", group=["g"], truth=truth, ship_limit=limit).collect()
        assert {r["id"]: [h["label"] for h in r["hits"]] for r in found} == {1: [3], 2: [], 3: []}
        if truth:
            assert {r["id"]: r["n_better"] for r in found} == {1: 0, 2: None, 3: None}
    assert scoring.nearest_prototype(
        samples, protos.limit(0), vec="v", proto_vec="w", label="label", group=["g"], ship_limit=limit).filter("pred IS NULL").count() == 3
