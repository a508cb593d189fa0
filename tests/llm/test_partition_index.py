"""Nearest neighbours against brute force: recall, exact scores and ties, large groups, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from speciframe.llm import catalog, partition_index as index

SCHEMA = "vec_id long, embedding array<float>, label int, part int, block int, kind int, vector string, score double"


def written(spark, rows, tmp_path):
    spark.createDataFrame([(i, v, 0, 1, 2, 3, "v", 0.5) for i, v in rows], SCHEMA).repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def answers(spark, rows, tmp_path):
    df = catalog.QUERIES["op11_partition_index"](spark, written(spark, rows, tmp_path))
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def brute(rows, query, vector, k=10):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], "f4").astype("f8")
    apart = np.sqrt(np.cumsum((v - np.array(vector, "f4").astype("f8")) ** 2, axis=1)[:, -1])
    order = [j for j in np.lexsort((ids, apart)) if ids[j] != query][:k]
    return [(int(ids[j]), float(apart[j])) for j in order]


def test_recall_over_learned_partitions(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (30, 24))
    points = (centres[rng.integers(0, 30, 6_000)] + rng.normal(0, 0.35, (6_000, 24))).astype("f4")
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    got = answers(spark, rows, tmp_path)
    assert sorted(got) == list(range(0, 6_000, 100))
    hits = 0
    for query, found in got.items():
        want = brute(rows, query, rows[query][1])
        assert len(found) == 10 and found == sorted(found, key=lambda r: (r[1], r[0]))
        hits += len({i for i, _ in found} & {i for i, _ in want})
        known = dict(brute(rows, query, rows[query][1], k=len(rows)))
        assert all(known[i] == s for i, s in found)
    assert hits / (10 * len(got)) >= 0.9


def test_partitions_are_balanced_keep_neighbours_and_are_not_all_visited(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (40, 16))
    points = centres[rng.integers(0, 40, 8_000)] + rng.normal(0, 0.1, (8_000, 16))
    made = index.fit(spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, vector array<double>"))
    assert len(made.sizes) == 7 and sum(made.sizes) == 8_000 and made.recall >= index.RECALL
    assert made.probes <= 3 and max(made.sizes) < 3 * 8_000 / 7


def test_refined_partitions_cut_fewer_links_and_stay_even():
    rng = np.random.default_rng(1)
    rows = rng.normal(0, 1, (20, 8))[rng.integers(0, 20, 2_000)] + rng.normal(0, 0.2, (2_000, 8))
    links = index.neighbours(rows, rows, np.arange(2_000), 8)
    first = index.halves(rows, 6)
    better = index.refine(first, links, 6)
    kept = [np.mean(label[links] == label[:, None]) for label in (first, better)]
    assert kept[1] > kept[0] and max(np.bincount(better)) <= np.ceil(2_000 / 6 * 1.05) and min(np.bincount(first)) >= 333


@pytest.mark.parametrize("block", [64, 8_192])
def test_copies_of_one_vector_and_ties(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(index, "BLOCK", block)
    rng = np.random.default_rng(9)
    same = [0.5, -0.25, 1.0, 0.0]
    rows = [(i, same) for i in range(0, 900)] + [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 4)]) for i in range(900, 1_000)]
    got = answers(spark, rows, tmp_path)
    assert got == {q: brute(rows, q, rows[q][1]) for q in range(0, 1_000, 100)}
    assert got[300] == [(i, 0.0) for i in range(10)] and got[0][0] == (1, 0.0)


def test_near_copies_far_from_the_origin_keep_their_order(spark, tmp_path):
    rows = [(i, [float(np.float32(4096.0 + i / 2048)), 1.0]) for i in range(40)]
    assert answers(spark, rows, tmp_path) == {0: brute(rows, 0, rows[0][1])}


def test_odd_vectors_take_no_part(spark, tmp_path):
    bad = [(100, None), (200, []), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [1.0, float("nan")]), (600, [float("inf"), 1.0]), (700, [1.0, 2.0, 3.0])]
    good = [(0, [1.0, 0.0]), (900, [0.0, 1.0]), (901, [1.0, 0.0]), (902, [-1.0, 0.0]), (902, [-1.0, 0.0]), (-100, [3.0, 4.0])]
    got = answers(spark, bad + good + [(None, [1.0, 1.0])], tmp_path)
    assert got == {q: brute(good, q, dict(good)[q]) for q in (0, 900, -100)}


def test_one_row_and_no_rows(spark, tmp_path):
    assert answers(spark, [(0, [1.0, 2.0])], tmp_path / "a") == {}
    assert answers(spark, [], tmp_path / "b") == {}


def test_queries_from_elsewhere(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, vector array<double>")
    asked = spark.createDataFrame([(1_000, [7.2, 1.0]), (1_000, [9.0, 1.0]), (2_000, None), (3_000, [1.0])], rows.schema)
    got = index.search(index.fit(rows), asked, k=3).orderBy("query_id", "rank")
    assert [(r["query_id"], r["vec_id"]) for r in got.collect()] == [(1_000, 7), (1_000, 8), (1_000, 6)]
    assert index.search(index.fit(rows.filter(F.lit(False))), asked).collect() == []
