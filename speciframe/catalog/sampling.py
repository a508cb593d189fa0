"""Draws, splits, batches, workers and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import seeded_key
from ..operators import joins, ranking, sampling
from .base import ctes, features, query, shards, table


def order(seed, key):
    return f"md5(concat_ws(':', {seed}, {key})), {key}"


_FOLD_RANK = f"""SELECT id, target, fold, row_number() OVER (PARTITION BY fold, target ORDER BY {order('fold', 'id')}) AS pick
 FROM features, UNNEST([0, 1, 2, 3, 4]) AS f(fold)"""


@query(
    "kshot_split",
    ctes("features")
    + f" SELECT id, target, fold, k, CASE WHEN pick <= k THEN 'train' ELSE 'test' END AS role FROM ({_FOLD_RANK}), UNNEST([1, 5]) AS kk(k)",
)
def kshot_split(spark, sf):
    rows = features(spark, sf).select("id", "target")
    return sampling.kshot_split(rows, [1, 5], list(range(5)), "target", "id").select("id", "target", "fold", "k", "role")


@query(
    "kshot_guard",
    "SELECT source, count(*) AS n, count(*) < 48 AS too_few, count(*) >= 48 AND count(*) < 53 AS scarce FROM documents GROUP BY source",
)
def kshot_guard(spark, sf):
    return sampling.kshot_guard(table(spark, sf, "documents"), "source", 48)


def _top(source, key, part, seed, k):
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY {order(repr(str(seed)), key)}) <= {k}"


@query("k_per_class", ctes("features") + f" SELECT id, target FROM ({_top('features', 'id', 'target', 3, 7)})")
def k_per_class(spark, sf):
    return sampling.k_per_class(features(spark, sf).select("id", "target"), 7, 3, "target", "id")


@query("subset_sampler", f"SELECT o_orderkey, o_custkey FROM ({_top('orders', 'o_orderkey', 'o_orderpriority', 1, 50)})")
def subset_sampler(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return sampling.k_per_class(rows, 50, 1, "o_orderpriority", "o_orderkey").drop("o_orderpriority")


@query(
    "balanced_val",
    ctes("features")
    + f""" SELECT id, target, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY {order("'9'", 'id')}) <= 5 THEN 'val' ELSE 'train' END AS role
 FROM features""",
)
def balanced_val(spark, sf):
    return sampling.balanced_validation(features(spark, sf).select("id", "target"), 5, 9, "target", "id")


@query(
    "target_transform",
    ctes("features") + """ SELECT id, target, CASE target WHEN 7 THEN 0 WHEN 2 THEN 1 WHEN 5 THEN 2
 ELSE target + 3 - CAST(target > 2 AS INT) - CAST(target > 5 AS INT) - CAST(target > 7 AS INT) END AS class_idx FROM features""",
)
def target_transform(spark, sf):
    """Labels renumbered by a mapping of the caller's: listed classes first."""
    rows = features(spark, sf).select("id", "target")
    return sampling.label_encode(rows, sampling.relabel_priority(rows, "target", [7, 2, 5]), "target").select("id", "target", "class_idx")


@query(
    "exact_fraction",
    f"""SELECT o_orderkey, o_custkey FROM orders
 QUALIFY row_number() OVER (ORDER BY {order("'4'", 'o_orderkey')}) <= floor(0.37 * count(*) OVER ())""",
)
def exact_fraction(spark, sf):
    return ranking.exact_fraction(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 0.37, 4, ["o_orderkey"])


@query("row_index", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS row_idx FROM lineitem")
def row_index(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return ranking.row_index(table(spark, sf, "lineitem").select(*keys), keys).select("l_orderkey", "l_linenumber", "row_idx")


_BATCHED = "SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 128) AS BIGINT) AS batch_no FROM orders"


@query("assign_batches", _BATCHED)
def assign_batches(spark, sf):
    return ranking.assign_batches(table(spark, sf, "orders").select("o_orderkey"), 128, order=["o_orderkey"])


@query(
    "assign_batches_drop_last",
    f"""SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY {order("'2'", 'o_orderkey')}) - 1) / 128) AS BIGINT) AS batch_no FROM orders
 QUALIFY batch_no < floor(count(*) OVER () / 128)""",
)
def assign_batches_drop_last(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey")
    return ranking.assign_batches(rows, 128, seed=2, keys=["o_orderkey"], drop_last=True)


@query("epoch_shuffle", f"SELECT o_orderkey, row_number() OVER (ORDER BY {order("'17'", 'o_orderkey')}) - 1 AS position FROM orders")
def epoch_shuffle(spark, sf):
    return ranking.epoch_shuffle(table(spark, sf, "orders").select("o_orderkey"), 10, 7, ["o_orderkey"])


@query(
    "assign_workers",
    ctes("shards")
    + """, i AS (SELECT *, row_number() OVER (ORDER BY url) - 1 AS i FROM shards)
 SELECT url, CAST(i % 4 AS INT) AS node, CAST((i // 4) % 3 AS INT) AS worker FROM i""",
)
def assign_workers(spark, sf):
    return ranking.assign_workers(shards(spark, sf).select("url"), ["url"], 4, 3)


@query(
    "pad_shares",
    ctes("shards")
    + """, i AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS i, count(*) OVER () AS n FROM shards),
 p AS (SELECT unnest(range(0, CAST(ceil(n / 7.0) * 7 AS BIGINT))) AS position, n FROM (SELECT DISTINCT n FROM i))
 SELECT url, position, CAST(position % 7 AS INT) AS share FROM p JOIN i ON i.i = p.position % p.n""",
)
def pad_shares(spark, sf):
    return ranking.pad_shares(shards(spark, sf).select("url"), ["url"], 7)


@query(
    "weighted_resample",
    ctes("shards")
    + """, c AS (SELECT *, sum(weight) OVER (ORDER BY url) AS hi, sum(weight) OVER () AS total FROM shards),
 d AS (SELECT o_orderkey AS draw, ('0x' || substr(md5('8:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 AS u FROM orders)
 SELECT draw, url FROM d JOIN c ON u * total >= hi - weight AND u * total < hi""",
)
def weighted_resample(spark, sf):
    draws = table(spark, sf, "orders").count()
    return sampling.weighted_resample(spark, shards(spark, sf), draws, 5, 3, "weight", ["url"]).select("draw", "url")


@query(
    "replay_pairing",
    """WITH m AS (SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS b FROM orders),
 r AS (SELECT p_partkey AS id, (row_number() OVER (ORDER BY p_partkey) - 1) // 90 AS b FROM part),
 n AS (SELECT max(b) + 1 AS n FROM r)
 SELECT id, b AS batch_no, 'main' AS segment FROM m
 UNION ALL SELECT r.id, x.b, 'replay' FROM (SELECT DISTINCT b FROM m) x, n, r WHERE r.b = x.b % n.n""",
)
def replay_pairing(spark, sf):
    main = table(spark, sf, "orders").selectExpr("o_orderkey AS id")
    replay = table(spark, sf, "part").selectExpr("p_partkey AS id")
    return joins.replay_pairing(
        ranking.assign_batches(main, 100, order=["id"]), ranking.assign_batches(replay, 90, order=["id"])
    )


# -- relational pieces -------------------------------------------------------------------------


@query("filter_classes", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) * 25 > (SELECT count(*) FROM part))")
def filter_classes(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    big = sampling.class_sizes(part, "p_brand").filter(F.col("n") * 25 > part.count())
    return joins.keep_classes(part, big, "p_brand")


@query("semi_classes", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1)")
def semi_classes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    toxic = docs.join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id").select("source").distinct()
    return joins.keep_classes(docs, toxic, "source")


@query("unlabelled_anti", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_anti(spark, sf):
    return joins.unlabelled(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("except_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def except_ids(spark, sf):
    return joins.except_ids(
        table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    )


@query(
    "merge_flagged",
    """SELECT doc_id, lang, 1 AS is_labelled FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
 UNION ALL SELECT doc_id, lang, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def merge_flagged(spark, sf):
    docs, marked = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id")
    return joins.merge_flagged(docs.join(marked, "doc_id", "left_semi"), joins.unlabelled(docs, marked, "doc_id"))


@query(
    "union_sources",
    "SELECT s_name AS name, 'supplier' AS origin FROM supplier UNION ALL SELECT c_name, 'customer' FROM customer UNION ALL SELECT n_name, 'nation' FROM nation",
)
def union_sources(spark, sf):
    parts = [("supplier", "s_name"), ("customer", "c_name"), ("nation", "n_name")]
    return joins.union_sources([table(spark, sf, t).select(F.col(c).alias("name"), F.lit(t).alias("origin")) for t, c in parts])


@query("label_consistency", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE quality <> toxic) AS n_mismatch FROM documents JOIN labels USING (doc_id)")
def label_consistency(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    return joins.label_consistency(docs.join(labels.select("doc_id", "quality"), "doc_id"), labels.select("doc_id", "toxic"), "doc_id", "quality", "toxic")


@query(
    "epoch_gate",
    "SELECT event_id, user_id FROM events WHERE user_id % 6 = 0 OR user_id = 47",
)
def epoch_gate(spark, sf):
    return joins.epoch_gate(table(spark, sf, "events").select("event_id", "user_id"), "user_id", 6, 47)


@query("seeded_order", f"SELECT vec_id, md5(concat_ws(':', '3', vec_id)) AS h FROM embeddings")
def seeded_order(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", seeded_key(3, "vec_id").alias("h"))
