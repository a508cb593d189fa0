"""Vector algebra, prototypes, evaluation, losses and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.hashing import seeded_key
from ..operators import aggregates, clustering, losses, metrics, retrieval, scoring
from ..operators.sampling import class_index_sorted
from ..plans import discovery, embed, few_shot, probes, zero_shot
from ..session import scratch_path
from . import naming
from .base import ctes, features, meter, pairs, query, r6, samples, table, tasks, traits
from .sampling import _FOLD_RANK, order

# A vector column is compared value by value: (keys..., pos, x).


def spread(df, keys, vec):
    return df.select(*keys, F.posexplode(vec).alias("pos", "x")).select(*keys, "pos", r6("x", "x"))


def spread_sql(keys, vec, source):
    return (
        f"SELECT {keys}, CAST(pos - 1 AS INT) AS pos, round(x, 6) AS x FROM (SELECT {keys}, unnest({vec}) AS x, generate_subscripts({vec}, 1) AS pos FROM {source})"
    )


D = "::DOUBLE[]"
UNIT = "list_transform({v}, lambda x: x / greatest(sqrt(list_inner_product({v}, {v})), 1e-12))"


def unit(v):
    return UNIT.format(v=v)


def minus(a, b):
    return f"list_transform(list_zip({a}, {b}), lambda p: p[1] - p[2])"


# Element-wise mean by keys, from a source with (keys, v).
def mean_sql(keys, source, vec="v", name="m"):
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return (
        f"SELECT {by}list(a ORDER BY pos) AS {name} FROM (SELECT {by}pos, avg(x) AS a FROM (SELECT {by}unnest({vec}) AS x, generate_subscripts({vec}, 1) AS pos FROM {source})"
        f" GROUP BY {by}pos) {group}"
    )


DOUBLES = ctes("features") + ", f AS (SELECT id, features::DOUBLE[] AS v, target FROM features)"


@query("l2_normalize", DOUBLES + ", u AS (SELECT id, list_transform(v, lambda x: x * 3) AS w FROM f), n AS (SELECT id, " + unit("w") + " AS r FROM u) " + spread_sql("id", "r", "n"))
def l2_normalize(spark, sf):
    tripled = features(spark, sf).select("id", F.transform(V.as_double("features"), lambda x: x * 3).alias("w"))
    return spread(tripled.select("id", V.l2_normalize("w").alias("r")), ["id"], "r")


@query("mean_vector", DOUBLES + ", m AS (" + mean_sql("", "f") + ") SELECT CAST(pos - 1 AS INT) AS pos, round(x, 6) AS x FROM (SELECT unnest(m) AS x, generate_subscripts(m, 1) AS pos FROM m)")
def mean_vector(spark, sf):
    return spread(aggregates.vector_mean(features(spark, sf), "features"), [], "mean")


@query("class_centroids", DOUBLES + ", c AS (" + mean_sql("target", "f") + ") " + spread_sql("target", "m", "c"))
def class_centroids(spark, sf):
    return spread(aggregates.class_centroids(features(spark, sf), "features", "target"), ["target"], "centroid")


@query(
    "cl2n",
    DOUBLES + ", m AS (" + mean_sql("target", "f") + f"), d AS (SELECT id, {minus('v', 'm')} AS w FROM f JOIN m USING (target)), n AS (SELECT id, {unit('w')} AS r FROM d) "
    + spread_sql("id", "r", "n"),
)
def cl2n(spark, sf):
    rows = features(spark, sf)
    means = aggregates.vector_mean(rows, "features", ["target"])
    centred = rows.join(means, "target").select("id", V.cl2n("features", "mean").alias("r"))
    return spread(centred, ["id"], "r")


@query(
    "class_index",
    ctes("features") + " SELECT target, count(*) AS n, (SELECT count(DISTINCT target) FROM features) AS n_classes, (SELECT count(*) FROM features) AS n_samples FROM features GROUP BY target",
)
def class_index(spark, sf):
    rows = features(spark, sf)
    sizes = rows.groupBy("target").agg(F.count("*").alias("n"))
    total = sizes.agg(F.count("*").alias("n_classes"), F.sum("n").alias("n_samples"))
    # One total row.
    return sizes.withColumn("_k", F.lit(0)).join(F.broadcast(total.withColumn("_k", F.lit(0))), "_k").drop("_k")


IMG, TXT = "image::DOUBLE[]", "text::DOUBLE[]"


@query("logits", ctes("pairs") + f" SELECT id, round(100 * list_inner_product({IMG}, {TXT}) + 0.5, 6) AS logit FROM pairs")
def logits(spark, sf):
    return pairs(spark, sf).select("id", r6(V.scaled_logit("image", "text", 100.0, 0.5), "logit"))


@query(
    "pairwise_distance",
    ctes("pairs") + f" SELECT id, round(list_distance({IMG}, {TXT}), 6) AS distance, round(list_distance({IMG}, {TXT}) ** 2, 6) AS sq FROM pairs",
)
def pairwise_distance(spark, sf):
    return pairs(spark, sf).select(
        "id", r6(V.euclidean_distance("image", "text"), "distance"), r6(V.squared_distance("image", "text"), "sq")
    )


@query("threshold_labels", ctes("features") + " SELECT id, array_to_string(list_transform(features::DOUBLE[], lambda x: CASE WHEN x > 0.05 THEN 1 ELSE 0 END), '') AS labels FROM features")
def threshold_labels(spark, sf):
    bits = V.threshold_labels(V.as_double("features"), 0.05)
    return features(spark, sf).select("id", F.array_join(F.transform(bits, lambda b: b.cast("string")), "").alias("labels"))


# -- prototypes and ranks ----------------------------------------------------------------------

PROTOS = DOUBLES + ", p AS (SELECT target AS class_idx, " + unit("m") + " AS w FROM (" + mean_sql("target", "(SELECT target, " + unit("v") + " AS v FROM f)") + "))"
SCORES = PROTOS + ", s AS (SELECT id, target, class_idx, round(list_inner_product(v, w), 9) AS score FROM f CROSS JOIN p)"
RANKED = SCORES + ", r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, class_idx) AS rank FROM s)"


def prototypes(spark, sf):
    return zero_shot.ensemble_prototypes(features(spark, sf), "target", "features").withColumnRenamed("target", "class_idx")


HOW = {"vec": "features", "proto_vec": "w", "label": "class_idx"}


@query("ensemble_prototypes", PROTOS + " " + spread_sql("class_idx", "w", "p"))
def ensemble_prototypes(spark, sf):
    return spread(prototypes(spark, sf), ["class_idx"], "w")


@query("topk_classes", RANKED + " SELECT id, rank, CAST(class_idx AS BIGINT) AS label, round(score * 100, 7) AS score FROM r WHERE rank <= 3")
def topk_classes(spark, sf):
    top = scoring.topk_classes(features(spark, sf), prototypes(spark, sf), 3, scale=100.0, **HOW)
    return top.select("id", F.col("rank").cast("bigint").alias("rank"), "label", F.round("score", 7).alias("score"))


@query(
    "cross_scores",
    RANKED + """ SELECT o.id, round(o.score * 100, 7) AS own_score, o.rank - 1 AS n_better, CAST(b.class_idx AS BIGINT) AS best, round(b.score * 100, 7) AS best_score
 FROM r o JOIN r b ON b.id = o.id AND b.rank = 1 WHERE o.class_idx = o.target""",
)
def cross_scores(spark, sf):
    matched = scoring.match_prototypes(features(spark, sf), prototypes(spark, sf), truth="target", scale=100.0, keep=["id"], **HOW)
    best = F.get("hits", 0)
    return matched.select("id", F.round("own_score", 7).alias("own_score"), "n_better", best["label"].alias("best"), F.round(best["score"], 7).alias("best_score"))


@query(
    "nearest_centroid",
    DOUBLES + ", c AS (" + mean_sql("target", "f") + """), d AS (SELECT f.id, c.target, round(list_distance(v, m) ** 2, 9) AS q FROM f CROSS JOIN c)
 SELECT id, CAST(arg_min(target, (q, target)) AS BIGINT) AS pred, round(sqrt(min(q)), 5) AS score FROM d GROUP BY id""",
)
def nearest_centroid(spark, sf):
    rows = features(spark, sf)
    centroids = aggregates.class_centroids(rows, "features", "target")
    near = scoring.nearest_prototype(rows, centroids, vec="features", proto_vec="centroid", label="target", metric="l2")
    return near.select("id", "pred", F.round("score", 5).alias("score"))


@query("topk_accuracy", RANKED + """ SELECT target, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS top1,
 round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS top3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS top5 FROM r WHERE class_idx = target GROUP BY target""")
def topk_accuracy(spark, sf):
    ranked = scoring.match_prototypes(features(spark, sf), prototypes(spark, sf), truth="target", keep=["id", "target"], **HOW)
    scored = metrics.topk_accuracy(ranked, [1, 3, 5], by=["target"])
    return scored.select("target", "n", *[r6(c, c) for c in ("top1", "top3", "top5")])


@query("zero_shot_eval", RANKED + """ SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS top1,
 round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS top3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS top5 FROM r WHERE class_idx = target""")
def zero_shot_eval(spark, sf):
    scored = zero_shot.zero_shot_eval(features(spark, sf), prototypes(spark, sf))
    return scored.select("n", *[r6(c, c) for c in ("top1", "top3", "top5")])


@query(
    "match_rank",
    ctes("pairs") + f""", s AS (SELECT a.id, b.id AS other, round(list_inner_product(a.{IMG}, b.{TXT}), 9) AS score FROM pairs a CROSS JOIN pairs b)
 SELECT id, rank - 1 AS n_better FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM s) WHERE id = other""",
)
def match_rank(spark, sf):
    return retrieval.match_rank(pairs(spark, sf), "image", "text")


def _direction(name, a, b):
    return f"""SELECT '{name}' AS direction, round(avg(r) + 1, 6) AS mean_rank, floor(median(r)) + 1 AS median_rank, round(avg(CASE WHEN r < 1 THEN 1.0 ELSE 0 END), 6) AS r_at_1,
 round(avg(CASE WHEN r < 5 THEN 1.0 ELSE 0 END), 6) AS r_at_5, round(avg(CASE WHEN r < 10 THEN 1.0 ELSE 0 END), 6) AS r_at_10 FROM
 (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) - 1 AS r FROM
  (SELECT a.id, b.id AS other, round(list_inner_product(a.{a}, b.{b}), 9) AS score FROM pairs a CROSS JOIN pairs b)) WHERE id = other"""


@query("retrieval_metrics", ctes("pairs") + " " + _direction("image_to_text", IMG, TXT) + " UNION ALL " + _direction("text_to_image", TXT, IMG))
def retrieval_metrics(spark, sf):
    out = retrieval.retrieval_metrics(pairs(spark, sf), "image", "text")
    return out.select("direction", r6("mean_rank", "mean_rank"), "median_rank", *[r6(c, c) for c in ("r_at_1", "r_at_5", "r_at_10")])


# -- few-shot ----------------------------------------------------------------------------------

FEW = (
    DOUBLES
    + f""", picks AS ({_FOLD_RANK}), roles AS (SELECT p.id, p.target, p.fold, k, pick <= k AS is_train, v FROM picks p JOIN f USING (id), UNNEST([1, 5]) AS kk(k)),
 mean AS ({mean_sql('k, fold', '(SELECT * FROM roles WHERE is_train)')}),
 c AS (SELECT id, target, roles.k, roles.fold, is_train, {minus('v', 'm')} AS w FROM roles JOIN mean ON mean.k = roles.k AND mean.fold = roles.fold),
 n AS (SELECT id, target, k, fold, is_train, {unit('w')} AS v FROM c),
 cent AS ({mean_sql('k, fold, target', '(SELECT * FROM n WHERE is_train)', name='w')}),
 d AS (SELECT n.id, n.k, n.fold, n.target, cent.target AS cls, round(list_distance(v, w) ** 2, 9) AS q FROM n JOIN cent ON cent.k = n.k AND cent.fold = n.fold WHERE NOT is_train),
 pred AS (SELECT id, k, fold, target, arg_min(cls, (q, cls)) AS pred FROM d GROUP BY id, k, fold, target),
 acc AS (SELECT k, fold, count(*) AS n, avg(CASE WHEN pred = target THEN 1.0 ELSE 0 END) AS accuracy FROM pred GROUP BY k, fold)"""
)


@query("few_shot_eval", FEW + " SELECT k, count(*) AS n_folds, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std FROM acc GROUP BY k")
def few_shot_eval(spark, sf):
    return few_shot.few_shot_eval(features(spark, sf)).select("k", "n_folds", r6("mean", "mean"), r6("std", "std"))


@query("few_shot_folds", FEW + " SELECT k, fold, n, round(accuracy, 6) AS accuracy FROM acc")
def few_shot_folds(spark, sf):
    return few_shot.few_shot_accuracy(features(spark, sf)).select("k", "fold", "n", r6("accuracy", "accuracy"))


_SIMPLE_SPLIT = ", parts AS (SELECT *, substr(md5(concat_ws(':', 't', id)), 1, 1) < '8' AS is_train FROM f)"


def _train_test(spark, sf):
    rows = features(spark, sf).withColumn("_h", F.substring(seeded_key("t", "id"), 1, 1))
    return rows.filter("_h < '8'").drop("_h"), rows.filter("_h >= '8'").drop("_h")


@query(
    "simpleshot_eval",
    DOUBLES + _SIMPLE_SPLIT + f""", ranked AS (SELECT id, target, repeat, v, row_number() OVER (PARTITION BY repeat, target ORDER BY {order('repeat', 'id')}) AS pick
   FROM parts, UNNEST([0, 1, 2, 3, 4]) AS r(repeat) WHERE is_train), train AS (SELECT * FROM ranked WHERE pick <= 1),
 mean AS ({mean_sql('repeat', 'train')}),
 tn AS (SELECT repeat, target, {unit('w')} AS v FROM (SELECT train.repeat, target, {minus('v', 'm')} AS w FROM train JOIN mean USING (repeat))),
 cent AS ({mean_sql('repeat, target', 'tn', name='w')}),
 test AS (SELECT id, repeat, target, {unit('w')} AS v FROM (SELECT id, repeat, target, {minus('v', 'm')} AS w FROM parts CROSS JOIN mean WHERE NOT is_train)),
 d AS (SELECT test.id, test.repeat, test.target, cent.target AS cls, round(list_distance(v, w) ** 2, 9) AS q FROM test JOIN cent USING (repeat)),
 pred AS (SELECT id, repeat, target, arg_min(cls, (q, cls)) AS pred FROM d GROUP BY id, repeat, target)
 SELECT repeat, count(*) AS n, round(avg(CASE WHEN pred = target THEN 1.0 ELSE 0 END), 6) AS accuracy FROM pred GROUP BY repeat""",
)
def simpleshot_eval(spark, sf):
    train, test = _train_test(spark, sf)
    out = few_shot.simpleshot_repeats(train, test, k=1, repeats=5)
    return out.select("repeat", "n", r6("accuracy", "accuracy"))


@query(
    "simpleshot_scores",
    DOUBLES + _SIMPLE_SPLIT + f""", mean AS ({mean_sql('', '(SELECT * FROM parts WHERE is_train)')}),
 n AS (SELECT id, target, is_train, {unit('w')} AS v FROM (SELECT id, target, is_train, {minus('v', 'm')} AS w FROM parts CROSS JOIN mean)),
 cent AS ({mean_sql('target', '(SELECT * FROM n WHERE is_train)', name='w')}),
 d AS (SELECT n.id, n.target, cent.target AS cls, round(list_distance(v, w) ** 2, 9) AS q FROM n CROSS JOIN cent WHERE NOT is_train)
 SELECT id, target, CAST(arg_min(cls, (q, cls)) AS BIGINT) AS pred, CASE WHEN arg_min(cls, (q, cls)) = target THEN 1 ELSE 0 END AS hit FROM d GROUP BY id, target""",
)
def simpleshot_scores(spark, sf):
    train, test = _train_test(spark, sf)
    return few_shot.simpleshot_scores(train, test)


@query(
    "knn_vote",
    DOUBLES + _SIMPLE_SPLIT + """, d AS (SELECT t.id, s.id AS other, s.target, row_number() OVER (PARTITION BY t.id ORDER BY round(list_distance(t.v, s.v) ** 2, 9), s.id) AS rank
   FROM parts t CROSS JOIN parts s WHERE NOT t.is_train AND s.is_train),
 votes AS (SELECT id, target, count(*) AS c FROM d WHERE rank <= 5 GROUP BY id, target)
 SELECT id, arg_min(target, (-c, target)) AS pred FROM votes GROUP BY id""",
)
def knn_vote(spark, sf):
    train, test = _train_test(spark, sf)
    return few_shot.knn_vote(train, test, n=5)


# -- scores over predictions -------------------------------------------------------------------


@query("exact_match", ctes("traits") + " SELECT count(*) AS n, round(avg(CASE WHEN quality = p_quality AND toxic = p_toxic THEN 1.0 ELSE 0 END), 6) AS accuracy FROM traits")
def exact_match(spark, sf):
    rows = traits(spark, sf).select(F.array("quality", "toxic").alias("t"), F.array("p_quality", "p_toxic").alias("p"))
    return metrics.exact_match(rows, "p", "t").select("n", r6("accuracy", "accuracy"))


@query(
    "macro_f1",
    ctes("traits") + """, l AS (SELECT unnest([(0, quality, p_quality), (1, toxic, p_toxic)]) AS s FROM traits),
 c AS (SELECT s[1] AS label, sum(s[2] * s[3]) AS tp, sum(s[3] * (1 - s[2])) AS fp, sum((1 - s[3]) * s[2]) AS fn FROM l GROUP BY 1)
 SELECT count(*) AS n_labels, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1 FROM c""",
)
def macro_f1(spark, sf):
    rows = traits(spark, sf).select(F.array("quality", "toxic").alias("t"), F.array("p_quality", "p_toxic").alias("p"))
    return metrics.macro_f1(rows, "p", "t").select("n_labels", r6("macro_f1", "macro_f1"))


@query("micro_accuracy", ctes("traits") + " SELECT count(*) AS n, round(avg(CASE WHEN quality = p_quality THEN 1.0 ELSE 0 END), 6) AS accuracy FROM traits")
def micro_accuracy(spark, sf):
    return metrics.label_accuracy(traits(spark, sf), "p_quality", "quality").select("n", r6("accuracy", "accuracy"))


@query("fold_summary", "SELECT event_type, count(*) AS n_folds, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def fold_summary(spark, sf):
    out = metrics.fold_summary(table(spark, sf, "events"), "value", ["event_type"])
    return out.select("event_type", "n_folds", r6("mean", "mean"), r6("std", "std"))


_METER = "round(sum(val * n), 4) AS total, sum(n)::BIGINT AS weight, round(sum(val * n) / sum(n), 6) AS avg"


def _metered(df, *keys):
    return df.select(*keys, F.round("total", 4).alias("total"), "weight", r6("avg", "avg"))


@query("average_meter", ctes("meter") + f" SELECT metric, {_METER} FROM meter GROUP BY metric")
def average_meter(spark, sf):
    return _metered(metrics.average_meter(meter(spark, sf), "val", "n", ["metric"]), "metric")


WINDOWED = ctes("meter") + f" SELECT metric, CAST(floor(step / 100) AS BIGINT) AS window_no, {_METER} FROM meter GROUP BY 1, 2"


@query("average_meter_windowed", WINDOWED)
def average_meter_windowed(spark, sf):
    return _metered(metrics.average_meter_windowed(meter(spark, sf), "val", "n", "step", 100, ["metric"]), "metric", "window_no")


@query(
    "throughput",
    ctes("meter") + " SELECT metric, sum(n)::BIGINT AS samples, round(sum(n) / sum(val), 6) AS per_second, round(sum(n) / sum(val) / 8, 6) AS per_second_per_worker FROM meter GROUP BY metric",
)
def throughput(spark, sf):
    out = metrics.throughput(meter(spark, sf), "n", "val", 8, ["metric"])
    return out.select("metric", "samples", r6("per_second", "per_second"), r6("per_second_per_worker", "per_second_per_worker"))


@query(
    "count_samples",
    ctes("samples") + """ SELECT sum(n)::BIGINT AS n_samples, count(*) AS n_batches, count(*) FILTER (WHERE a <> b) AS n_unequal
 FROM (SELECT lang, url, count(*) AS n, count(txt) AS a, count(coalesce(jpg, png)) AS b FROM samples GROUP BY lang, url)""",
)
def count_samples(spark, sf):
    rows = samples(spark, sf).select(F.struct("lang", "url").alias("batch"), "txt", F.coalesce("jpg", "png").alias("image"))
    return metrics.count_samples(rows, "batch", "txt", "image")


# -- in-batch losses ---------------------------------------------------------------------------

CELLS = ctes("pairs") + f""", l AS (SELECT a.batch_id, a.id AS i, b.id AS j, 20 * list_inner_product(a.{IMG}, b.{TXT}) + 0.1 AS z,
   10 * list_inner_product(a.{TXT}, b.{IMG}) AS t FROM pairs a JOIN pairs b ON a.batch_id = b.batch_id)"""
SIDES = CELLS + """, sides AS (SELECT batch_id, 'image' AS side, i AS id, i = j AS own, z, t FROM l UNION ALL SELECT batch_id, 'text', j, i = j, z, t FROM l),
 rows_ AS (SELECT batch_id, side, id, max(z) FILTER (WHERE own) AS own, max(z) AS top, ln(sum(exp(z))) AS lse,
   ln(sum(exp(z))) - sum(exp(t) * z) / sum(exp(t)) AS ce FROM sides GROUP BY 1, 2, 3)"""
BATCHES = SIDES + """, b AS (SELECT batch_id, count(*) FILTER (WHERE side = 'image') AS batch_size, (avg(lse - own) FILTER (WHERE side = 'image') + avg(lse - own) FILTER (WHERE side = 'text')) / 2 AS loss,
   avg(CASE WHEN own = top THEN 1.0 ELSE 0 END) FILTER (WHERE side = 'image') AS accuracy FROM rows_ GROUP BY batch_id)"""


def _in_batch(spark, sf, **how):
    return losses.in_batch_rows(pairs(spark, sf), **{"batch": ["batch_id"], "scale": 20.0, "bias": 0.1, **how})


@query("inbatch_pairs", SIDES + " SELECT batch_id, side, id, round(own, 6) AS own, round(top, 6) AS top, round(lse, 6) AS lse FROM rows_")
def inbatch_pairs(spark, sf):
    return _in_batch(spark, sf).select("batch_id", "side", "id", r6("own", "own"), r6("top", "top"), r6("lse", "lse"))


@query(
    "contrastive_eval",
    BATCHES + " SELECT sum(batch_size)::BIGINT AS num_samples, round(sum(loss * batch_size) / sum(batch_size), 6) AS val_loss, round(sum(accuracy * batch_size) / sum(batch_size), 6) AS val_acc FROM b",
)
def contrastive_eval(spark, sf):
    out = losses.contrastive_eval(_in_batch(spark, sf), ["batch_id"])
    return out.select("num_samples", r6("val_loss", "val_loss"), r6("val_acc", "val_acc"))


@query(
    "sigmoid_pair_loss",
    CELLS + " SELECT batch_id, count(DISTINCT i) AS batch_size, round(sum(ln(1 + exp(CASE WHEN i = j THEN -z ELSE z END))) / count(DISTINCT i), 6) AS loss FROM l GROUP BY batch_id",
)
def sigmoid_pair_loss(spark, sf):
    return losses.sigmoid_pair_loss(_in_batch(spark, sf), ["batch_id"]).select("batch_id", "batch_size", r6("loss", "loss"))


SEGMENTS = (
    ctes("pairs")
    + f""", p AS (SELECT *, CASE WHEN label < 7 THEN 'main' ELSE 'replay' END AS segment FROM pairs),
 l AS (SELECT a.batch_id, a.segment, a.id AS i, b.id AS j, 20 * list_inner_product(a.{IMG}, b.{TXT}) + 0.1 AS z FROM p a JOIN p b ON a.batch_id = b.batch_id AND a.segment = b.segment),
 sides AS (SELECT batch_id, segment, 'image' AS side, i AS id, i = j AS own, z FROM l UNION ALL SELECT batch_id, segment, 'text', j, i = j, z FROM l),
 r AS (SELECT batch_id, segment, side, id, max(z) FILTER (WHERE own) AS own, ln(sum(exp(z))) AS lse FROM sides GROUP BY 1, 2, 3, 4)
 SELECT batch_id, segment, count(*) FILTER (WHERE side = 'image') AS batch_size,
  round((avg(lse - own) FILTER (WHERE side = 'image') + avg(lse - own) FILTER (WHERE side = 'text')) / 2, 6) AS loss FROM r GROUP BY 1, 2"""
)


@query("segment_loss", SEGMENTS)
def segment_loss(spark, sf):
    rows = pairs(spark, sf).withColumn("segment", F.when(F.col("label") < 7, "main").otherwise("replay"))
    scored = losses.in_batch_rows(rows, batch=["batch_id", "segment"], scale=20.0, bias=0.1)
    out = losses.contrastive_by_batch(scored, ["batch_id", "segment"])
    return out.select("batch_id", "segment", "batch_size", r6("loss", "loss"))


@query(
    "distill_loss",
    SIDES + """ SELECT batch_id, count(*) FILTER (WHERE side = 'image') AS batch_size,
 round((avg(ce) FILTER (WHERE side = 'image') + avg(ce) FILTER (WHERE side = 'text')) / 2, 6) AS loss FROM rows_ GROUP BY batch_id""",
)
def distill_loss(spark, sf):
    rows = _in_batch(spark, sf, teacher=("text", "image", 10.0))
    return losses.distill_loss(rows, ["batch_id"]).select("batch_id", "batch_size", r6("loss", "loss"))


# -- clustering --------------------------------------------------------------------------------

# Predicted cluster of a row: the place of its largest coordinate.
CLUSTERED = DOUBLES + ", k AS (SELECT id, target, target < 5 AS is_old, list_position(v, list_max(v)) - 1 AS cluster FROM f)"


def _clustered(spark, sf):
    top = F.array_position("features", F.array_max("features")) - 1
    return features(spark, sf).select("id", "target", (F.col("target") < 5).alias("is_old"), top.cast("int").alias("cluster"))


@query("contingency", CLUSTERED + " SELECT CAST(cluster AS INT) AS cluster, target, count(*) AS n FROM k GROUP BY 1, 2")
def contingency(spark, sf):
    return metrics.contingency(_clustered(spark, sf), "cluster", "target")


@query("cluster_purity", CLUSTERED + ", c AS (SELECT cluster, target, count(*) AS n FROM k GROUP BY 1, 2), m AS (SELECT cluster, max(n) AS top, sum(n) AS n FROM c GROUP BY 1) SELECT round(sum(top) / sum(n), 6) AS purity, sum(n)::BIGINT AS n FROM m")
def cluster_purity(spark, sf):
    return metrics.cluster_purity(_clustered(spark, sf), "cluster", "target").select(r6("purity", "purity"), "n")


def _assignment_sql():
    """Best one-to-one total by dynamic programming over the set of used classes, per subset."""
    parts = [CLUSTERED + ", c AS (SELECT is_old, cluster, target, count(*) AS n FROM k GROUP BY 1, 2, 3), s0 AS (SELECT DISTINCT is_old, 0 AS used, 0 AS total FROM k)"]
    for i in range(64):
        parts.append(
            f"""s{i + 1} AS MATERIALIZED (SELECT is_old, used, max(total) AS total FROM (SELECT is_old, used, total FROM s{i}
 UNION ALL SELECT s.is_old, s.used + (1 << c.target) AS used, s.total + c.n FROM s{i} s JOIN c ON c.is_old = s.is_old AND c.cluster = {i} AND (s.used >> c.target) % 2 = 0) GROUP BY 1, 2)"""
        )
    tail = """ SELECT b.is_old, b.n AS n_rows, t.n_right::BIGINT AS n_right, round(t.n_right / b.n, 6) AS accuracy FROM (SELECT is_old, count(*) AS n FROM k GROUP BY 1) b
 JOIN (SELECT is_old, max(total) AS n_right FROM s64 GROUP BY 1) t USING (is_old)"""
    return ", ".join(parts) + tail


@query("cluster_accuracy", _assignment_sql())
def cluster_accuracy(spark, sf):
    out = clustering.cluster_accuracy(_clustered(spark, sf), "cluster", "target", ["is_old"])
    return out.select("is_old", "n_rows", "n_right", r6("accuracy", "accuracy"))


def _round_sql(i, points="f"):
    """One round of assignment under c{i} and the new centres c{i+1}."""
    return f"""a{i} AS (SELECT id, arg_min(cluster, (q, cluster)) AS cluster, min(q) AS q FROM (SELECT p.id, c.cluster, round(list_distance(p.v, c.v) ** 2, 9) AS q FROM {points} p CROSS JOIN c{i} c) GROUP BY id),
 m{i} AS ({mean_sql('cluster', f'(SELECT cluster, v FROM a{i} JOIN {points} USING (id))')}),
 c{i + 1} AS (SELECT c.cluster, coalesce(m, c.v) AS v FROM c{i} c LEFT JOIN m{i} USING (cluster))"""


FIRST = DOUBLES + ", c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, v FROM f ORDER BY id LIMIT 6)"


@query("kmeans_fixed_init", FIRST + ", " + ", ".join(_round_sql(i) for i in range(4)) + " SELECT CAST(cluster AS BIGINT) AS cluster, count(*) AS n, round(sum(q), 5) AS inertia FROM a3 GROUP BY cluster")
def kmeans_fixed_init(spark, sf):
    fitted = clustering.kmeans(features(spark, sf), "features", "id", 6, init="first", max_iterations=4, tolerance=0.0)
    assigned = clustering.assign(fitted.points, fitted.centers, "features", ["id"])
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("sq_dist"), 5).alias("inertia"))


@query(
    "kmeans_inertia",
    FIRST + ", " + ", ".join(_round_sql(i) for i in range(2))
    + """ SELECT round((SELECT sum(q) FROM a0), 5) AS inertia, round(sum(list_distance(x.v, y.v)), 5) AS shift, sum(list_distance(x.v, y.v)) ** 2 < 1e-4 AS settled
 FROM c0 x JOIN c1 y USING (cluster)""",
)
def kmeans_inertia(spark, sf):
    rows = features(spark, sf)
    start = scoring.ship(clustering.first_k(rows, "features", "id", 6), [], "cluster", "center")
    sums = clustering.cluster_sums(rows, start, "features")
    _, _, shift = clustering.lloyd_round(rows, start, "features")
    return sums.agg(F.round(F.sum(F.element_at("total", -1)), 5).alias("inertia")).select(
        "inertia", F.round(F.lit(shift), 5).alias("shift"), F.lit(shift * shift < 1e-4).alias("settled")
    )


@query(
    "d2_seed_step",
    FIRST + """, q AS (SELECT p.id, min(round(list_distance(p.v, c.v) ** 2, 9)) AS q FROM f p CROSS JOIN c0 c GROUP BY p.id),
 cum AS (SELECT id, q, sum(q) OVER (ORDER BY md5(concat_ws(':', '21', id)), id) AS cum, sum(q) OVER () AS total FROM q)
 SELECT arg_min(id, cum) AS id, round(arg_min(q, cum), 5) AS sq_dist FROM cum WHERE cum >= 0.61 * total""",
)
def d2_seed_step(spark, sf):
    rows = features(spark, sf)
    near = clustering.assign(rows, clustering.first_k(rows, "features", "id", 6), "features", ["id"])
    return clustering.d2_pick(near, "id", "sq_dist", 0.61, 21).select("id", F.round("sq_dist", 5).alias("sq_dist"))


@query(
    "best_restart",
    "SELECT event_type, min(value) AS value, arg_min(event_id, (value, event_id)) AS event_id FROM events GROUP BY event_type",
)
def best_restart(spark, sf):
    runs = table(spark, sf, "events").select("event_type", "value", "event_id")
    return clustering.best_restart(runs, "value", ["event_type"])


def _semi_sql(seeds, n_base, k, rounds=10):
    """Runs of k-means from ``pts`` (id, v, target, lab): means of the labelled classes, drawn centres, pinned rounds."""
    runs = ", ".join(f"({r}, '{s}')" for r, s in enumerate(seeds))
    share = lambda c: f"('0x' || substr(md5(concat_ws(':', seed, 'd2', '{c}')), 1, 8))::BIGINT / 4294967296.0"
    near = "round(list_distance({a}, {b}) ** 2, 9)"
    parts = [f"""runs(run, seed) AS (VALUES {runs}),
 base AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY lab) - 1 AS BIGINT) AS cluster, lab, m AS v FROM ({mean_sql('lab', '(SELECT lab, v FROM pts WHERE lab IS NOT NULL)')})),
 q{n_base} AS MATERIALIZED (SELECT run, seed, id, v, q FROM runs CROSS JOIN (SELECT p.id, p.v, min({near.format(a='p.v', b='c.v')}) AS q FROM pts p CROSS JOIN base c WHERE p.lab IS NULL GROUP BY p.id, p.v))"""]
    for c in range(n_base, k):
        parts.append(f"""cum{c} AS (SELECT *, sum(q) OVER o AS cum, row_number() OVER o AS rn, sum(q) OVER (PARTITION BY run) AS total FROM q{c} WINDOW o AS (PARTITION BY run ORDER BY md5(concat_ws(':', seed, id)), id ROWS UNBOUNDED PRECEDING)),
 new{c} AS MATERIALIZED (SELECT run, arg_min(v, rn) AS v FROM cum{c} WHERE cum >= {share(c)} * total GROUP BY run),
 q{c + 1} AS MATERIALIZED (SELECT q.run, q.seed, q.id, q.v, least(q.q, {near.format(a='q.v', b='n.v')}) AS q FROM q{c} q JOIN new{c} n ON n.run = q.run)""")
    drawn = " ".join(f"UNION ALL SELECT run, {c}, v FROM new{c}" for c in range(n_base, k))
    parts.append(f"""c0 AS MATERIALIZED (SELECT run, cluster, v FROM base CROSS JOIN runs {drawn}),
 pin AS (SELECT p.id, b.cluster AS pin FROM pts p JOIN base b ON b.lab = p.lab)""")
    for i in range(rounds):
        parts.append(f"""g{i} AS (SELECT c.run, p.id, arg_min(c.cluster, ({near.format(a='p.v', b='c.v')}, c.cluster)) AS cluster FROM pts p CROSS JOIN c{i} c GROUP BY c.run, p.id),
 a{i} AS MATERIALIZED (SELECT g.run, g.id, coalesce(pin, g.cluster) AS cluster FROM g{i} g LEFT JOIN pin USING (id)),
 m{i} AS ({mean_sql('run, cluster', f'(SELECT run, cluster, v FROM a{i} JOIN pts USING (id))')}),
 c{i + 1} AS MATERIALIZED (SELECT c.run, c.cluster, coalesce(m, c.v) AS v FROM c{i} c LEFT JOIN m{i} USING (run, cluster))""")
    return ", ".join(parts)


SEMI = DOUBLES + ", pts AS (SELECT id, v, target, CASE WHEN target < 9 AND substr(md5(concat_ws(':', 'l', id)), 1, 1) < '8' THEN target END AS lab FROM f), "


@query(
    "semi_kmeans",
    SEMI + _semi_sql((2, 3, 4), 9, 10) + """, t AS (SELECT a.run, sum(list_distance(p.v, c.v) ** 2) AS inertia FROM a9 a JOIN pts p USING (id) JOIN c9 c ON c.run = a.run AND c.cluster = a.cluster GROUP BY a.run),
 best AS (SELECT arg_min(run, (round(inertia, 9), run)) AS run, min(inertia) AS inertia FROM t)
 SELECT cluster, count(*) AS n, round(any_value(inertia), 5) AS inertia FROM a9 JOIN best USING (run) GROUP BY cluster""",
)
def semi_kmeans(spark, sf):
    known = (F.col("target") < 9) & (F.substring(seeded_key("l", "id"), 1, 1) < "8")
    points = features(spark, sf).withColumn("label", F.when(known, F.col("target")))
    fitted = clustering.semi_kmeans(points, "features", "id", "label", 10, max_iterations=10, tolerance=0.0, n_init=3, seed=2)
    counts = fitted.labels().groupBy("cluster").agg(F.count("*").alias("n"))
    return counts.withColumn("inertia", F.round(F.lit(fitted.inertia), 5))


def _discovery_sql():
    """Old classes are 0 to 5, so classes keep their numbers."""
    parts = [DOUBLES + """, o AS (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(':', '0', id)), id) <= floor(0.8 * count(*) OVER ()) AS is_labelled FROM f WHERE target < 6),
 pts AS MATERIALIZED (SELECT f.id, f.v, f.target, CASE WHEN coalesce(is_labelled, FALSE) THEN f.target END AS lab FROM f LEFT JOIN o USING (id))""",
             _semi_sql((0, 1, 2), 6, 10),
             """k AS MATERIALIZED (SELECT a.run, p.target < 6 AS is_old, a.cluster, p.target FROM a9 a JOIN pts p USING (id) WHERE p.lab IS NULL),
 c AS MATERIALIZED (SELECT run, is_old, cluster, target, count(*) AS n FROM k GROUP BY ALL), s0 AS (SELECT DISTINCT run, is_old, 0 AS used, 0 AS total FROM k)"""]
    for i in range(10):
        parts.append(f"""s{i + 1} AS MATERIALIZED (SELECT run, is_old, used, max(total) AS total FROM (SELECT run, is_old, used, total FROM s{i}
 UNION ALL SELECT s.run, s.is_old, s.used + (1 << c.target) AS used, s.total + c.n FROM s{i} s JOIN c ON c.run = s.run AND c.is_old = s.is_old AND c.cluster = {i} AND (s.used >> c.target) % 2 = 0) GROUP BY 1, 2, 3)""")
    parts.append("""t AS (SELECT run, is_old, n, n_right FROM (SELECT run, is_old, count(*) AS n FROM k GROUP BY 1, 2) JOIN (SELECT run, is_old, max(total) AS n_right FROM s10 GROUP BY 1, 2) USING (run, is_old)),
 r AS (SELECT CAST(run AS INTEGER) AS run, sum(n)::BIGINT AS n_rows, sum(n_right) / sum(n) AS accuracy, max(n_right / n) FILTER (WHERE is_old) AS old_accuracy, max(n_right / n) FILTER (WHERE NOT is_old) AS new_accuracy FROM t GROUP BY run)
 SELECT run, n_rows, round(accuracy, 6) AS accuracy, round(old_accuracy, 6) AS old_accuracy, round(new_accuracy, 6) AS new_accuracy, round(avg(accuracy) OVER (), 6) AS mean, round(stddev_pop(accuracy) OVER (), 6) AS std FROM r""")
    return ", ".join(parts)


@query("category_discovery", _discovery_sql())
def category_discovery(spark, sf):
    out = discovery.category_discovery(features(spark, sf), list(range(6)), seeds=(0, 1, 2), tolerance=0.0)
    return out.select("run", "n_rows", *[r6(c, c) for c in ("accuracy", "old_accuracy", "new_accuracy", "mean", "std")])


# -- models ------------------------------------------------------------------------------------


@query("task_features", ctes("tasks", "features") + " SELECT task, row_idx, label, split, CAST(pos - 1 AS INT) AS pos, round(x::DOUBLE, 6) AS x FROM tasks JOIN (SELECT id, unnest(features) AS x, generate_subscripts(features, 1) AS pos FROM features) ON id = row_idx")
def task_features(spark, sf):
    vectors = features(spark, sf).withColumnRenamed("id", "row_idx")
    joined = tasks(spark, sf).join(vectors, "row_idx")
    spread_out = joined.select("task", "row_idx", "label", "split", F.posexplode("features").alias("pos", "x"))
    return spread_out.withColumn("x", F.round(F.col("x").cast("double"), 6))


@query("task_splits", ctes("tasks") + " SELECT task, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split <> 'train') AS n_test FROM tasks GROUP BY task")
def task_splits(spark, sf):
    is_train = F.col("split") == "train"
    return tasks(spark, sf).groupBy("task").agg(F.count_if(is_train).alias("n_train"), F.count_if(~is_train).alias("n_test"))


@query("task_probe")
def task_probe(spark, sf):
    vectors = features(spark, sf).withColumnRenamed("id", "row_idx").drop("target")
    told = probes.task_probe_eval(vectors, tasks(spark, sf))
    return told.select("run", "n", r6("accuracy", "accuracy"), r6("mean", "mean"), r6("std", "std"))


N_TRAITS, N_STEPS, RIDGE = 9, 20, 1e-3


def _multilabel_sql():
    """The same steps on lists: products per run, their inverse by elimination, gradients, new coefficients."""
    size = "(SELECT n FROM size)"
    parts = [DOUBLES + f""", split AS (SELECT id, v, list_transform(range(9), lambda i: CASE WHEN target = i THEN 1 ELSE 0 END) AS y, substr(md5(concat_ws(':', 't', id)), 1, 1) >= '8' AS is_test FROM f),
 runs AS (SELECT unnest(range(3)) AS run),
 x AS MATERIALIZED (SELECT run, id, y, list_concat([1.0], list_transform(v, lambda z, j: 2 * z *
   (((strpos('0123456789abcdef', substr(md5(concat_ws(':', run, '0', id)), (j - 1) // 4 + 1, 1)) - 1) >> (3 - (j - 1) % 4)) & 1))) AS x
   FROM split CROSS JOIN runs WHERE NOT is_test),
 e AS MATERIALIZED (SELECT run, id, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM x),
 size AS MATERIALIZED (SELECT count(*) AS n FROM split WHERE NOT is_test),
 gram AS (SELECT a.run, a.j AS i, list(a.g ORDER BY a.k) AS g FROM (SELECT a.run, a.j, b.j AS k, sum(a.x * b.x) / 4 + CASE WHEN a.j = b.j THEN {RIDGE} * {size} ELSE 0 END AS g
   FROM e a JOIN e b ON a.run = b.run AND a.id = b.id GROUP BY a.run, a.j, b.j) a GROUP BY a.run, a.j),
 wide AS (SELECT run, list(list_concat(g, list_transform(range(1, len(g) + 1), lambda c: CASE WHEN c = i THEN 1.0 ELSE 0.0 END)) ORDER BY i) AS m FROM gram GROUP BY run),
 gone(run, k, m) AS (SELECT run, 0, m FROM wide UNION ALL
   SELECT run, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda z: z / r[k + 1])
     ELSE list_transform(r, lambda z, c: z - r[k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END) FROM gone WHERE k < len(m)),
 inv AS MATERIALIZED (SELECT run, list_transform(m, lambda r: r[len(m) + 1:]) AS inv FROM gone WHERE k = len(m)),
 w0 AS MATERIALIZED (SELECT run, label, list_transform(inv, lambda r: 0.0) AS w FROM inv CROSS JOIN (SELECT unnest(range(1, {N_TRAITS + 1})) AS label))"""]
    for i in range(N_STEPS):
        parts.append(f"""r{i} AS (SELECT x.run, x.id, w.label, x.y[w.label] - 1 / (1 + exp(-list_inner_product(x.x, w.w))) AS r FROM x JOIN w{i} w ON w.run = x.run),
 g{i} AS (SELECT run, label, list(g ORDER BY j) AS g FROM (SELECT r.run, r.label, e.j, sum(r.r * e.x) AS g FROM r{i} r JOIN e ON e.run = r.run AND e.id = r.id GROUP BY ALL) GROUP BY run, label),
 d{i} AS (SELECT w.run, w.label, w.w, list_transform(g.g, lambda z, j: z - {RIDGE} * n * w.w[j]) AS d FROM size CROSS JOIN w{i} w JOIN g{i} g ON g.run = w.run AND g.label = w.label),
 w{i + 1} AS MATERIALIZED (SELECT d.run, d.label, list_transform(inv, lambda r, j: d.w[j] + list_inner_product(r, d.d)) AS w FROM d{i} d JOIN inv ON inv.run = d.run)""")
    tail = f"""told AS (SELECT w.run, s.id, w.label, s.y[w.label] AS y, CASE WHEN round(list_inner_product(list_concat([1.0], s.v), w.w), 9) > 0.5 THEN 1 ELSE 0 END AS p
   FROM split s CROSS JOIN w{N_STEPS} w WHERE s.is_test),
 ex AS (SELECT run, count(*) AS n, avg(hit) AS exact FROM (SELECT run, id, min(CASE WHEN y = p THEN 1.0 ELSE 0 END) AS hit FROM told GROUP BY run, id) GROUP BY run),
 f1 AS (SELECT run, avg(CASE WHEN t > 0 THEN 2.0 * tp / t ELSE 0 END) AS macro_f1 FROM (SELECT run, label, sum(y * p) AS tp, sum(y) + sum(p) AS t FROM told GROUP BY run, label) GROUP BY run),
 s AS (SELECT CAST(run AS INTEGER) AS run, n, exact, macro_f1 FROM ex JOIN f1 USING (run))
 SELECT run, n, round(exact, 6) AS exact, round(macro_f1, 6) AS macro_f1, round(avg(exact) OVER (), 6) AS exact_mean, round(stddev_pop(exact) OVER (), 6) AS exact_std,
  round(avg(macro_f1) OVER (), 6) AS macro_f1_mean, round(stddev_pop(macro_f1) OVER (), 6) AS macro_f1_std FROM s"""
    return ", ".join([*parts, tail]).replace("WITH ", "WITH RECURSIVE ", 1)


@query("multilabel_probe", _multilabel_sql())
def multilabel_probe(spark, sf):
    bits = F.array(*[(F.col("target") == i).cast("int") for i in range(N_TRAITS)])
    train, test = _train_test(spark, sf)
    told = probes.multilabel_eval(train.withColumn("labels", bits), test.withColumn("labels", bits), N_TRAITS, ridge=RIDGE, steps=N_STEPS)
    scores = [c for c in told.columns if c not in ("run", "n")]
    return told.select("run", "n", *[r6(c, c) for c in scores])


# A model that SQL can follow: how often each of some letters occurs.
LETTERS = "aeinorst"


def letter_model():
    import numpy as np

    def predict(texts):
        return np.array([[str(t).lower().count(c) for c in LETTERS] for t in texts], dtype=np.float32)

    return predict


def letters_sql(text):
    counts = ", ".join(f"(length({text}) - length(replace(lower({text}), '{c}', '')))::DOUBLE" for c in LETTERS)
    return f"[{counts}]"


def embedded_sql(vec):
    """Unit vectors as the model hands them over, in single precision."""
    return f"{unit(vec)}::FLOAT[]::DOUBLE[]"


@query("embed_batch", f"WITH e AS (SELECT doc_id, {letters_sql('text')} AS c FROM documents), u AS (SELECT doc_id, {embedded_sql('c')} AS v FROM e) " + spread_sql("doc_id", "v", "u").replace("round(x, 6)", "round(x, 5)"))
def embed_batch(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = embed.embed(docs, "text", letter_model, ["doc_id"])
    return out.select("doc_id", F.posexplode("vector").alias("pos", "x")).select("doc_id", "pos", F.round(F.col("x").cast("double"), 5).alias("x"))


NAMED = (
    ctes("taxa")
    + f""", names AS (SELECT id, {naming.TAX} AS text, dense_rank() OVER (ORDER BY family) - 1 AS target FROM taxa),
 e AS (SELECT id, target, {letters_sql('text')} AS c FROM names), f AS (SELECT id, target, {embedded_sql('c')} AS v FROM e)"""
)


def _on_names(sql):
    return sql.replace(DOUBLES, NAMED).replace("FROM features,", "FROM f,").replace("UNNEST([0, 1, 2, 3, 4]) AS f(fold)", "UNNEST([0, 1]) AS folds(fold)").replace("UNNEST([1, 5]) AS kk(k)", "UNNEST([1, 3]) AS kk(k)")


@query(
    "shared_features",
    _on_names(FEW) + (RANKED.replace(PROTOS.split(", p AS")[0], "", 1)) + """, z AS (SELECT 'zero-shot' AS task, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS score FROM r WHERE class_idx = target)
 SELECT task, score FROM z UNION ALL SELECT 'few-shot-' || k, round(avg(accuracy), 6) FROM acc GROUP BY k""",
)
def shared_features(spark, sf):
    names = naming.taxonomy_texts(spark, sf)
    shared = embed.shared_features(names, "text", letter_model, ["id", "target"], scratch_path(spark, "shared"))
    zero = zero_shot.zero_shot_eval(shared, zero_shot.ensemble_prototypes(shared, "target", "features").withColumnRenamed("target", "class_idx"))
    few = few_shot.few_shot_eval(shared, ks=(1, 3), folds=2)
    return zero.select(F.lit("zero-shot").alias("task"), r6("top1", "score")).unionByName(
        few.select(F.concat(F.lit("few-shot-"), F.col("k").cast("string")).alias("task"), r6("mean", "score"))
    )


_PROMPTS = (
    f"WITH n AS (SELECT DISTINCT p_brand AS name FROM part), t(template_id, template) AS (VALUES {naming.TEMPLATE_VALUES}),"
    f" c AS (SELECT dense_rank() OVER (ORDER BY name) - 1 AS class_idx, replace(template, '{{}}', name) AS prompt FROM n CROSS JOIN t),"
    f" e AS (SELECT class_idx, {letters_sql('prompt')} AS c FROM c), u AS (SELECT class_idx, {embedded_sql('c')} AS v0 FROM e),"
    f" w AS (SELECT class_idx, {unit('v0')} AS v FROM u), m AS ({mean_sql('class_idx', 'w')}), p AS (SELECT class_idx, {unit('m')} AS v FROM m) "
)


@query("text_prototypes", _PROMPTS + spread_sql("class_idx", "v", "p").replace("round(x, 6)", "round(x, 5)"))
def text_prototypes(spark, sf):
    classes = class_index_sorted(table(spark, sf, "part").select(F.col("p_brand").alias("name")), "name")
    protos = zero_shot.text_prototypes(classes, letter_model)
    return protos.select("class_idx", F.posexplode("w").alias("pos", "x")).select("class_idx", "pos", F.round("x", 5).alias("x"))
