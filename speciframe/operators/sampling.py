"""Per-class draws, splits, class numbering and weighted resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_key, seeded_uniform
from ..session import cut_lineage
from .ranking import bucket_digits, prefix_offsets, rank_by_hash, row_index, running_sum


# Largest k for which Spark cuts a ranking window before the shuffle (its own default).
WINDOW_LIMIT = 1000


def first_per_class(
    df: DataFrame, k: int, seed, cls: Sequence[str], key: str, rank: str = "pick", window_limit: int = WINDOW_LIMIT
) -> DataFrame:
    """The first ``k`` rows of each class in seeded order, numbered from 1.

    Up to ``window_limit`` a row limit on a window lets every map task keep only its own first k
    per class, so a class holding a third of the table sends k rows per task, not its rows. Beyond
    it, rows are numbered inside (class, hash bucket), which spreads a large class evenly.
    """
    order_key = seeded_key(F.col(seed) if isinstance(seed, str) and seed in df.columns else seed, key)
    if k <= window_limit:
        order = Window.partitionBy(*cls).orderBy(order_key, key)
        return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)
    digits = bucket_digits(df.count())
    keyed = df.withColumn("_h", order_key).withColumn("_b", F.substring("_h", 1, digits))
    counts = keyed.groupBy(*cls, "_b").agg(F.count("*").alias("_n"))
    buckets = prefix_offsets(counts, digits, cls).filter(F.col("_lo") < k)
    inside = Window.partitionBy(*cls, "_b").orderBy("_h", key)
    ranked = keyed.join(buckets, [*cls, "_b"]).withColumn(rank, F.col("_lo") + F.row_number().over(inside))
    return ranked.filter(F.col(rank) <= k).select(*df.columns, F.col(rank).cast("int").alias(rank))


def k_per_class(df: DataFrame, k: int, seed, cls: str, key: str) -> DataFrame:
    """At most ``k`` rows per class."""
    return first_per_class(df, k, seed, [cls], key).drop("pick")


def class_sizes(df: DataFrame, cls: str) -> DataFrame:
    return df.groupBy(cls).agg(F.count("*").alias("n"))


def kshot_guard(df: DataFrame, cls: str, k: int, margin: int = 5, strict: bool = False) -> DataFrame:
    """Size of each class with two flags: fewer than ``k`` rows, fewer than ``k + margin``.
    Strict mode fails on the first."""
    sizes = class_sizes(df, cls)
    n = F.col("n")
    if strict:
        message = F.concat(F.col(cls).cast("string"), F.lit(f" has fewer than {k} rows"))
        sizes = sizes.withColumn("n", F.when(n >= k, n).otherwise(F.raise_error(message).cast("bigint")))
    return sizes.select(cls, "n", (n < k).alias("too_few"), ((n >= k) & (n < k + margin)).alias("scarce"))


def kshot_split(df: DataFrame, ks: Sequence[int], folds: Sequence[int], cls: str, key: str) -> DataFrame:
    """Every row once per (k, fold) with its role: k train rows per class, the rest test.

    The picks are found first on narrow rows and gathered per key, so the table is joined once by key
    and multiplied only afterwards, within its tasks.
    """
    picks = kshot_picks(df, max(ks), folds, cls, key)
    used = picks.groupBy(key).agg(F.collect_list(F.struct("fold", "pick")).alias("_used"))
    marked = df.join(used, key, "left")
    pairs = marked.select("*", F.explode(F.array(*[F.lit(f) for f in folds])).alias("fold"))
    pairs = pairs.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    train = F.exists("_used", lambda u: (u["fold"] == F.col("fold")) & (u["pick"] <= F.col("k")))
    return pairs.withColumn("role", F.when(train, "train").otherwise("test")).drop("_used")


def kshot_picks(df: DataFrame, k: int, folds: Sequence[int], cls: str, key: str) -> DataFrame:
    narrow = df.select(cls, key, F.explode(F.array(*[F.lit(f) for f in folds])).alias("fold"))
    return first_per_class(narrow, k, "fold", ["fold", cls], key)


def balanced_validation(df: DataFrame, per_class: int, seed, cls: str, key: str) -> DataFrame:
    """Exactly ``per_class`` validation rows per class, the rest train; a smaller class fails when it is read."""
    picks = first_per_class(df.select(cls, key), per_class, seed, [cls], key)
    sizes = picks.groupBy(cls).agg(F.max("pick").alias("_n"))
    message = F.concat(F.col(cls).cast("string"), F.lit(" has only "), F.col("_n").cast("string"), F.lit(f" rows, {per_class} are needed for validation"))
    enough = F.when(F.col("_n") >= per_class, "val").otherwise(F.raise_error(message).cast("string"))
    marked = picks.join(sizes, cls).select(key, enough.alias("_role"))
    return df.join(marked, key, "left").withColumn("role", F.coalesce("_role", F.lit("train"))).drop("_role")


# -- class numbering ---------------------------------------------------------------------------


def class_index_by_appearance(df: DataFrame, cls: str, row: str) -> DataFrame:
    """(class, class_idx) in order of first appearance."""
    first = df.groupBy(cls).agg(F.min(row).alias("_first"))
    return row_index(first, ["_first"], "class_idx").drop("_first")


def class_index_given(df: DataFrame, cls: str, idx: str, row: str) -> DataFrame:
    """(class, class_idx) from a given column; the last row of a class wins."""
    return df.groupBy(cls).agg(F.max_by(idx, row).alias("class_idx"))


def class_index_sorted(df: DataFrame, cls: str) -> DataFrame:
    """(class, class_idx) in the order of the class names."""
    return row_index(df.select(cls).distinct(), [cls], "class_idx")


def label_encode(df: DataFrame, classes: DataFrame, cls: str) -> DataFrame:
    """Rows with their class index. Classes go broadcast or shuffled by their size; a hot class
    is split by the adaptive skew join."""
    return df.join(classes, cls)


def relabel_priority(df: DataFrame, cls: str, listed: Sequence) -> DataFrame:
    """(class, class_idx): listed classes first in list order, then the others by name."""
    place = F.array_position(F.array(*[F.lit(v) for v in listed]), F.col(cls))
    ranked = df.select(cls).distinct().withColumn(
        "_place", F.when(place > 0, place).otherwise(F.lit(len(listed) + 1))
    )
    return row_index(ranked, ["_place", cls], "class_idx").drop("_place")


def permute_classes(df: DataFrame, cls: str, seed, splits: Sequence[str] = ("pretraining", "seen", "unseen")) -> DataFrame:
    """A seeded permutation of the classes, the same list under every split name."""
    ranked = rank_by_hash(df.select(cls).distinct(), seed, [cls], "class_idx")
    return ranked.select(F.explode(F.array(*[F.lit(s) for s in splits])).alias("split"), cls, "class_idx")


# -- weighted resampling -----------------------------------------------------------------------


def weighted_resample(
    spark: SparkSession, shards: DataFrame, draws: int, seed: int, epoch: int, weight: str | None, order: Sequence[str]
) -> DataFrame:
    """``draws`` shards with replacement, uniform or by weight, repeatable for an epoch.

    A draw is a uniform point on the line of cumulative weights. Points and the starts of the shards'
    intervals are sorted together by range and written once; every point takes the last start before it, in
    its own range or, where a range has none before it, from the ranges before. A shard with nearly all the
    weight has its points in as many ranges as they fill. Shards without weight are never drawn.
    """
    weighted = shards.withColumn("_w", F.lit(1.0) if weight is None else F.col(weight).cast("double"))
    line = cut_lineage(running_sum(weighted, order, "_w", "_lo", "_hi"))
    total, n = line.agg(F.max("_hi"), F.count("*")).first()
    if not n:
        raise ValueError("no shards to draw from")
    starts = line.filter("_hi > _lo").select(
        F.col("_lo").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("draw"), F.struct(*shards.columns).alias("_shard"))
    points = spark.range(draws).select(
        (seeded_uniform(seed + epoch, "id") * F.lit(float(total))).alias("_at"), F.lit(1).alias("_kind"), F.col("id").alias("draw"))
    sort = ("_at", "_kind", "draw")
    both = cut_lineage(
        starts.unionByName(points, allowMissingColumns=True).orderBy(*sort)
        .withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    last = F.last("_shard", ignorenulls=True)
    inside = last.over(Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0))
    ends = both.groupBy("_p").agg(F.max_by("_shard", F.when(F.col("_kind") == 0, F.col("_m"))).alias("_shard"))
    carried = ends.select("_p", last.over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))  # a row per range
    drawn = both.withColumn("_own", inside).filter("_kind = 1").join(carried, "_p")
    return drawn.select("draw", F.coalesce("_own", "_carried").alias("_shard")).select("draw", "_shard.*")
