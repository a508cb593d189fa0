"""Global row numbers, running sums, batches and worker shares without a one-task sort."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_key
from ..session import cut_lineage

# Rows of a hash bucket that are aimed at, and rows that are put in order when a cut is searched.
BUCKET_ROWS, FEW = 16_384, 4_096
_OFFSET_BITS = 33


def bucket_digits(n: int) -> int:
    """Leading hex digits of a hash that deal ``n`` rows into buckets of about ``BUCKET_ROWS``."""
    digits = 1
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    return min(digits, 32)


def prefix_offsets(counts: DataFrame, digits: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., _b, _lo): rows before each hash prefix of (by..., _b, _n), ``_b`` having that many digits.

    Two digits at a time: sums of shorter prefixes come before those of longer ones, so a window never holds
    more than 256 rows, however many buckets there are.
    """
    by, found = list(by), None
    for length in [*range(2, digits, 2), digits]:
        here = counts.groupBy(*by, F.substring("_b", 1, length).alias("_b")).agg(F.sum("_n").alias("_n"))
        here = here.withColumn("_parent", F.substring("_b", 1, max(0, (length - 1) // 2 * 2)))
        before = Window.partitionBy(*by, "_parent").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        here = here.select(*by, "_b", "_parent", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lo"))
        if found is None:
            found = here.drop("_parent")
            continue
        upper = found.select(*by, F.col("_b").alias("_parent"), F.col("_lo").alias("_up"))
        found = here.join(upper, [*by, "_parent"]).select(*by, "_b", (F.col("_lo") + F.col("_up")).alias("_lo"))
    return found


def rank_by_hash(df: DataFrame, seed, keys: Sequence[str], rank: str = "rank") -> DataFrame:
    """0-based position of every row in the seeded order of ``keys`` (a full shuffle order).

    Rows are numbered inside hash buckets, whose number follows that of the rows; a bucket's offset comes
    from counts on the keys alone. The rows themselves are shuffled once and not written.
    """
    narrow = df.select(seeded_key(seed, *keys).alias("_h"))
    digits = bucket_digits(narrow.count())
    counts = narrow.groupBy(F.substring("_h", 1, digits).alias("_b")).agg(F.count("*").alias("_n"))
    keyed = df.withColumn("_h", seeded_key(seed, *keys)).withColumn("_b", F.substring("_h", 1, digits))
    inside = Window.partitionBy("_b").orderBy("_h", *keys)
    numbered = keyed.withColumn("_o", F.row_number().over(inside) - 1)
    return numbered.join(prefix_offsets(counts, digits), "_b").withColumn(rank, F.col("_lo") + F.col("_o")).drop("_b", "_h", "_lo", "_o")


def exact_fraction(df: DataFrame, fraction: float, seed, keys: Sequence[str]) -> DataFrame:
    """Exactly ``int(fraction * N)`` rows, without replacement, by seeded order.

    The cut is searched on the hashes alone: counts by the first digits tell where it lies, two digits more at
    a time until few rows are left. The rows are then kept by a filter, without a shuffle; only where equal
    keys lie on both sides of the cut are these counted out.
    """
    hashes = df.select(seeded_key(seed, *keys).alias("_h"))

    def counted(place: str, digits: int) -> list:
        return sorted(hashes.filter(F.col("_h").startswith(place)).groupBy(F.substring("_h", 1, digits).alias("p")).count().collect())

    cells = counted("", 2)
    left = math.floor(fraction * sum(n for _, n in cells))
    if left <= 0:
        return df.filter(F.lit(False))
    while True:
        for place, n in cells:
            if n >= left:
                break
            left -= n
        if n <= FEW or len(place) >= 32:
            break
        cells = counted(place, len(place) + 2)
    for cut, equal in counted(place, 32):
        if equal >= left:
            break
        left -= equal
    hashed = df.withColumn("_h", seeded_key(seed, *keys))
    if equal == left:
        return hashed.filter(F.col("_h") <= cut).drop("_h")
    tied = hashed.filter(F.col("_h") == cut).withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy(*keys)))
    return hashed.filter(F.col("_h") < cut).unionByName(tied.filter(F.col("_r") <= left).drop("_r")).drop("_h")


def _range_sorted(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-partitioned sort written to the shared folder, with the sort partition ``_p`` and the
    place inside it ``_o``. Written once, so that both passes over it see the same ranges."""
    fixed = cut_lineage(df.orderBy(*order).select("*", F.monotonically_increasing_id().alias("_m")))
    return fixed.select(
        "*",
        F.shiftright("_m", _OFFSET_BITS).alias("_p"),
        F.col("_m").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1)).alias("_o"),
    ).drop("_m")


def _offsets(placed: DataFrame, amount: Column) -> DataFrame:
    """Sum of ``amount`` over all earlier sort partitions; one row per partition."""
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_p").agg(F.sum(amount).alias("_t"))
    return totals.select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))


def _started(df: DataFrame, order: Sequence[str], amount: Column) -> tuple[DataFrame, bool]:
    """``df`` with ``_start``, the sum of ``amount`` over all rows before those with these values (null is one),
    and whether every row has values of its own.

    Rows are first added up by their order columns; these narrow sums are sorted by range and written once.
    Offsets of whole ranges are added to running sums inside a range, and the rows joined by the columns: they
    are shuffled once and not written.
    """
    sums = df.groupBy(*order).agg(F.sum(amount).alias("_n"), F.count("*").alias("_c"))
    fixed = _range_sorted(sums, order)
    inside = Window.partitionBy("_p").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    line = fixed.join(_offsets(fixed, F.col("_n")), "_p").select(*[F.col(o).alias(f"_j{i}") for i, o in enumerate(order)], start.alias("_start"))
    same = functools.reduce(lambda a, b: a & b, [df[o].eqNullSafe(line[f"_j{i}"]) for i, o in enumerate(order)])
    single = (fixed.agg(F.max("_c")).first()[0] or 0) <= 1
    return df.join(line, same).drop(*[f"_j{i}" for i in range(len(order))]), single


def row_index(df: DataFrame, order: Sequence[str], index: str = "row_idx") -> DataFrame:
    """0-based position in the natural order of the given columns. Rows that are equal in these are numbered in
    any order, by one task for each such group."""
    started, single = _started(df, order, F.lit(1))
    more = F.lit(0) if single else F.row_number().over(Window.partitionBy(*order).orderBy(F.lit(0))) - 1
    return started.withColumn(index, F.col("_start") + more).drop("_start")


def running_sum(df: DataFrame, order: Sequence[str], value: str, low: str = "lo", high: str = "hi") -> DataFrame:
    """Sum of ``value`` before (``low``) and up to and including (``high``) every row; equal rows as in ``row_index``."""
    started, single = _started(df, order, F.col(value))
    rows = Window.partitionBy(*order).orderBy(F.lit(0))
    inside = F.lit(0) if single else F.coalesce(F.sum(value).over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return started.withColumn(low, F.col("_start") + inside).withColumn(high, F.col(low) + F.col(value)).drop("_start")


def assign_batches(
    df: DataFrame,
    size: int,
    order: Sequence[str] | None = None,
    seed=None,
    keys: Sequence[str] = (),
    drop_last: bool = False,
    batch: str = "batch_no",
) -> DataFrame:
    """Batches of fixed size along an order: natural (``order``) or seeded (``seed``, ``keys``).
    The last, shorter batch is kept unless ``drop_last``."""
    if order is not None:
        numbered = row_index(df, order, "_i")
    else:
        numbered = rank_by_hash(df, seed, keys, "_i")
    out = numbered.withColumn(batch, F.floor(F.col("_i") / size))
    if drop_last:
        whole = df.count() // size
        out = out.filter(F.col(batch) < whole)
    return out.drop("_i")


def epoch_shuffle(df: DataFrame, seed: int, epoch: int, keys: Sequence[str], rank: str = "position") -> DataFrame:
    """Position of every row in this epoch; the same on every node."""
    return rank_by_hash(df, seed + epoch, keys, rank)


def assign_workers(df: DataFrame, order: Sequence[str], nodes: int, workers: int) -> DataFrame:
    """Shards dealt out to nodes, then to the workers of a node."""
    i = F.col("_i")
    return (
        row_index(df, order, "_i")
        .withColumn("node", F.pmod(i, F.lit(nodes)).cast("int"))
        .withColumn("worker", F.pmod(F.floor(i / nodes), F.lit(workers)).cast("int"))
        .drop("_i")
    )


def pad_shares(df: DataFrame, order: Sequence[str], shares: int) -> DataFrame:
    """Equal shares: the head is repeated until the number of rows divides by ``shares``; the row
    at position i goes to share i mod shares."""
    n = df.count()
    total = -(-n // shares) * shares
    places = F.sequence(F.col("_i"), F.lit(total - 1).cast("bigint"), F.lit(max(n, 1)).cast("bigint"))
    return (
        row_index(df, order, "_i")
        .withColumn("position", F.explode(places))
        .withColumn("share", F.pmod("position", F.lit(shares)).cast("int"))
        .drop("_i")
    )
