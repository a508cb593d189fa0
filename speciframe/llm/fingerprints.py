"""Order MinHash fingerprints in Spark's own expressions.

The k-mers of a text are its runs of ``WORDS`` words; the second, third, ... occurrence of one is numbered,
so that repeats count. One hash of (k-mer, occurrence) both deals the k-mers into ``BINS`` bins and orders
them there. Each bin selects its ``TUPLE`` = 2 least, puts them back into text order, and hashes the pair:
moving text around changes the order and with it the hash, as an edit distance does and a set does not.
A fingerprint is the sorted array of (bin, hash) numbers; the likeness of two is the share of equal
entries among the bins that either fills.

The edited text of a document takes its second half from the next one in descending order of ids. Ids are
cut into buckets at quantiles; each bucket also receives the first document of the one after it, so one
exchange of the texts brings every document together with its successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE
from .native import let, lower_bound

WORDS = 5
BIN_BITS = 6
BINS = 1 << BIN_BITS
TUPLE = 2
#: Buckets of ids for each shuffle partition.
BUCKETS = 4


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def kmers(text: Column) -> Column:
    """Hashes of the k-mers in text order; a shorter text is one k-mer, an empty one none."""

    def of(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(x) - WORDS), lambda i: F.xxhash64(*[x[i + k] for k in range(WORDS)]))
        return F.when(F.size(x) >= WORDS, runs).when(F.size(x) > 0, F.array(F.xxhash64(x))).otherwise(
            F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def numbered(hashes: Column) -> Column:
    """(r, p, v) for each k-mer: hash of (k-mer, occurrence), position, k-mer; ascending by r."""

    def ranked(s: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            same = lambda back: F.when(j >= back, F.get(s, j - back)["v"] == x["v"]).otherwise(False)
            first = lower_bound(j, lambda m: F.get(s, m)["v"] < x["v"])
            occurrence = F.when(~same(1), 0).when(~same(2), 1).otherwise(j - first)
            return F.struct(
                F.when(~same(1), x["v"]).otherwise(F.xxhash64(x["v"], occurrence)).alias("r"), x["p"].alias("p"), x["v"].alias("v"))

        return F.sort_array(F.transform(s, one))

    pairs = F.transform(hashes, lambda v, i: F.struct(v.alias("v"), i.alias("p")))
    return let(F.sort_array(pairs), ranked)


def _bin(r: Column) -> Column:
    return F.shiftright(r, 64 - BIN_BITS)


def fingerprint(text: Column) -> Column:
    """The fingerprint of the whole text: at most ``BINS`` numbers, none for a text without words."""

    def selected(e: Column) -> Column:
        kept = F.filter(e, lambda x, j: F.when(j < TUPLE, True).otherwise(_bin(F.get(e, j - TUPLE)["r"]) != _bin(x["r"])))
        return F.sort_array(F.transform(kept, lambda x: F.struct(_bin(x["r"]).alias("b"), x["p"].alias("p"), x["v"].alias("v"))))

    def tuples(t: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            after = F.get(t, j + 1)
            pair = F.when(after["b"] == x["b"], F.xxhash64(x["v"], after["v"])).otherwise(F.xxhash64(x["v"]))
            entry = F.shiftleft(x["b"] + BINS // 2, 48).bitwiseOR(F.shiftrightunsigned(pair, 16))
            head = F.when(j == 0, True).otherwise(F.get(t, j - 1)["b"] != x["b"])
            return F.when(head, entry)

        return F.filter(F.transform(t, one), lambda v: v.isNotNull())

    return let(let(numbered(kmers(text)), selected), tuples)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among the bins filled in either; two empty fingerprints are alike."""
    bins = lambda f: F.transform(f, lambda v: F.shiftright(v, 48))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def spelled(f: Column) -> Column:
    """Two hex digits of the bin and twelve of the hash for each entry."""
    return F.array_join(F.transform(f, lambda v: F.lpad(F.hex(v), 14, "0")), "")


def _buckets(docs: DataFrame) -> tuple[Column, int]:
    """A bucket number that ascends with the id (null: -1), cut at quantiles of the ids."""
    n = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = docs.agg(F.percentile_approx("doc_id", shares, F.lit(20 * n))).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0), 1
    table = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    found = lower_bound(F.lit(len(cuts)), lambda m: F.get(table, m) < F.col("doc_id"))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(found), len(cuts) + 1


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, f, next_text, next_f): each document, its fingerprint, and those of the next one by
    descending id (rows that repeat an id follow each other by descending text; null ids come last; the
    first document follows the last)."""
    bucket, _ = _buckets(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("bucket", bucket)
    heads = rows.groupBy("bucket").agg(F.max_by("text", F.struct("doc_id", "text")).alias("text"))
    # one row for each bucket: which bucket comes before it
    order = Window.orderBy("bucket")
    turns = rows.select("bucket").distinct()
    before = turns.select("bucket", F.lead("bucket").over(order).alias("up"), F.min("bucket").over(Window.partitionBy()).alias("least"))
    tails = heads.join(before, "bucket").select(
        F.lit(None).cast("bigint").alias("doc_id"), "text", F.coalesce("up", "least").alias("bucket"), F.lit(1).alias("tail"))
    both = rows.withColumn("tail", F.lit(0)).select("doc_id", "text", "bucket", "tail").unionByName(tails)
    both = both.withColumn("f", fingerprint(F.col("text")))
    turn = Window.partitionBy("bucket").orderBy("tail", F.desc_nulls_last("doc_id"), F.desc("text"))
    return (
        both.withColumn("next_text", F.lead("text").over(turn)).withColumn("next_f", F.lead("f").over(turn))
        .filter("tail = 0").drop("tail", "bucket")
    )


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points (rounded down) replaced by the first as many of the next text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))
