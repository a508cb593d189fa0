"""A Merkle manifest of a table: every row a leaf, a tree of arity three per group, a tree over the groups.

Rows are numbered within their group by a range-partitioned sort of the narrow leaf table. Aligned blocks of
``BLOCK`` consecutive leaves become one row each, which keeps every level of its subtree as one string of
digests laid end to end: a parent is the hash of a substring of fixed width, and what stands beside a node in
that substring are its siblings. The roots of the blocks are numbered already and form the leaves of the next
round, ``BLOCK`` times fewer each time. The way from a leaf to the root is then put together downwards, by a
join on blocks. All of it is built-in expressions; no task holds more than a block of a group at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speciframe.session import cut_lineage


ARITY = 3
#: Levels of a block: 3 ** 5 leaves, 15.5 kB of digests.
LEVELS = 5
BLOCK = ARITY**LEVELS
HEX = 64
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row: SHA-256 of its fields, in lower-case hex."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that ``digest`` leads to along ``path``."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def proof(path: Column) -> Column:
    """Digest of the siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def _numbered(items: DataFrame, order: list[str]) -> DataFrame:
    """``items`` with ``pos`` in their group's order and the group's ``total``. A group of any size is many
    partitions: positions are offsets of (partition, group) plus the place in a written, sorted partition."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = cut_lineage(
        items.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
        .withColumns({"part": F.spark_partition_id(), "place": place}))
    held = ordered.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total"))
    return ordered.join(offsets, ["grp", "part"]).withColumn("pos", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _levels(digests: Column, depth: Column) -> Column:
    """All levels of a block, lowest first, each one string of digests."""

    def above(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (ARITY * HEX)).cast("int"))
        hashed = F.transform(runs, lambda i: F.sha2(F.substring(level, i * (ARITY * HEX) + 1, F.lit(ARITY * HEX)), 256))
        return F.array_join(hashed, "").cast("binary")

    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(F.array_join(digests, "").cast("binary")), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))


def _blocks(items: DataFrame) -> DataFrame:
    """(grp, block, items, levels, total): one row per aligned run of ``BLOCK`` items, in order."""
    gathered = items.groupBy("grp", F.floor(F.col("pos") / BLOCK).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", *[c for c in ("row",) if c in items.columns]))).alias("items"),
        F.max("total").alias("total"))
    # a group of one block stops at its root; a larger one climbs all levels, so that the last block stays aligned
    size = F.when(F.col("total") > BLOCK, F.lit(BLOCK)).otherwise(F.size("items"))
    depth = F.size(F.filter(F.array(*[F.lit(ARITY**j) for j in range(LEVELS)]), lambda w: w < size))
    return cut_lineage(gathered.select("grp", "block", "items", "total", _levels(F.col("items.digest"), depth).alias("levels")))


def _climb(items: DataFrame) -> list[DataFrame]:
    """Blocks of every round, until each group is a single block."""
    rounds = [_blocks(items)]
    left = rounds[0].agg(F.max("block")).first()[0] or 0
    while left > 0:
        last = rounds[-1]
        roots = last.select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).cast("long").alias("total"),
            F.element_at("levels", -1).cast("string").alias("digest"))
        rounds.append(_blocks(roots))
        left //= BLOCK
    return rounds


def _siblings(levels: Column, k: Column) -> Column:
    """What stands left and right of item ``k``'s way up through its block, level by level."""
    steps = F.slice(levels, F.lit(1), F.size(levels) - 1)

    def beside(level: Column, j: Column) -> Column:
        at = F.floor(k / F.pow(F.lit(ARITY), j)).cast("int")
        inside = at % ARITY
        left = F.substring(level, (at - inside) * HEX + 1, inside * HEX)
        right = F.substring(level, (at + 1) * HEX + 1, (ARITY - 1 - inside) * HEX)
        return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

    return F.transform(steps, beside)


def _descend(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """Items of the first round with their ``path``; ``top`` has each group's ``path`` above its subroot."""
    upper = top.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        ways = F.transform("items", lambda item, k: F.struct(
            item.alias("item"), F.concat(_siblings(F.col("levels"), k), F.col("path")).alias("path")))
        below = blocks.join(upper, ["grp", "block"]).select("grp", "subroot", "root", F.explode(ways).alias("way"))
        upper = below.select("grp", "subroot", "root", "way.path", F.col("way.item.pos").alias("block"), "way.item")
    return upper


def manifest(rows: DataFrame, group: Column, order: Column, digest: Column, carry: Column) -> DataFrame:
    """(row, leaf, subroot, root, path) for every row: ``path`` lists the siblings from leaf to root.

    Rows of a group ascend by ``order``, nulls first, equal ones by digest, so repeated rows are leaves beside
    each other. Groups ascend bytewise, null first; null is a group of its own, apart from ''. A lone leaf is
    its group's root, and a lone group's root is the root. An empty table gives no row. ``row`` is ``carry``,
    whatever the table's columns are called.
    """
    # '' is null and every other key starts with '=', which keeps the order and needs no null-safe join
    key = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    narrow = cut_lineage(rows.select(key.alias("grp"), order.alias("rank"), digest.alias("digest"), carry.alias("row")))
    rounds = _climb(_numbered(narrow, ["rank", "digest"]))
    subroots = rounds[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("row"), F.element_at("levels", -1).cast("string").alias("digest"))
    over = _climb(_numbered(subroots, ["row"]))
    root = over[-1].select("grp", F.element_at("levels", -1).cast("string").alias("root"),
                           F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"))
    top = _descend(over, root).select(F.col("item.row").alias("grp"), F.col("item.digest").alias("subroot"), "root", "path")
    return _descend(rounds, top).select("item.row", F.col("item.digest").alias("leaf"), "subroot", "root", "path")


def documents_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``manifest`` of documents by source and ``doc_id``; ``row`` is (doc_id, changed).

    ``tampered`` is a text to check against the manifest: ``changed`` is the leaf a row has with it, worked out anew
    for every row, also where the text is the same. Null and empty texts are different leaves. Columns other than
    the five are ignored.
    """
    told = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    changed = F.lit(None).cast("string") if tampered is None else leaf(*told, tampered)
    return manifest(docs, F.col("source"), F.col("doc_id"), leaf(*told, text), F.struct(F.col("doc_id"), changed.alias("changed")))
