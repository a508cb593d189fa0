"""The prefix trie of conversations: union-find over the shared depths of sorted neighbours.

A conversation is one row: 16 bytes and a length a turn. Rows are sorted by their bytes, range-partitioned,
so the members of any node stand side by side. A task takes the depth that each row shares with the next and
unites neighbours in descending depth; every union makes, or widens, a branching node. The nodes between
two branching ones have the members of the lower one and are written out from it.

Only a node that holds a partition's first or last row can go on in a neighbouring partition. All others
are final. The open ones, one path at either end of a partition with everything beside it contracted into
sums, are merged by key; what two neighbours share is counted twice in these sums, which a few rows per
boundary correct. Conversations that end in a node are hashed as a stream, so a group of copies may be of any
size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speciframe.session import cut_lineage

#: Bytes of a turn in a conversation's key.
TURN = 16
#: Bytes of keys that a task sorts and holds, about; a conversation counts 64 besides its turns.
TASK_BYTES = 8 * 1024 * 1024
#: Conversations in a piece of the list of those that end in an open node.
PIECE = 65_536
NOTHING = hashlib.sha256(b"").hexdigest()

_FINAL, _OPEN, _ENDS, _EDGE = range(4)
_ROWS = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("side", pa.int32()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("sums", pa.list_(pa.int64())),
])
_DDL = ("kind int, part int, side int, depth bigint, node binary, parent binary, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
        "n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, first binary, last binary, sums array<bigint>")
_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs (turn, digest, chars).

    Turns ascend by ``turn``, null first; equal ones by the digest of role and text, so repeated rows are turns
    of their own beside each other. Null role or text counts as ''. Rows without ``conv_id`` take no part, and
    other columns are ignored. A conversation is gathered in one row of some 40 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col("turn"), F.unhex(F.md5(told.cast("binary"))).alias("digest"), F.char_length(text).alias("chars"))
    return turns.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def path_of(turns: Column) -> tuple[Column, Column]:
    """``key`` and ``chars`` of ordered turns: digests laid end to end, and code points per turn."""
    key = F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["digest"])), ""))
    return key.alias("key"), F.transform(turns, lambda t: t["chars"]).alias("chars")


def shared(a: bytes, b: bytes) -> int:
    """Number of leading turns that two keys have in common."""
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    while low + 1 < high:
        middle = (low + high) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle
    return low


def names(key: bytes) -> list[bytes]:
    """A name for each prefix of a key, the empty one first."""
    out = [b"\0" * TURN]
    for at in range(0, len(key), TURN):
        out.append(hashlib.blake2b(out[-1] + key[at : at + TURN], digest_size=TURN).digest())
    return out


class Forest:
    """Compressed trie of sorted, distinct keys. ``sums[i][d]`` is the length of key i's first d turns."""

    def __init__(self, keys: list[bytes], sums: list, ids: list):
        n = len(keys)
        self.sums, self.ids = sums, ids
        self.depth = [len(k) // TURN for k in keys]
        self.low, self.high, self.parent = list(range(n)), list(range(n)), [-1] * n
        self.members, self.least = [len(x) for x in ids], [x[0] for x in ids]
        self.children, self.leaves, self.below = [0] * n, [1] * n, [0] * n
        shares = [shared(a, b) for a, b in zip(keys, keys[1:])]
        over, top = list(range(n)), list(range(n))

        def find(x: int) -> int:
            while over[x] != x:
                over[x] = x = over[over[x]]
            return x

        for i in sorted(range(n - 1), key=lambda i: -shares[i]):  # of equal depths the left one first
            a, b = find(i), find(i + 1)
            node = top[a]
            if self.depth[node] > shares[i]:
                node = self._branch(shares[i], top[a])
            self._hang(top[b], node)
            small, large = (a, b) if self.high[top[a]] - self.low[top[a]] < self.high[top[b]] - self.low[top[b]] else (b, a)
            over[small], top[large] = large, node

    def _branch(self, depth: int, first: int) -> int:
        for column, value in ((self.depth, depth), (self.low, self.low[first]), (self.high, self.low[first]), (self.parent, -1), (self.members, 0),
                              (self.least, self.least[first]), (self.children, 0), (self.leaves, 0), (self.below, 0)):
            column.append(value)
        self._hang(first, node := len(self.depth) - 1)
        return node

    def _hang(self, child: int, node: int) -> None:
        if not self.children[node]:
            self.leaves[node] = 0  # conversations may end here, yet others go on
        self.parent[child] = node
        self.children[node] += 1
        self.high[node] = max(self.high[node], self.high[child])
        self.members[node] += self.members[child]
        self.least[node] = min(self.least[node], self.least[child])
        self.leaves[node] += self.leaves[child]
        self.below[node] += self.saved(child, self.depth[node] + 1)

    def saved(self, node: int, depth: int) -> int:
        """What is saved in the subtree of ``node`` and along the way up to ``depth``, inclusive."""
        sums = self.sums[self.low[node]]
        return self.below[node] + (self.members[node] - 1) * (sums[self.depth[node]] - (sums[depth - 1] if depth else 0))


def _digest(pieces) -> str:
    told = hashlib.sha256()
    for k, piece in enumerate(pieces):
        told.update(("," if k else "").encode() + piece.encode())
    return told.hexdigest()


def _pieces(ids) -> Iterator[str]:
    for at in range(0, len(ids), PIECE):
        yield ",".join(map(str, ids[at : at + PIECE]))


def _partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final nodes, open nodes, ends of open nodes, and the two outer keys of one sorted partition."""
    from array import array
    from itertools import accumulate

    from pyspark import TaskContext

    keys, sums, ids = [], [], []
    for batch in batches:
        lengths = batch.column("chars")
        for k, (conv, key) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("key").to_pylist())):
            if not keys or keys[-1] != key:
                keys.append(key)
                sums.append(array("q", accumulate(lengths[k].as_py(), initial=0)))
                ids.append(array("q"))
            ids[-1].append(conv)
    if not keys:
        return
    part, end = TaskContext.get().partitionId(), len(keys) - 1
    forest = Forest(keys, sums, ids)
    sides = names(keys[0]), names(keys[-1])

    def side(node: int) -> int | None:
        return 0 if forest.low[node] == 0 else 1 if forest.high[node] == end else None

    rows: list[dict] = [{"kind": _EDGE, "part": part, "first": keys[0], "last": keys[-1], "sums": list(sums[0])}]
    for node, depth in enumerate(forest.depth):
        parent, own = forest.parent[node], side(node)
        above = forest.depth[parent] if parent >= 0 else -1
        here = forest.ids[node] if node <= end else []
        for d in range(above + 1, depth + 1):
            row = {"kind": _FINAL, "part": part, "depth": d, "conv_id": forest.least[node], "n_convs": forest.members[node],
                   "n_children": forest.children[node] if d == depth else 1, "n_leaves": forest.leaves[node], "saved_tokens": forest.saved(node, d)}
            if own is not None:
                row |= {"kind": _OPEN, "side": own, "node": sides[own][d], "parent": sides[own][d - 1] if d else None}
            else:
                row["ends"] = _digest(_pieces(here)) if d == depth and here else NOTHING
                if d > above + 1:
                    row["parent_conv_id"] = forest.least[node]
                elif side(parent) is None:
                    row["parent_conv_id"] = forest.least[parent]
                else:
                    row["side"] = side(parent)
            rows.append(row)
        if own is not None:
            rows += [{"kind": _ENDS, "part": part, "node": sides[own][depth], "conv_id": k, "ends": p} for k, p in enumerate(_pieces(here))]
        if len(rows) >= 20_000:
            yield pa.RecordBatch.from_pylist(rows, _ROWS)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, _ROWS)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the open nodes on either side of a boundary count twice."""
    schema = pa.schema([("node", pa.binary()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])
    for batch in batches:
        for last, first, sums in zip(*[batch.column(c).to_pylist() for c in ("before", "first", "sums")]):
            both = shared(last, first)
            continued = both == len(last) // TURN  # the last node before the boundary was taken for a leaf
            told = names(first[: both * TURN])
            yield pa.RecordBatch.from_pylist([
                {"node": told[d], "n_children": -int(d < both), "n_leaves": -int(continued), "saved_tokens": sums[both] - (sums[d - 1] if d else 0)}
                for d in range(both + 1)], schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) from pieces in order; only a hash state and one piece are held."""
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    node, told = None, None
    for batch in batches:
        done = []
        for name, piece in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if name != node:
                if told:
                    done.append({"node": node, "ends_sha256": told.hexdigest()})
                node, told = name, hashlib.sha256()
            else:
                told.update(b",")
            told.update(piece.encode())
        yield pa.RecordBatch.from_pylist(done, schema)
    if told:
        yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": told.hexdigest()}], schema)


def trie(paths: DataFrame) -> DataFrame:
    """Every node of the trie of (conv_id, key, chars), see ``path_of``; ``conv_id`` is distinct and not null.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a node is named by
    the smallest conversation through it and its depth. Conversations without turns end in the root. An empty
    table has no root. Copies are members of the same nodes, however many there are.
    """
    spark = paths.sparkSession
    paths = cut_lineage(paths.select("conv_id", "key", "chars"))
    size = paths.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    ordered = paths.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = cut_lineage(ordered.mapInArrow(_partition, _DDL))

    def of(kind: int) -> DataFrame:
        return rows.filter(F.col("kind") == kind)

    # a row per partition
    edges = of(_EDGE).select("first", "sums", F.lag("last").over(Window.orderBy("part")).alias("before")).filter(F.col("before").isNotNull())
    twice = edges.mapInArrow(_corrections, "node binary, n_children bigint, n_leaves bigint, saved_tokens bigint")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = cut_lineage(
        of(_OPEN).select("node", "parent", "depth", "conv_id", *sums).unionByName(twice, allowMissingColumns=True)
        .groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
                             *[F.sum(c).alias(c) for c in sums]))
    ends = (of(_ENDS).select("node", "part", "conv_id", "ends").repartition("node").sortWithinPartitions("node", "part", "conv_id")
            .mapInArrow(_hashed, "node binary, ends_sha256 string"))
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    opened = merged.join(parents, "parent", "left").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    # a final node below an open one learns its parent by partition, side and depth, which no key repeats beyond a partition
    known = of(_OPEN).select("node", "part", "side", F.col("depth").alias("above")).join(parents.withColumnRenamed("parent", "node"), "node")
    final = of(_FINAL).withColumnRenamed("ends", "ends_sha256")
    told = final.filter("parent_conv_id IS NOT NULL").select(*_COLUMNS)
    asking = final.filter("parent_conv_id IS NULL").drop("parent_conv_id", "node").withColumn("above", F.col("depth") - 1)
    return opened.select(*_COLUMNS).unionByName(told).unionByName(asking.join(known, ["part", "side", "above"]).select(*_COLUMNS))
