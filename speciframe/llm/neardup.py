"""Near-duplicates by MinHash with tensored banding.

A text's set is its distinct shingles of ``size`` words. Two collections A and B of ``HALVES`` half keys of
``rows`` minhashes each give HALVES x HALVES table keys: a pair (A_i, B_j). So 2 * HALVES * rows minhashes
stand in for HALVES * HALVES * 2 * rows, about its square root. Rows follow from the threshold: as many as
leave a pair at the threshold without a shared key with probability below ``MISS`` (at 85 per cent four, as
2 * (1 - 0.85 ** 4) ** 16 is 1.5e-5; at 80 per cent three, 2.1e-5).

Candidates are verified on full sets. Texts with equal sets are one representative from the start. Key
counts, not key members, are gathered; a representative keeps a half key A_i if one of its keys (A_i, B_j)
has another member. The documents that share an A_i are dealt to tasks in chunks of at most about ``CHUNK``;
inside a chunk intersections of all sets are counted by one sparse product, and every chunk hands on its
connected components as stars, so output is linear in the members and no pair list is made. A bucket that
outgrows one chunk is dealt anew under each of the 16 half keys, so that its members meet in many
combinations. A first pass takes a quarter of the half keys; the second only buckets whose members are not
one component yet. What these leave of the large buckets is finished exactly by a third: members in
different components that share a bucket meet block by block, so no link depends on how a bucket was
dealt. Blocks of one component never meet one another, and blocks meet only where set sizes allow a link;
a group of copies of any size thus costs its size times the few strangers beside it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speciframe.session import cut_lineage

from .common import carried, in_small_batches, lowered_words_of

# the values of op7; callers with another rule give their own
SIZE = 3
THRESHOLD = 85  # per cent
HALVES = 16
MISS = 2.1e-5
CHUNK = 512
#: Members of a block; two blocks meet in one task.
BLOCK = CHUNK // 2
FIRST = 4

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    return (x ^ (x >> _SHIFT)) * _MIX


def _odd(n: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def rows_for(threshold: int) -> int:
    """Minhashes of a half key: the most that keep the bound on missed pairs, one at least."""
    missed = lambda rows: 2 * (1 - (threshold / 100) ** rows) ** HALVES
    return max([rows for rows in range(1, 33) if missed(rows) < MISS], default=1)


class Shingler:
    """Shingle sets of texts as sorted 64-bit hashes; remembers word hashes for a batch."""

    def __init__(self, size: int = SIZE):
        import xxhash

        self.size = size
        self.digest = xxhash.xxh3_64_intdigest
        self.known: dict[bytes, int] = {}
        self.factors = _odd(size, 7)

    def of(self, text: str | None) -> np.ndarray:
        words = lowered_words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.size:
            return np.array([self.digest(b" ".join(words), len(words))], np.uint64)
        known, digest = self.known, self.digest
        if len(known) > 200_000:
            known.clear()
        hashes = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            hashes[i] = h
        n = len(words) - self.size + 1
        x = np.zeros(n, np.uint64)
        for i, f in enumerate(self.factors):
            x += _mixed(hashes[i : n + i] * f)
        return np.unique(_mixed(x))


def half_keys(sets: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """HALVES * 2 half keys of a non-empty set."""
    low = np.full(len(functions), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 2048):
        np.minimum(low, (functions[:, None] * sets[None, at : at + 2048]).min(axis=1), out=low)
    rows = _mixed(low).reshape(2 * HALVES, -1)
    return _mixed((rows * _odd(rows.shape[1], 3)[None, :]).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], size: int, threshold: int) -> Iterator[pa.RecordBatch]:
    shingler, functions = Shingler(size), _odd(2 * HALVES * rows_for(threshold), 1)
    longs = pa.list_(pa.int64())
    for batch in batches:
        n, prints, a, b = [], [], [], []
        for text in batch.column(1).to_pylist():
            own = shingler.of(text)
            n.append(len(own))
            if len(own):
                keys = half_keys(own, functions)
                a.append(keys[:HALVES])
                b.append(keys[HALVES:])
                prints.append(_print(own))
            else:
                a.append(None)
                b.append(None)
                prints.append((0, 0))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([p[0] for p in prints], pa.int64()),
             pa.array([p[1] for p in prints], pa.int64()), pa.array(a, longs), pa.array(b, longs)],
            names=["doc_id", "n_shingles", "f1", "f2", "a", "b"],
        )


def _print(own: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    f = np.array([_mixed(own).sum(dtype=np.uint64), _mixed(own * _MIX + np.uint64(1)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return int(f[0]), int(f[1])


def signatures(docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, a, b): set size, set fingerprint and half keys of every row."""
    kind = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, a array<bigint>, b array<bigint>"
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(partial(_sign, size=size, threshold=threshold), kind)


def candidates(sets: DataFrame) -> DataFrame:
    """(id, i, ka): half keys under which a representative shares a whole table key with another."""
    a = sets.select("id", F.posexplode("a").alias("i", "ka"))
    shared = a.groupBy("i", "ka").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    live = cut_lineage(a.join(shared, ["i", "ka"]))  # most half keys belong to one set only
    keys = live.join(sets.select("id", "b"), "id").select("id", "i", "ka", F.posexplode("b").alias("j", "kb"))
    keys = keys.select("id", "i", "ka", F.xxhash64("i", "j", "ka", "kb").alias("key"))
    hit = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return keys.join(hit, "key").select("id", "i", "ka").distinct()


def _stars(batches: Iterator[pa.RecordBatch], size: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (i, ka, chunk, id, f1, f2, text): the components of each chunk as (id, least id)."""
    shingler = Shingler(size)
    group, key, out = {}, None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for i, ka, chunk, doc, f1, f2, text in zip(*columns):
            if (i, ka, chunk) != key:
                out += star(group, threshold)
                group, key = {}, (i, ka, chunk)
            if doc not in group:
                own = shingler.of(text)
                if _print(own) == (f1, f2):  # another text may bear the same id
                    group[doc] = own
        if out:
            yield _edges(out)
            out = []
    yield _edges(out + star(group, threshold))


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], names=["u", "v"])


def star(group: dict[int, np.ndarray], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """(id, least id) for the members of each component of the group's threshold graph."""
    ids = sorted(group)
    if len(ids) < 2:
        return []
    linked = links([group[i] for i in ids], threshold)
    left, found = np.ones(len(ids), bool), []
    for root in range(len(ids)):
        if not left[root]:
            continue
        reached = np.zeros(len(ids), bool)
        front = reached.copy()
        front[root] = True
        while front.any():
            reached |= front
            front = linked[front].any(axis=0) & ~reached
        left &= ~reached
        found += [(ids[m], ids[root]) for m in np.flatnonzero(reached) if m != root]
    return found


def links(sets: list[np.ndarray], threshold: int = THRESHOLD) -> np.ndarray:
    """Which pairs reach the threshold, from exact intersections."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        common = np.array([[sizes[0], 0], [0, sizes[1]]])
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        many = counts[column] > 1
        place = np.cumsum(counts > 1) - 1
        column, owner = place[column[many]], owner[many]
        common = np.zeros((len(sets), len(sets)), np.int64)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        width = 4096
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [at, at + width])
            block = np.zeros((len(sets), width), np.float32)
            block[owner[a:b], column[a:b] - at] = 1
            common += (block @ block.T).astype(np.int64)
        np.fill_diagonal(common, sizes)
    return 100 * common >= threshold * (sizes[:, None] + sizes[None, :] - common)


def verified(members: DataFrame, sets: DataFrame, docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """Components inside the chunks of candidate buckets, as edges (u, v) with u > v."""
    members = cut_lineage(members)
    sizes = members.groupBy("i", "ka").agg(F.count("*").alias("n"))
    dealt = members.join(sizes, ["i", "ka"]).select(
        "id", "i", "ka", F.pmod(F.xxhash64("id", "i"), F.ceil(F.col("n") / CHUNK)).alias("chunk"))
    return compared(dealt, members, sets, docs, size, threshold)


def compared(dealt: DataFrame, members: DataFrame, sets: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """Components of each (i, ka, chunk) of ``dealt``, whose ids are those of ``members``."""
    wanted = members.select("id").distinct().join(sets.select("id", "f1", "f2"), "id")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(wanted, "id")
    rows = dealt.join(texts, "id").select("i", "ka", "chunk", "id", "f1", "f2", "text")
    return (
        rows.repartition("i", "ka", "chunk").sortWithinPartitions("i", "ka", "chunk", "id")
        .mapInArrow(partial(_stars, size=size, threshold=threshold), "u bigint, v bigint")
    )


def blocks(found: DataFrame, label: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(id, i, ka, size, own, parts, k): the block of each member of the buckets that outgrew a chunk and
    are not one component. ``size`` is a class of set sizes (sets of a link lie in the same or in
    neighbouring classes), ``own`` the component of a block that holds no other, else ''."""
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / (0.001 - math.log(threshold / 100))).cast("int")
    named = found.join(label, "id", "left").select("id", "i", "ka", F.coalesce("component", "id").alias("c"))
    open_ = named.groupBy("i", "ka").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    open_ = open_.filter((F.col("n") > CHUNK) & (F.col("low") < F.col("high"))).select("i", "ka")
    left = cut_lineage(named.join(open_, ["i", "ka"]).join(sets.select("id", size.alias("size")), "id"))
    counts = left.groupBy("i", "ka", "size", "c").agg(F.count("*").alias("n"))
    counts = counts.withColumn("own", F.when(F.col("n") >= BLOCK, F.col("c").cast("string")).otherwise(""))
    parts = counts.groupBy("i", "ka", "size", "own").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"))
    owned = left.join(counts.select("i", "ka", "size", "c", "own"), ["i", "ka", "size", "c"])
    return owned.join(parts, ["i", "ka", "size", "own"]).select(
        "id", "i", "ka", "size", "own", "parts", F.pmod(F.xxhash64("id", "i"), F.col("parts")).alias("k"))


def finished(found: DataFrame, label: DataFrame, sets: DataFrame, docs: DataFrame, size: int = SIZE,
             threshold: int = THRESHOLD) -> DataFrame:
    """Links between the components that still share a large bucket, as edges (u, v) with u > v."""
    placed = cut_lineage(blocks(found, label, sets, threshold))
    kinds = placed.select("i", "ka", "size", "own", "parts").distinct()
    side = lambda tag: kinds.select("i", "ka", *[F.col(c).alias(f"{tag}_{c}") for c in ("size", "own", "parts")])
    ks = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1))
    near = side("x").withColumn("y_size", F.explode(F.array(F.col("x_size"), F.col("x_size") + 1)))
    same = F.col("x_size") == F.col("y_size")
    met = near.join(side("y"), ["i", "ka", "y_size"]).filter(
        ((F.col("x_own") != F.col("y_own")) & (~same | (F.col("x_own") < F.col("y_own"))))
        | ((F.col("x_own") == "") & (F.col("y_own") == "")))
    met = met.withColumn("x_k", ks("x_parts")).withColumn("y_k", ks("y_parts")).filter(
        ~same | (F.col("x_own") != F.col("y_own")) | (F.col("x_k") <= F.col("y_k")))
    cells = cut_lineage(met.withColumn("cell", F.monotonically_increasing_id()))
    place = ["i", "ka", "size", "own", "k"]
    end = lambda tag: cells.select("cell", "i", "ka", *[F.col(f"{tag}_{c}").alias(c) for c in place[2:]])
    dealt = placed.join(end("x").union(end("y")).distinct(), place).select(
        "id", F.lit(0).alias("i"), F.col("cell").alias("ka"), F.lit(0).alias("chunk"))
    return compared(dealt, placed, sets, docs, size, threshold)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id that is not itself the least.

    Alternating stars: each vertex hands its larger neighbours, then its smaller ones, to the least vertex
    it knows. Rounds are few (logarithmic in the size of a component); each is a written table of at most
    as many edges, and minima are taken before anything is joined.
    """
    star = lambda e: (e.count(), e.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0])
    edges = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = star(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut_lineage(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        new = star(edges)
        if new == state:
            break
        state = new
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")


def groups(docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row. Sets of ``size`` words link from ``threshold`` per cent.

    Null and blank texts have no shingles and stand alone; a null id stands alone and has a null component;
    rows that repeat an id share its component, the least among the components of its texts' sets.
    """
    signed = cut_lineage(signatures(docs, size, threshold))
    first = F.min(F.struct("doc_id", "a", "b"))
    sets = cut_lineage(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(
            first.alias("r"), F.max("n_shingles").alias("n_shingles"))
        .select(F.col("r.doc_id").alias("id"), "f1", "f2", "n_shingles", "r.a", "r.b")
    )
    found = cut_lineage(candidates(sets))
    edges = cut_lineage(verified(found.filter(F.col("i") < FIRST), sets, docs, size, threshold))
    known = cut_lineage(components(edges))
    # buckets whose members are not yet one component
    rest = found.filter(F.col("i") >= FIRST).join(known, "id", "left").withColumn("c", F.coalesce("component", "id"))
    mixed = rest.groupBy("i", "ka").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("i", "ka")
    star = lambda named: named.select(F.col("id").alias("u"), F.col("component").alias("v"))
    edges = star(known).union(verified(rest.join(mixed, ["i", "ka"]).select("id", "i", "ka"), sets, docs, size, threshold))
    known = cut_lineage(components(edges))
    label = cut_lineage(components(star(known).union(finished(found, known, sets, docs, size, threshold))))
    named = sets.select("id", "f1", "f2").join(label, "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("_component"))
    return (
        signed.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(
            F.when(F.col("n_shingles") > 0, F.col("_component")), F.col("doc_id"))).alias("component_id"))
    )


def keep_one(docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group: the one with the least id. Rows that repeat an id count as copies of
    it, and the first in the order of their texts stays; rows without an id all stay."""
    kept = groups(docs, size, threshold).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept")).distinct()
    every = carried(docs, "doc_id", "text")
    rows = every.filter(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id") == F.col("kept"), "left_semi")
    first = rows.groupBy("doc_id").agg(F.min_by("row", F.struct(F.col("text").isNull(), F.col("text"))).alias("row"))
    return first.select("row.*").unionByName(every.filter(F.col("doc_id").isNull()).select("row.*"))
