"""Packing documents into token sequences by hierarchical residual best fit.

Every task tokenises its documents, cuts those that are too long, and packs its pieces by best fit
decreasing. Bins that are nearly full are emitted. The others go on as items: their fill is their size.
Each further round deals the remaining bins out at random to a fraction of the tasks and packs them
again, until one task holds them all or a round no longer saves bins. Where a bin ends up inside another
is kept as a small table; a piece's sequence and place are found by following it.

A round's tasks hold ``PER_TASK`` bins on average, so no group grows with the corpus: with few bins left
one task packs the last round, and a corpus whose pieces cannot be combined ends after the first round
that saves nothing. No piece and no bin is dropped or cut in the rounds.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speciframe.functions.tokens import byte_symbols
from speciframe.session import cut_lineage

from .common import in_small_batches

LENGTH = 1024
END = 2
#: Bins with no more than this much room are emitted by the first rounds.
SLACK = 2
PER_TASK = 100_000
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
# fixed value: what a pre-token of a byte-level file is
_PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """Ids of a byte-level BPE file. Its vocabulary numbers tokens in the order of their merges, which is
    all that the rank-based encoder needs; the file's special tokens are found in texts as they stand."""

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {b"".join([byte[c] for c in t]): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        ids = array("I", self.encoding.encode(text, allowed_special="all"))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for the first."""
    first = n if n <= length else (n - 1) % length + 1
    return [(0, first), *[(s, length) for s in range(first, n, length)]]


def best_fit(sizes: list[int], length: int = LENGTH) -> tuple[list[int], list[int], list[int]]:
    """Best fit decreasing: bin and offset of each item, and each bin's fill.

    ``rooms`` marks which amounts of room some open bin has; the lowest mark at or above a size is the best fit.
    """
    bins, offsets, fills = [0] * len(sizes), [0] * len(sizes), []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        open_rooms = rooms >> size
        if open_rooms:
            room = size + (open_rooms & -open_rooms).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = length, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, fills


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of every document, packed within their task: columns of the piece, ``bin`` and ``offset``
    there and the bin's ``fill``. Bin numbers are distinct between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        tokenizer, end = Tokenizer(path), END.to_bytes(4, "little")
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(tokenizer.ids(text) + end)
                for k, (start, size) in enumerate(cut(len(ids) // 4, length)):
                    rows.append((doc, k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
        if not rows:
            return
        bins, offsets, fills = best_fit([r[3] for r in rows], length)
        base = TaskContext.get().partitionId() << 40
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        own = np.array(bins, "i8")
        columns += [pa.array(own + base), pa.array(offsets, pa.int64()), pa.array(np.array(fills, "i8")[own])]
        table = pa.table(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])
        yield from table.to_batches(max_chunksize=65_536)

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"{_PIECES}, bin bigint, offset bigint, fill bigint")


def merge_round(bins: DataFrame, tasks: int, level: int, length: int = LENGTH) -> DataFrame:
    """(bin, fill) packed again as items: (bin, into, at, fill) with the number and fill of the new bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).sort_by("bin")  # the same bins for the same rows, whatever order they came in
        into, at, fills = best_fit(table.column("fill").to_pylist(), length)
        own = np.array(into, "i8")
        base = (level << 58) + (TaskContext.get().partitionId() << 34)
        yield from pa.table(
            [table.column("bin").combine_chunks(), pa.array(own + base), pa.array(at, pa.int64()), pa.array(np.array(fills, "i8")[own])],
            ["bin", "into", "at", "fill"],
        ).to_batches()

    dealt = bins.select("bin", "fill").repartition(tasks, F.xxhash64("bin", F.lit(level)))
    return dealt.mapInArrow(run, "bin bigint, into bigint, at bigint, fill bigint")


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Null text counts as empty: a document is at least the end id. Repeated rows are packed each.
    """
    placed = cut_lineage(pieces(docs, path, length))
    open_bins = placed.groupBy("bin").agg(F.max("fill").alias("fill")).filter(F.col("fill") < length - SLACK)
    left, level, chain = open_bins.count(), 0, None
    while left > 1:
        level += 1
        tasks = -(-left // PER_TASK)
        step = cut_lineage(merge_round(open_bins, tasks, level, length))
        merged = step.groupBy("into").agg(F.max("fill").alias("fill"), F.count("*").alias("held"))
        stats = merged.agg(F.count("*").alias("bins"), F.count(F.when(F.col("fill") < length, 1)).alias("open")).first()
        hop = step.select(F.col("bin").alias("_from"), F.col("into").alias("_into"), F.col("at").alias("_at"))
        if chain is None:
            chain = hop.select(F.col("_from").alias("bin"), F.col("_into").alias("last"), F.col("_at").alias("shift"))
        else:
            chain = (
                chain.join(hop, F.col("last") == F.col("_from"), "left")
                .select("bin", F.coalesce("_into", "last").alias("last"), (F.col("shift") + F.coalesce("_at", F.lit(0))).alias("shift"))
            )
        saved = left - stats["bins"]
        if tasks == 1 or saved * 1000 < left:
            break
        left = stats["open"]
        open_bins = merged.filter(F.col("fill") < length).select(F.col("into").alias("bin"), "fill")
    result = placed.drop("fill")
    if chain is None:
        return result.withColumnRenamed("bin", "sequence_id").select(*_COLUMNS)
    return (
        result.join(chain, "bin", "left")
        .withColumn("sequence_id", F.coalesce("last", "bin"))
        .withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
        .select(*_COLUMNS)
    )


_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
