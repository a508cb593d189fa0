"""Stupid-backoff scores of every document against the rest of the corpus.

Documents are dealt to blocks by a hash of their id. A block counts its distinct n-grams of each order up to
``ORDER`` once and sends them, split by a range of their hash, to the count tables; a table adds up what all
blocks sent and answers each block with the totals of just its n-grams. The block joins the totals to the
n-grams of its documents and sums the logarithms per document. What moves is the text once, each block's
distinct n-grams, and their totals; a frequent n-gram is one row in a block however often it occurs there.

A document's own counts are taken off the totals, so that its score says how well the others predict it:
the highest order whose count elsewhere is positive gives count(n-gram) / count(context), every step down
costs a factor ``BACKOFF``, and a word found nowhere else counts as 1 of N + 1 words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered_words_of

ORDER = 2
BACKOFF = 0.4
#: Bytes of text in a block on average. Tables are as many as blocks.
BLOCK_BYTES = 12 << 20

_MIX = np.uint64(0x9FB21C651E98DF25)
_COUNTS = "block int, part int, level int, keys binary, counts binary"
_TOTALS = "block int, part int, level int, totals binary"
_SCORES = "doc_id bigint, n_tokens bigint, n_seen bigint, log_score double"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(28))) * _MIX
    return x ^ (x >> np.uint64(29))


class Stream:
    """The words of a block's documents one after the other, and the n-grams that end at each word."""

    def __init__(self, texts: list[str | None]):
        import xxhash

        known: dict[bytes, int] = {}
        digest, parts, sizes = xxhash.xxh3_64_intdigest, [], []
        for text in texts:
            words = lowered_words_of(text)
            sizes.append(len(words))
            own = np.empty(len(words), np.uint64)
            for i, w in enumerate(words):
                h = known.get(w)
                if h is None:
                    h = known[w] = digest(w)
                own[i] = h
            parts.append(own)
        self.sizes = np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        self.words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.words)) - starts[self.doc]

    def grams(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where an n-gram of ``level`` words ends, and its hash."""
        ends = np.flatnonzero(self.place >= level - 1)
        value = np.full(len(ends), np.uint64(level))
        for back in range(level - 1, -1, -1):
            value = _mixed(value + self.words[ends - back])
        return ends, value


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, lowest bytes of all first: the zeros of small numbers lie together and
    vanish when the exchange is compressed."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _count(parts: int, order: int):
    def run(key, table):
        stream = Stream(table.column("text").to_pylist())
        rows = []
        width = (1 << 64) // parts + 1
        for level in range(1, order + 1):
            keys, counts = np.unique(stream.grams(level)[1], return_counts=True)
            cuts = np.searchsorted(keys, np.array([p * width for p in range(1, parts)], np.uint64)) if parts > 1 else []
            for part, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts))):
                if len(k):
                    gaps = np.diff(k, prepend=np.uint64(0))  # small numbers compress
                    rows.append((key[0].as_py(), part, level, _planes(gaps), _planes(c.astype(np.uint64))))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["block", "part", "level", "keys", "counts"])

    return run


def _totals(key, table):
    """Adds up the counts of one range of hashes; each block gets the totals in the order of its n-grams."""
    levels = table.column("level").to_pylist()
    keys = [np.cumsum(_numbers(k), dtype=np.uint64) for k in table.column("keys").to_pylist()]
    counts = [_numbers(c) for c in table.column("counts").to_pylist()]
    out: list[bytes] = [b""] * len(levels)
    for level in set(levels):
        rows = [i for i, x in enumerate(levels) if x == level]
        _, place = np.unique(np.concatenate([keys[i] for i in rows]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([counts[i] for i in rows])).astype(np.uint64)
        found = np.split(total[place], np.cumsum([len(keys[i]) for i in rows])[:-1])
        for i, t in zip(rows, found):
            out[i] = _planes(t)
    names = ["block", "part", "level"]
    return pa.table([*[table.column(n).cast(pa.int32()) for n in names], pa.array(out, pa.binary())], [*names, "totals"])


def _score(n_words: int, order: int):
    def run(key, docs, totals):
        stream = Stream(docs.column("text").to_pylist())
        tables: dict[int, list[np.ndarray]] = {level: [] for level in range(1, order + 1)}
        for level, _, found in sorted(zip(*[totals.column(c).to_pylist() for c in ("level", "part", "totals")]), key=lambda r: r[:2]):
            tables[level].append(_numbers(found))
        n = len(stream.words)
        others = (n_words - stream.sizes)[stream.doc]
        # counts elsewhere of the n-gram of each order that ends at each word
        elsewhere = np.zeros((order + 1, n), np.int64)
        for level in range(1, order + 1):
            ends, value = stream.grams(level)
            if len(ends):
                _, place = np.unique(value, return_inverse=True)  # ranges of hashes ascend, as the n-grams do
                total = np.concatenate(tables[level])[place].astype(np.int64)
                elsewhere[level, ends] = total - _within(value, stream.doc[ends])
        score = np.log(np.maximum(elsewhere[1], 0.0) / np.maximum(others, 1), where=elsewhere[1] > 0, out=-np.log(others + 1.0))
        depth = np.where(elsewhere[1] > 0, 1, 0)
        steps = np.minimum(stream.place + 1, order) - 1  # orders above the word's own that the place allows
        score += steps * math.log(BACKOFF)
        for level in range(2, order + 1):
            seen = np.flatnonzero(elsewhere[level] > 0)
            if len(seen):
                score[seen] = np.log(elsewhere[level, seen] / elsewhere[level - 1, seen - 1]) + (steps[seen] - level + 1) * math.log(BACKOFF)
                depth[seen] = level
        rows = len(stream.sizes)
        return pa.table({
            "doc_id": docs.column("doc_id").cast(pa.int64()),
            "n_tokens": pa.array(stream.sizes, pa.int64()),
            "n_seen": pa.array(np.bincount(stream.doc, weights=depth == order, minlength=rows).astype(np.int64)),
            "log_score": pa.array(np.bincount(stream.doc, weights=score, minlength=rows).astype(float)),
        })

    return run


def _within(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs in its own document."""
    _, place, counts = np.unique(_mixed(value + _mixed(doc.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    return counts[place]


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_tokens, n_seen, log_score) for every row: words, words whose highest-order n-gram occurs
    in another document, and the sum of the logarithms of their scores.

    Null and blank texts have no words and score 0; copies of a document (also rows that repeat an id) count
    as other documents.
    """
    size, words = docs.agg(
        F.sum(F.octet_length("text")),
        F.sum(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")),
    ).first()
    blocks = -(-(size or 1) // BLOCK_BYTES)
    dealt = docs.select(
        F.col("doc_id").cast("bigint"), "text", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int").alias("block"))
    counts = dealt.groupBy("block").applyInArrow(_count(blocks, order), _COUNTS)
    totals = counts.groupBy("part").applyInArrow(_totals, _TOTALS)
    return dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_score(int(words or 0), order), _SCORES)
