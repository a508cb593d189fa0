"""Byte-pair encoding cut at forced boundaries.

A merge joins neighbouring symbols into a token of the vocabulary. Where two bytes meet that stand side
by side inside no token, no token can ever span the place: the cut is certain, the fragments on both
sides are encoded independently, and the ids are put together. White space is such a place for a
vocabulary that drops it, so texts first fall apart into chunks, which recur; each distinct chunk of a
task is normalised, pre-tokenised, cut at its forced boundaries and encoded once.

Vocabulary, merges, normaliser and pre-tokeniser are read from the tokenizer file; nothing is trained.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speciframe.functions.tokens import byte_symbols

from .common import in_small_batches

#: Distinct chunks a task remembers; what is forgotten is encoded anew, with the same results.
REMEMBERED = 500_000
#: Symbols of a fragment up to which looking at all pairs again is quicker than a heap; the ids are the same.
SHORT = 24
NONE = 1 << 60
_FIRST, _SECOND = itemgetter(0), itemgetter(1)
_LATIN = re.compile("[!-~\u00a1-\u012f\u0132-\u024f]*")


class Merges:
    """Vocabulary and merges of a BPE file, as numbers."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.steps = {
            (self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)
        }
        self.rank = {pair: rank for pair, (rank, _) in self.steps.items()}
        self.made = {rank: made for rank, made in self.steps.values()}
        self.symbol = byte_symbols()
        self.joined = _joined_pairs(self.vocab, self.suffix)

    def fragments(self, word: str) -> list[str]:
        """The word in the byte alphabet, cut where no token joins the two bytes."""
        cuts = [i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in self.joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def encode_fragment(self, fragment: str, closes: bool) -> list[int]:
        """Ids of a fragment; ``closes`` if it ends its word. The earliest merge goes first, leftmost first."""
        vocab = self.vocab
        ids = [vocab[c] for c in fragment]
        if closes and self.suffix:
            ids[-1] = vocab[fragment[-1] + self.suffix]
        return self._merged(ids) if len(ids) > SHORT else self._merged_short(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        rank, made = self.rank, self.made
        ranks = [rank.get(pair, NONE) for pair in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [made[low]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), NONE)
        return ids

    def _merged(self, ids: list[int]) -> list[int]:
        """The same for a fragment of any length, in n log n: pairs wait in a heap by rank and place, symbols
        are linked to their neighbours, and a pair that has changed since it was put there is passed over."""
        steps, n = self.steps, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(step[0], i, step[1], ids[i], ids[i + 1]) for i in range(n - 1) if (step := steps.get((ids[i], ids[i + 1])))]
        heapify(waiting)
        while waiting:
            _, i, made, left, right = heappop(waiting)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if step := steps.get((made, ids[k])):
                    heappush(waiting, (step[0], i, step[1], made, ids[k]))
            if (k := before[i]) >= 0 and (step := steps.get((ids[k], made))):
                heappush(waiting, (step[0], k, step[1], ids[k], made))
        return [x for x in ids if x >= 0]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of a pre-token: fragments between forced cuts are encoded independently, then joined."""
        symbol = self.symbol
        *front, end = self.fragments("".join([symbol[b] for b in word]))
        ids: list[int] = []
        for fragment in front:
            ids += self.encode_fragment(fragment, False)
        return ids + self.encode_fragment(end, True)


class Encoder:
    """Encodes with a word-level BPE file: white space dropped, words closed by a suffix."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.merges.vocab | self.special).items()}
        self.byte = {c: b for b, c in enumerate(self.merges.symbol)}
        pieces = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(pieces) + ")") if pieces else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.pairs: dict[str, tuple[bytes, str]] = {"": (b"", "")}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            ids = self.known[word] = self.merges.encode_word(word.encode())
        return ids

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids and spelled-out tokens of a stretch without spaces and line breaks.

        Latin letters need no normal form and have the same case and class in every Unicode version; other
        chunks are normalised and split by the tokenizer's own parts."""
        ids: list[int] = []
        if _LATIN.fullmatch(chunk):
            for word in self.words.findall(chunk.lower()):
                ids += self.word(word)
        else:
            plain = self.tokenizer.normalizer.normalize_str(chunk) if self.tokenizer.normalizer else chunk
            for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
                ids += self.merges.encode_word(bytes([self.byte[c] for c in word]))
        return b"".join([i.to_bytes(4, "little") for i in ids]), " ".join([self.token[i] for i in ids])

    def encode(self, text: str | None) -> tuple[list[bytes], list[str]]:
        """Ids as little-endian 32-bit numbers, and their tokens, chunk by chunk."""
        ids: list[bytes] = []
        tokens: list[str] = []
        if text:
            marked = self.marks.split(text) if self.marks and any(m in text for m in self.special) else (text,)
            for part in marked:
                if part in self.special:
                    ids.append(self.special[part].to_bytes(4, "little"))
                    tokens.append(part)
                    continue
                chunks = part.replace("\n", " ").split(" ")
                found = list(map(self.pairs.get, chunks))
                if None in found:
                    found = [self.pair(c) if f is None else f for c, f in zip(chunks, found)]
                ids += map(_FIRST, found)
                tokens += filter(None, map(_SECOND, found))
        return ids, tokens

    def pair(self, chunk: str) -> tuple[bytes, str]:
        """``chunk``, remembered. When the memory is full, what was not met since it was half full is forgotten."""
        pair = self.pairs.get(chunk) or self.older.get(chunk) or self.chunk(chunk)
        if len(self.pairs) >= REMEMBERED // 2:
            self.older, self.pairs = self.pairs, {"": (b"", "")}
        self.pairs[chunk] = pair
        return pair


def _joined_pairs(vocab: dict[str, int], suffix: str) -> set[str]:
    """Pairs of byte symbols that stand side by side inside a token."""
    pairs = set()
    for token in vocab:
        body = token[: -len(suffix)] if suffix and token.endswith(suffix) and token != suffix else token
        pairs.update(body[i : i + 2] for i in range(len(body) - 1))
    return pairs


def decode_ids(ids: bytes, encoder: Encoder) -> str:
    """Tokens of the ids, joined by spaces: the file names no decoder."""
    return " ".join(encoder.token[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4))


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "_ids") -> DataFrame:
    """``docs`` with the ids of the whole text as an array; null and empty texts have none."""

    @F.arrow_udf("array<int>")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        encoder = Encoder(path)
        for batch in texts:
            yield pa.array([np.frombuffer(b"".join(encoder.encode(t)[0]), "<i4") for t in batch.to_pylist()], pa.list_(pa.int32()))

    return in_small_batches(docs).withColumn(into, ids(F.col(text)))


def decode(encoded: DataFrame, path: str, ids: str = "_ids", into: str = "_decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give null."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = Encoder(path).token
        for batch in batches:
            yield pa.array([None if row is None else " ".join([token[i] for i in row]) for row in batch.to_pylist()], pa.string())

    return encoded.withColumn(into, texts(F.col(ids)))


def digests(docs: DataFrame, path: str, text: str = "text", into: str = "_coded") -> DataFrame:
    """``docs`` with number of ids, sha256 of the ids and sha256 of the decoded text, in one pass: ids are
    decoded as they are made, and neither list leaves the task."""
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digest(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path)
        for batch in texts:
            rows = []
            for t in batch.to_pylist():
                ids, tokens = encoder.encode(t)
                packed = b"".join(ids)
                rows.append({"n_tokens": len(packed) // 4, "ids_sha256": sha256(packed).hexdigest(),
                             "decoded_sha256": sha256(" ".join(tokens).encode()).hexdigest()})
            yield pa.array(rows, kind)

    return in_small_batches(docs).withColumn(into, digest(F.col(text)))
