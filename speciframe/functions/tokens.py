"""Subword coding, context framing and the length-reducing strategies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import seeded_int, seeded_key
from .text import SPECIAL_TOKENS, cleaner, portions, pretokenize

# End-of-word mark, default context length, priority of tag prefixes.
WORD_END = "</w>"
CONTEXT_LENGTH = 77
TAG_PRIORITY = (("NN", 1), ("JJ", 2), ("VB", 3))
OTHER_PRIORITY = 4
# Words whose ids are put together at a time.
_STEP = 1 << 17


def byte_symbols() -> list[str]:
    """One printable character per byte value: printable Latin-1 bytes stand for themselves, the
    others are numbered upwards from 256 in byte order."""
    spare = iter(range(256, 512))
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids of the byte symbols, their word-final forms, the merges, and the special tokens.

    The byte symbols come first, printable bytes before the others.
    """

    def __init__(self, merges: Sequence[tuple[str, str]] = (), special: Sequence[str] = SPECIAL_TOKENS):
        symbols = byte_symbols()
        printable = [s for b, s in enumerate(symbols) if s == chr(b)]
        base = printable + [s for b, s in enumerate(symbols) if s != chr(b)]
        self.merges = [tuple(m) for m in merges]
        self.entries = base + [s + WORD_END for s in base] + ["".join(m) for m in self.merges] + list(special)
        self.special = tuple(special)
        self.ids = {entry: i for i, entry in enumerate(self.entries)}
        self.start_id = self.ids[special[0]]
        self.end_id = self.ids[special[1]]

    def encoder(self):
        """A function from word to ids. Words repeat, so results are remembered (bounded)."""
        ranks = {pair: r for r, pair in enumerate(self.merges)}
        symbols = byte_symbols()
        ids, special = self.ids, set(self.special)
        known: dict[str, list[int]] = {}

        def encode(word: str) -> list[int]:
            if word in special:
                return [ids[word]]
            hit = known.get(word)
            if hit is not None:
                return hit
            parts = [symbols[b] for b in word.encode("utf-8")]
            parts[-1] += WORD_END
            while len(parts) > 1:
                best = min(zip(parts, parts[1:]), key=lambda pair: ranks.get(pair, len(ranks)))
                if best not in ranks:
                    break
                merged: list[str] = []
                for part in parts:
                    if merged and merged[-1] == best[0] and part == best[1]:
                        merged[-1] += part
                    else:
                        merged.append(part)
                parts = merged
            out = [ids[p] for p in parts]
            if len(known) < 200_000:
                known[word] = out
            return out

        return encode

    def piece_bytes(self) -> list[bytes]:
        """The bytes of every id."""
        to_byte = {s: b for b, s in enumerate(byte_symbols())}
        return [bytes(to_byte[ch] for ch in entry) for entry in self.entries]


def _coded(words: pa.ListArray, encode) -> pa.ListArray:
    """Lists of words as lists of ids: distinct words are encoded once and put together by index."""
    coded = words.flatten().dictionary_encode()
    pieces = [np.asarray(encode(w), dtype=np.int32) for w in coded.dictionary.to_pylist()]
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    word = coded.indices.to_numpy()
    if len(word):
        starts, parts = np.cumsum(sizes) - sizes, np.concatenate(pieces)
        ends = np.cumsum(sizes[word])
        ids = np.empty(ends[-1], np.int32)
        for at in range(0, len(word), _STEP):
            here, first = word[at : at + _STEP], ends[at - 1] if at else 0
            shift = np.repeat(starts[here] - (ends[at : at + _STEP] - sizes[here]), sizes[here])
            last = first + len(shift)
            ids[first:last] = parts[np.arange(first, last) + shift]
    else:
        ends, ids = np.zeros(0, np.int64), np.zeros(0, np.int32)
    last_word = np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    offsets = np.concatenate([[0], np.concatenate([[0], ends])[last_word]]).astype(np.int32)
    missing = pa.array(words.is_null()) if words.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=missing)


def encode_words(words, vocabulary: Vocabulary) -> Column:
    """Array of words to array of token ids. Map-side: no shuffle of word occurrences. A batch is worked on in
    portions of bounded bytes, so that its size does not set the memory of a task."""
    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = vocabulary.encoder()
        for batch in batches:
            n_words = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            n_bytes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.flatten()), 0).to_numpy(zero_copy_only=False))])
            ends = n_bytes[np.cumsum(n_words)]
            if not len(batch):
                yield _coded(batch, encode)
            for start, n in portions(np.diff(ends, prepend=0)):
                yield _coded(batch.slice(start, n), encode)

    return run(F.col(words) if isinstance(words, str) else words)


def encode_text(text, vocabulary: Vocabulary, mode: str = "lower") -> Column:
    return encode_words(pretokenize(cleaner(mode)(text), vocabulary.special), vocabulary)


def decode_tokens(tokens, vocabulary: Vocabulary) -> Column:
    """Ids to text; bytes that are not UTF-8 become replacement marks, unknown ids nothing."""
    pieces = F.split(F.lit(" ".join(piece.hex() for piece in vocabulary.piece_bytes())), " ")
    joined = F.unhex(F.array_join(F.transform(_ints(tokens), lambda t: F.get(pieces, t)), ""))
    return F.replace(F.make_valid_utf8(joined.cast("string")), F.lit(WORD_END), F.lit(" "))


def _ints(tokens) -> Column:
    return (F.col(tokens) if isinstance(tokens, str) else tokens).cast("array<int>")


def _pad(tokens: Column, length, value: int = 0) -> Column:
    missing = F.greatest(F.lit(length) - F.size(tokens), F.lit(0))
    return F.concat(tokens, F.array_repeat(F.lit(value), missing))


def frame_tokens(tokens, start_id: int, end_id: int, length: int = CONTEXT_LENGTH) -> Column:
    """Start + tokens + end, cut to ``length`` with the last one the end mark, zero padded."""
    body = F.slice(_ints(tokens), 1, length - 2)
    return _pad(F.concat(F.array(F.lit(start_id)), body, F.array(F.lit(end_id))), length)


def frame_with_class_token(
    tokens, start_id: int, end_id: int, class_id: int, pad_id: int = 0, length: int = CONTEXT_LENGTH
) -> Column:
    """Start + tokens + end, padded, then a final class token."""
    body = F.slice(_ints(tokens), 1, length - 3)
    framed = F.concat(F.array(F.lit(start_id)), body, F.array(F.lit(end_id)))
    return F.concat(_pad(framed, length - 1, pad_id), F.array(F.lit(class_id)))


def blank_separator(tokens, separator_id: int) -> Column:
    """Separator ids replaced by 0."""
    return F.transform(_ints(tokens), lambda t: F.when(t == separator_id, F.lit(0)).otherwise(t))


def _hash_ordered(tokens: Column, seed, key) -> Column:
    """(hash, position, token) structs in hash order."""
    marked = F.transform(
        tokens,
        lambda t, i: F.struct(seeded_key(seed, key, i).alias("h"), i.alias("i"), t.alias("t")),
    )
    return F.array_sort(marked)


def reduce_random(tokens, key, seed, keep: int, shuffle: bool = False) -> Column:
    """At most ``keep`` tokens chosen at random, in text order or (``shuffle``) in drawn order.
    A shorter text stays as it is."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    chosen = F.slice(_hash_ordered(t, seed, key), 1, keep)
    if shuffle:
        reduced = F.transform(chosen, lambda s: s["t"])
    else:
        by_place = F.array_sort(F.transform(chosen, lambda s: F.struct(s["i"].alias("i"), s["t"].alias("t"))))
        reduced = F.transform(by_place, lambda s: s["t"])
    return F.when(F.size(t) > keep, reduced).otherwise(t)


def reduce_block(tokens, key, seed, keep: int) -> Column:
    """A random contiguous block of ``keep`` tokens."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    start = F.pmod(seeded_int(seed, key), (F.size(t) - keep + 1).cast("bigint")).cast("int")
    return F.when(F.size(t) > keep, F.slice(t, start + 1, F.lit(keep))).otherwise(t)


def tag_priority(tag) -> Column:
    """Noun before adjective before verb before anything else."""
    c = F.col(tag) if isinstance(tag, str) else tag
    out = F.when(c.startswith(TAG_PRIORITY[0][0]), TAG_PRIORITY[0][1])
    for prefix, rank in TAG_PRIORITY[1:]:
        out = out.when(c.startswith(prefix), rank)
    return out.otherwise(OTHER_PRIORITY)


def reduce_priority(
    df: DataFrame, lexicon: DataFrame, key: str, words: str, keep: int, out: str = "reduced"
) -> DataFrame:
    """The ``keep`` words of highest priority, in text order. Tags come from ``lexicon(word,
    tag)``; unknown words count as other. The lexicon side goes broadcast or not by its size."""
    tags = lexicon.groupBy("word").agg(F.min(tag_priority("tag")).alias("_p"))
    rows = df.select(key, F.posexplode_outer(words).alias("_i", "word"))
    tagged = rows.join(tags, "word", "left")
    entry = F.struct(F.coalesce("_p", F.lit(OTHER_PRIORITY)).alias("p"), F.col("_i").alias("i"), F.col("word").alias("w"))
    grouped = tagged.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), entry))).alias("_e"))
    chosen = F.array_sort(
        F.transform(F.slice("_e", 1, keep), lambda e: F.struct(e["i"].alias("i"), e["w"].alias("w")))
    )
    return grouped.select(key, F.transform(chosen, lambda e: e["w"]).alias(out))


REDUCERS = {
    "simple": reduce_block,
    "random": reduce_random,
    "shuffle": lambda tokens, key, seed, keep: reduce_random(tokens, key, seed, keep, shuffle=True),
}


def reducer(mode: str):
    """Column function of a reduction mode; ``syntax`` needs a lexicon, see reduce_priority."""
    if mode not in REDUCERS:
        raise ValueError(f"reduction must be one of {', '.join(REDUCERS)} or syntax, not {mode!r}")
    return REDUCERS[mode]


def split_text_for_priority(text) -> Column:
    return F.filter(F.split(F.col(text) if isinstance(text, str) else text, r"(?U)\s+"), lambda w: w != "")
