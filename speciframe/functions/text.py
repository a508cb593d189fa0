"""Text cleaning and pre-tokenising."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as the reference language's ``str.split`` sees it, the ASCII
# punctuation class, and the pre-token pattern (contractions, letter runs, single digits,
# symbol runs).
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
SPECIAL_TOKENS = ("<start_of_text>", "<end_of_text>")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Text that was UTF-8 but got decoded as cp1252: a lead character followed by the right number of
# continuation characters, each seen through that code page.
def _seen_through_cp1252(first: int, last: int) -> str:
    out = []
    for byte in range(first, last + 1):
        try:
            out.append(bytes([byte]).decode("cp1252"))
        except UnicodeDecodeError:
            out.append(chr(byte))
    return "".join(out)


_TAIL = "[" + re.escape(_seen_through_cp1252(0x80, 0xBF)) + "]"
_MOJIBAKE = re.compile(
    f"[{re.escape(_seen_through_cp1252(0xC3, 0xDF))}]{_TAIL}"
    f"|[{re.escape(_seen_through_cp1252(0xE0, 0xEF))}]{_TAIL}{{2}}"
    f"|[{re.escape(_seen_through_cp1252(0xF0, 0xF4))}]{_TAIL}{{3}}"
)


def _repair(match: re.Match) -> str:
    raw = bytearray()
    for ch in match.group():
        try:
            raw += ch.encode("cp1252")
        except UnicodeEncodeError:
            raw.append(ord(ch))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return match.group()


# What a repaired text no longer contains, and what stands for it.
LINE_BREAKS = re.compile("\r\n|\r|\u2028|\u2029|\x85")
TERMINAL_ESCAPES = re.compile(r"\x1b\[[0-9;]*[a-zA-Z]")
REPLACED = {
    **dict.fromkeys(map(ord, "\u2018\u2019\u201a\u201b"), "'"),
    **dict.fromkeys(map(ord, "\u201c\u201d\u201e\u201f"), '"'),
    0x0132: "IJ", 0x0133: "ij", 0x0149: "\u02bcn", 0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl",
    0xFB05: "\u017ft", 0xFB06: "st", 0x3000: " ",
    **{c: unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFFEF)},
    **dict.fromkeys([*range(0x00, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F, *range(0x206A, 0x2070), 0xFEFF, *range(0xFFF9, 0xFFFD)]),
}


def repair(text: str) -> str:
    """Text decoded with the wrong code page put right; plain quotes, letters and line breaks in
    place of typographic, joined or wide ones; no control characters; composed form."""
    text = _MOJIBAKE.sub(_repair, TERMINAL_ESCAPES.sub("", text))
    return unicodedata.normalize("NFC", LINE_BREAKS.sub("\n", text).translate(REPLACED))


#: What repair or unescaping could touch.
UNUSUAL = r"[^\t\n\x20-\x7e]|&"


# Bytes of text that a Python task turns into objects at a time; a batch from Spark may be many times larger.
PORTION_BYTES = 1 << 20


def portions(sizes: np.ndarray, limit: int = PORTION_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive rows of at most ``limit`` bytes together; a larger row stands alone."""
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + limit, side="right")), start + 1)
        yield start, stop - start
        start = stop


@F.arrow_udf(T.StringType())
def _clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        if not len(batch):
            yield batch
        for start, n in portions(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)):
            texts = (t.as_py() for t in batch.slice(start, n))
            yield pa.array([None if t is None else html.unescape(html.unescape(repair(t))).strip() for t in texts], pa.string())


def basic_clean(text) -> Column:
    """Repaired text with HTML entities resolved twice, trimmed. Only texts with an ampersand or a
    character outside plain ASCII go through Python; nothing but the trim can change the others."""
    c = _col(text)
    plain = ~c.rlike(UNUSUAL)
    return F.when(plain, F.btrim(c, F.lit(" \t\n"))).otherwise(_clean(F.when(~plain, c)))


def whitespace_clean(text) -> Column:
    return F.trim(F.regexp_replace(_col(text), WHITESPACE, " "))


def canonicalize_text(text, keep: str | None = None) -> Column:
    """Underscores to spaces, no ASCII punctuation, lower case, single spaces. Occurrences of
    the exact string ``keep`` survive."""
    c = F.replace(_col(text), F.lit("_"), F.lit(" "))
    if keep:
        literal = re.sub(r"([^\w\s])", r"\\\1", keep)
        parts = F.split(c, literal, -1)
        c = F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, PUNCTUATION, "")), keep)
    else:
        c = F.regexp_replace(c, PUNCTUATION, "")
    return whitespace_clean(F.lower(c))


CLEANERS = {
    "canonicalize": lambda text: canonicalize_text(basic_clean(text)),
    "lower": lambda text: F.lower(whitespace_clean(basic_clean(text))),
    "whitespace": lambda text: whitespace_clean(basic_clean(text)),
}


def cleaner(mode: str):
    """Column function of a clean mode."""
    if mode not in CLEANERS:
        raise ValueError(f"clean mode must be one of {', '.join(CLEANERS)}, not {mode!r}")
    return CLEANERS[mode]


def pretokenize(text, special: tuple[str, ...] = SPECIAL_TOKENS) -> Column:
    """Words of a cleaned text, case-insensitively matched, in order."""
    pattern = "(?i)" + "|".join([*special, WORD_PATTERN])
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0))
