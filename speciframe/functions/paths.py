"""Paths, sample parts, traits and natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: accepted image suffixes in order of preference.
IMAGE_SUFFIXES = ("jpg", "png", "jpeg", "webp")
# Digits of the length of a digit run: no string is longer than a 32-bit number says.
LENGTH_DIGITS = 10


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def parent_folder(path) -> Column:
    return F.get(F.split(_col(path), "/"), F.size(F.split(_col(path), "/")) - 2)


def under_root(root, *parts) -> Column:
    return F.concat_ws("/", F.lit(root) if isinstance(root, str) else root, *[_col(p) for p in parts])


def natural_key(text) -> Column:
    """Sort key in which digit runs compare as numbers: text runs in lower case alternating with
    digit runs without leading zeros, each behind its length, so that longer numbers are larger."""
    runs = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def number(run):
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), LENGTH_DIGITS, "0"), digits)

    padded = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), number(r)).otherwise(r))
    starts_with_digit = F.lower(_col(text)).rlike("^[0-9]")
    return F.when(starts_with_digit, F.concat(F.array(F.lit("")), padded)).otherwise(padded)


def image_part(parts) -> Column:
    """The first image part that is present."""
    return F.coalesce(*[_col(parts)[s] for s in IMAGE_SUFFIXES])


def text_part(parts, text_type: str = "") -> Column:
    """The caption part: ``txt``, or ``<type>.txt`` for a named text type."""
    return _col(parts)[f"{text_type}.txt" if text_type else "txt"]


def has_caption_and_image(parts) -> Column:
    """Some key contains ``txt`` and some image part exists."""
    keys = F.map_keys(_col(parts))
    caption = F.exists(keys, lambda k: k.contains("txt"))
    return caption & F.arrays_overlap(keys, F.array(*[F.lit(s) for s in IMAGE_SUFFIXES]))


def encode_feeding_path(value) -> Column:
    """pelagic is 1, benthic is 0, anything else is an error."""
    c = _col(value)
    return (
        F.when(c == "pelagic", F.lit(1))
        .when(c == "benthic", F.lit(0))
        .otherwise(F.raise_error(F.concat(F.lit("unexpected feeding path: "), F.coalesce(c, F.lit("null")))).cast("int"))
    )


def encode_traits(feeding, *traits) -> Column:
    return F.array(encode_feeding_path(feeding), *[_col(t).cast("int") for t in traits])
