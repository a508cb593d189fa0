"""Quality rules whose cutoffs come from quantile sketches per language and source.

Measures are whole numbers. A sketch is a histogram over log-linear bins (exact below 32, then 32 bins
for each power of two, so a quantile is off by at most 1/32 of its value). Two sketches merge by adding
the counts of equal bins, which is all Spark's grouped sum has to do: every task adds up its own rows
first, and a source that holds a third of the corpus still sends a few hundred rows. The result does
not depend on partitions or on the order in which sketches meet.

A measure is rejected beyond Tukey's outer fence of its group plus a small allowance. Groups of fewer
than ``MIN_GROUP`` documents use the sketch merged over their language, then over the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from speciframe.session import cut_lineage

from .common import carried, in_small_batches, words_of

SYMBOLS = "#*$%&|<>"
#: Measures with a cutoff: name -> (judged from below too, allowance beyond the fence).
RULES = {
    "mean_word": (True, 60),  # hundredths of a code point
    "symbols": (False, 50),  # for 1000 words
    "dup_lines": (False, 500),  # for 1000 lines
    "repeats": (False, 200),  # for 1000 words
}
MIN_GROUP = 100
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_TYPE = T.StructType([T.StructField(f, T.LongType()) for f in _FIELDS])


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the text."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    total, counted = 0, 0  # words before ``counted`` are counted or passed
    for i, window in enumerate(windows):
        if found[window] > 1:
            total += i + size - max(i, counted)
            counted = i + size
    return total


def measure_text(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(_FIELDS)
    words = words_of(text)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in " \t\n\r\x0b\x0c"),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


@F.arrow_udf(_TYPE)
def _measures(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([(f, pa.int64()) for f in _FIELDS])
    for batch in texts:
        yield pa.array([dict(zip(_FIELDS, measure_text(t.as_py()))) for t in batch], kind)


def measure(docs: DataFrame, text: str = "text", into: str = "_measures") -> DataFrame:
    """``docs`` with a struct of measures of the whole text; null or empty text measures 0 throughout."""
    return in_small_batches(docs).withColumn(into, _measures(F.col(text)))


def _rated(m: Column) -> dict[str, Column]:
    words, lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
    per = lambda top, base, scale: F.floor(top * scale / base).cast("long")
    return {
        "mean_word": per(m["word_chars"], words, 100),
        "symbols": per(m["n_symbols"], words, 1000),
        "dup_lines": per(m["n_dup_lines"], lines, 1000),
        "repeats": per(m["n_repeat_words"], words, 1000),
    }


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def _bin(v: Column) -> Column:
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (shift * 32 + F.call_function("shiftright", v, shift)).cast("long")


def _floor_of(b: Column) -> Column:
    """The smallest value of a bin."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - shift * 32, shift).cast("long")


def sketch(measured: DataFrame, into: str = "_measures") -> DataFrame:
    """Counts by (lang, source, measure, bin). Documents that fail the base rules shape no cutoff."""
    rated = _rated(F.col(into))
    bins = F.array(*[F.struct(F.lit(k).alias("rule"), _bin(v).alias("bin")) for k, v in rated.items()])
    return (
        measured.filter(~base_failed(F.col(into)))
        .select("lang", "source", F.explode(bins).alias("b"))
        .groupBy("lang", "source", "b.rule", "b.bin")
        .agg(F.count("*").alias("n"))
    )


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by, "rule", "bin").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, *by: str) -> DataFrame:
    """Outer fences by group and measure, with the number of documents behind them."""
    group = Window.partitionBy(*by, "rule")
    ranked = sketches.select(
        *by, "rule", "bin", F.sum("n").over(group).alias("total"), F.sum("n").over(group.orderBy("bin")).alias("upto")
    )
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, _floor_of(F.col("bin"))))
    found = ranked.groupBy(*by, "rule").agg(F.max("total").alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    spread = 3 * (F.col("q3") - F.col("q1"))
    return found.select(*by, "rule", "total", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def cutoffs(measured: DataFrame) -> DataFrame:
    """One row for each (lang, source) of the input: its limits, from the smallest large enough sketch."""
    groups = measured.select("lang", "source").distinct()
    counts = cut_lineage(sketch(measured))
    own = fences(counts, "lang", "source")
    wide = fences(merge(counts, "lang"), "lang")
    whole = fences(merge(counts))

    def pivoted(table: DataFrame, by: tuple[str, ...], tag: str) -> DataFrame:
        """One row by group: limits by measure. Groups that are too small drop out, save at the top."""
        if by:
            table = table.filter(F.col("total") >= MIN_GROUP)
        limit = lambda side, rule: F.max(F.when(F.col("rule") == rule, F.col(side))).alias(f"{tag}_{side}_{rule}")
        return table.groupBy(*[F.col(c).alias(f"{tag}_{c}") for c in by], *([] if by else [F.lit(1).alias(f"{tag}_one")])).agg(
            *[limit(side, rule) for rule in RULES for side in ("low", "high")]
        )

    a, b, c = pivoted(own, ("lang", "source"), "own"), pivoted(wide, ("lang",), "wide"), pivoted(whole, (), "whole")
    joined = (
        groups.withColumn("_one", F.lit(1))
        .join(a, groups["lang"].eqNullSafe(a["own_lang"]) & groups["source"].eqNullSafe(a["own_source"]), "left")
        .join(b, groups["lang"].eqNullSafe(b["wide_lang"]), "left")
        .join(c, F.col("_one") == c["whole_one"], "left")
    )
    return joined.select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"),
        *[F.coalesce(*[F.col(f"{t}_{side}_{rule}") for t in ("own", "wide", "whole")]).alias(f"_{side}_{rule}")
          for rule in RULES for side in ("low", "high")],
    )


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` (text, lang, source, and columns of other names than those given here) with ``_measures``,
    ``_base_failed`` and ``_kept``.

    Defined cases: null or empty text has no words and fails; null languages and sources are groups of
    their own; equal rows get equal verdicts; an empty table gives an empty table.
    """
    measured = measure(docs)
    limits = cut_lineage(cutoffs(measured))  # small by construction of the bins; joined at its true size
    beyond = F.lit(False)
    for rule, value in _rated(F.col("_measures")).items():
        below, slack = RULES[rule]
        beyond = beyond | F.coalesce(value > F.col(f"_high_{rule}") + slack, F.lit(False))
        if below:
            beyond = beyond | F.coalesce(value < F.col(f"_low_{rule}") - slack, F.lit(False))
    return (
        measured.join(limits, measured["lang"].eqNullSafe(limits["_lang"]) & measured["source"].eqNullSafe(limits["_source"]), "left")
        .withColumn("_base_failed", base_failed(F.col("_measures")))
        .withColumn("_kept", ~F.col("_base_failed") & ~beyond)
        .drop(*limits.columns)
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only, whatever these are called."""
    return judge(carried(docs, "text", "lang", "source")).filter("_kept").select("row.*")
