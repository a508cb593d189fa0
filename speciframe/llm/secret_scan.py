"""Secrets and who owns them, in Spark's own expressions.

Candidates are the base spans (assignments, access keys, long hexadecimal runs) and free tokens that mix
letters of both cases with digits. A value has as many repositories as distinct texts hold it (copies of one
text are one repository) and as many owners as sources have such a text. It is a widely copied example if
several repositories of ``SHARED`` or more owners hold it, or if it has ``MANY`` or more repositories per
owner; any other value is owner-specific and looks live. Base spans always stay and carry the verdict; a free
token becomes a span of kind ``live`` only if it is owner-specific and lies in no base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speciframe.session import cut_lineage

from .native import running_sums

# fixed values: kinds in order, and what each accepts (the value is the whole match but for assignments)
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A run of this alphabet, of any length from 20, between other characters or after an equals sign, with its
#: padding. A run before an equals sign and more is a name.
FREE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
SHARED = 3
MANY = 8
_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"


def located(text: Column, pattern: str, kind: str, rank: int, group: int, wanted) -> Column:
    """Leftmost non-overlapping matches as spans in code points; those whose value isn't ``wanted`` drop out.

    The pieces between the matches and the matches themselves add up to the positions."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = lambda a: F.transform(a, lambda s: F.char_length(s).cast("long"))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    steps = F.zip_with(lengths(pieces), lengths(matches), lambda a, b: a + b)
    spans = F.transform(
        F.arrays_zip(running_sums(steps).alias("end"), lengths(matches).alias("n"), values.alias("value")),
        lambda m: F.struct((m["end"] - m["n"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                           m["end"].alias("end"), m["value"].alias("value")),
    )
    none = F.array().cast(_SPAN)
    return F.when(text.rlike(pattern), F.filter(spans, lambda s: wanted(s["value"])).cast(_SPAN)).otherwise(none)


def _mixed(value: Column) -> Column:
    return value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, print, base, free): spans of every whole text, ordered; null text has none. A
    text with spans has a fingerprint."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text",
        located(text, ASSIGN, "assign", 0, 1, lambda v: F.length(v) >= 6).alias("a"),
        located(text, ACCESS, "access", 1, 0, lambda v: F.lit(True)).alias("k"),
        located(text, HEX, "hex", 2, 0, lambda v: F.lit(True)).alias("h"),
        located(text, FREE, "live", 3, 0, _mixed).alias("free"),
    )
    base = F.sort_array(F.concat("a", "k", "h"))
    inside = lambda s: F.exists(F.col("base"), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    some = (F.size("base") > 0) | (F.size("free") > 0)
    # what is written from here on holds digests of the values, never a secret itself
    hidden = lambda spans: F.transform(spans, lambda s: s.withField("value", F.sha2(s["value"], 256)))
    return found.withColumn("base", base).withColumn("free", F.filter("free", lambda s: ~inside(s))).select(
        "row", "doc_id", "source", F.when(some, F.sha2("text", 256)).alias("print"), hidden("base").alias("base"), hidden("free").alias("free"))


def ownership(found: DataFrame) -> DataFrame:
    """(value, repositories, owners): in how many distinct texts and in how many distinct sources a value
    occurs. Both are told apart by one exchange, then added up in the tasks before they go to the value."""
    values = F.array_distinct(F.transform(F.concat("base", "free"), lambda s: s["value"]))
    holders = F.array(F.struct(F.lit("text").alias("kind"), F.col("print").alias("name")),
                      F.struct(F.lit("source").alias("kind"), F.coalesce("source", F.lit("")).alias("name")))
    held = found.select(F.explode(values).alias("value"), holders.alias("holders"))
    each = held.select("value", F.inline("holders")).distinct()
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return each.groupBy("value").agg(count("text").alias("repositories"), count("source").alias("owners"))


def example(repositories: Column, owners: Column) -> Column:
    """Whether a value is a widely copied example."""
    return ((owners >= SHARED) & (repositories > 1)) | (repositories >= MANY * owners)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans, n_live, n_example): base spans; base and live spans by start, then kind; and
    how many spans of either verdict. Rows are told apart by position in the input, so repeated ids keep a
    row each. Null sources are one owner. An empty table gives an empty table."""
    found = cut_lineage(candidates(docs))
    some = found.filter((F.size("base") > 0) | (F.size("free") > 0))
    spans = some.select("row", F.explode(F.concat("base", "free")).alias("s")).withColumn("value", F.col("s.value"))
    judged = spans.join(ownership(some), "value").withColumn("live", ~example(F.col("repositories"), F.col("owners")))
    rows = judged.filter((F.col("s.rank") < 3) | F.col("live")).groupBy("row").agg(
        F.sort_array(F.collect_list("s")).alias("spans"), F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_example"))
    return found.join(rows, "row", "left").select(
        "doc_id", "base", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))
