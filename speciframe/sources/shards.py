"""Shard lists, their sizes, and which shards exist."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tar import open_stream

_RANGE = r"^(.*?)\{(-?[0-9]+)\.\.(-?[0-9]+)(?:\.\.(-?[0-9]+))?\}(.*)$"
_LETTERS = r"^(.*?)\{([A-Za-z])\.\.([A-Za-z])(?:\.\.(-?[0-9]+))?\}(.*)$"
_CHOICE = r"^(.*?)\{([^{},]*(?:,[^{},]*)+)\}(.*)$"


def expand_shards(df: DataFrame, urls: str = "urls", weights: str | None = None) -> DataFrame:
    """(part_no, pattern, url[, weight]) for ``a-{000..123}.tar::b.tar`` lists.

    Parts are separated by ``::``, digit ranges keep the zero padding of a bound, letter ranges
    follow the code points, both may run downwards and take a step (``{0..10..2}``, ``{a..e..2}``),
    a weight goes to every shard of its part; part and weight counts must match. There are as many
    passes as the list has braces, however many.
    """
    parts = F.split(F.col(urls), "::")
    if weights is not None:
        w = F.split(F.col(weights), "::")
        message = F.concat_ws(
            " ", F.lit("number of data parts"), F.size(parts).cast("string"), F.lit("and weights"), F.size(w).cast("string"),
            F.lit("differ"),
        )
        w = F.when(F.size(parts) == F.size(w), w).otherwise(F.raise_error(message).cast("array<string>"))
        entries = F.arrays_zip(parts.alias("p"), w.alias("w"))
    else:
        entries = F.arrays_zip(parts.alias("p"))
    rows = df.select("*", F.posexplode(entries).alias("part_no", "_e"))
    rows = rows.withColumn("pattern", F.col("_e.p"))
    if weights is not None:
        rows = rows.withColumn("weight", F.col("_e.w").cast("double"))
    rows = rows.drop("_e", urls, *([weights] if weights else [])).withColumn("url", F.col("pattern"))
    braces = df.agg(F.max(F.regexp_count(F.col(urls), F.lit(r"\{")))).first()[0]
    for _ in range(braces or 0):
        rows = rows.withColumn("url", F.explode(_expand_one(F.col("url"))))
    return rows


def _expand_one(url: Column) -> Column:
    """The first brace written out: ``{07..12}`` keeps its zero padding, ``{a,b}`` lists choices."""
    piece = lambda i: F.regexp_extract(url, _RANGE, i)
    letter = lambda i: F.regexp_extract(url, _LETTERS, i)
    low, high = piece(2), piece(3)

    def steps(first: Column, last: Column, step: Column) -> Column:
        size = F.greatest(F.abs(F.when(step != "", step.cast("bigint")).otherwise(F.lit(1))), F.lit(1))
        return F.sequence(first, last, F.when(first <= last, size).otherwise(-size))

    padded = low.rlike("^-?0[0-9]") | high.rlike("^-?0[0-9]")
    width = F.when(padded, F.greatest(F.length(low), F.length(high))).otherwise(F.lit(0))
    digits = lambda n: F.lpad(n.cast("string"), F.greatest(width, F.length(n.cast("string"))), F.lit("0"))
    numbered = F.transform(
        steps(low.cast("bigint"), high.cast("bigint"), piece(4)), lambda n: F.concat(piece(1), digits(n), piece(5))
    )
    code = lambda i: F.ascii(letter(i)).cast("bigint")
    lettered = F.transform(steps(code(2), code(3), letter(4)), lambda n: F.concat(letter(1), F.char(n), letter(5)))
    choice = lambda i: F.regexp_extract(url, _CHOICE, i)
    chosen = F.transform(F.split(choice(2), ",", -1), lambda c: F.concat(choice(1), c, choice(3)))
    return F.when(url.rlike(_RANGE), numbered).when(url.rlike(_LETTERS), lettered).when(url.rlike(_CHOICE), chosen).otherwise(F.array(url))


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length) of the files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length")


def existing_shards(shards: DataFrame, listing: DataFrame, url: str = "url") -> DataFrame:
    """Shards that are in the listing."""
    return shards.join(listing.select(F.col("path").alias(url)), url, "left_semi")


def parse_sizes(sizes: DataFrame, text: str = "value") -> DataFrame:
    """(name, size) from a JSON object of sizes, possibly below ``per_shard``."""
    return sizes.select(F.explode(_size_map(text)).alias("name", "size"))


def _size_map(text: str) -> Column:
    kind = "map<string,bigint>"
    return F.coalesce(F.from_json(F.get_json_object(text, "$.per_shard"), kind), F.from_json(text, kind))


def dataset_size(shards: DataFrame, sizes: DataFrame | None = None, total: int | None = None, url: str = "url") -> DataFrame:
    """(num_samples, num_shards): the sum of the listed sizes of the shards, else the given
    total, else NULL."""
    named = shards.select(F.element_at(F.split(F.col(url), "/"), -1).alias("name"))
    if sizes is None:
        return named.agg(F.lit(total).cast("bigint").alias("num_samples"), F.count("*").alias("num_shards"))
    return named.join(sizes, "name", "left").agg(
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("num_samples"), F.count("*").alias("num_shards")
    )


def _sidecars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(folder, kind, text) of the size file of each folder that has one. Tasks open the files themselves, as Spark's
    readers pass over names that begin with an underscore."""
    for batch in batches:
        rows = []
        for folder in batch.column("folder").to_pylist():
            for kind in ("sizes.json", "__len__"):
                try:
                    with open_stream(f"{folder}/{kind}") as file:
                        rows.append({"folder": folder, "kind": kind, "text": file.read().decode()})
                    break
                except FileNotFoundError:
                    continue
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("folder", pa.string()), ("kind", pa.string()), ("text", pa.string())]))


def probed_sizes(shards: DataFrame, url: str = "url") -> DataFrame:
    """(folder, num_samples, num_shards): what the files beside the shards say about each folder's shards.

    ``sizes.json``, in either layout, counts the shards it names, and those it does not name count nothing;
    without it ``__len__`` counts the folder; without either the number is NULL. Repeated shards count each time.
    """
    listed = shards.select(F.regexp_replace(url, "/[^/]*$", "").alias("folder"), F.element_at(F.split(url, "/"), -1).alias("name"))
    counts = listed.groupBy("folder").agg(F.count("*").alias("num_shards"))
    beside = cut_lineage(counts.select("folder").mapInArrow(_sidecars, "folder string, kind string, text string"))
    entries = beside.filter("kind = 'sizes.json'").select("folder", F.explode(_size_map("text")).alias("name", "size"))
    named = listed.join(entries, ["folder", "name"]).groupBy("folder").agg(F.sum("size").alias("_sum"))
    told = counts.join(beside, "folder", "left").join(named, "folder", "left")
    total = F.when(F.col("kind") == "sizes.json", F.coalesce("_sum", F.lit(0))).otherwise(F.regexp_replace("text", "[\\s_]+", "").cast("bigint"))
    return told.select("folder", total.cast("bigint").alias("num_samples"), "num_shards")


def probed_size(shards: DataFrame, url: str = "url") -> DataFrame:
    """(num_samples, num_shards) over all folders of ``probed_sizes``; NULL as soon as one folder's number is unknown."""
    known = F.when(F.count("num_samples") == F.count("*"), F.sum("num_samples"))
    return probed_sizes(shards, url).agg(known.alias("num_samples"), F.coalesce(F.sum("num_shards"), F.lit(0)).alias("num_shards"))


def mirror_diff(local: DataFrame, remote: DataFrame, skip: Sequence[str] = ("%epoch_latest%",)) -> DataFrame:
    """Files to copy: absent from the mirror or of another length there, except skipped names.
    Both sides are (path, length) with paths relative to their roots."""
    wanted = local
    for pattern in skip:
        wanted = wanted.filter(~F.col("path").like(pattern))
    return wanted.join(remote.select("path", "length"), ["path", "length"], "left_anti")


def verify_checksums(files: DataFrame, manifest: DataFrame, content: str = "content") -> DataFrame:
    """(path, ok): the sha256 of the file starts with the expected hex prefix."""
    digest = F.sha2(F.col(content), 256)
    return files.join(manifest, "path").select("path", digest.startswith(F.col("expected")).alias("ok"))
