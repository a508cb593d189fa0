"""Tar shards: members, and members grouped into samples."""

from __future__ import annotations

import io
import itertools
import operator
import re
import tarfile
import warnings
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

# Key and suffix of a member name, and the names of shard-level members.
MEMBER_NAME = re.compile(r"^((?:.*/|)[^.]+)[.]([^/]*)$", re.DOTALL)
META_NAME = re.compile(r"__[^/]*__($|/)")
SAMPLE_SCHEMA = "url string, key string, sample_no bigint, parts map<string,binary>, error string"
MEMBER_SCHEMA = "url string, member_no bigint, fname string, content binary, error string"
FLUSH_BYTES = 8 * 1024 * 1024


def split_name(name: str) -> tuple[str | None, str | None]:
    """Everything before the first dot of the file name, and the rest."""
    match = MEMBER_NAME.match(name)
    return match.groups() if match else (None, None)


def open_stream(path: str):
    if path.startswith("file:"):
        system, inner = fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    else:
        system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)


def _members(stream, wanted: Callable[[str], bool] | None = None) -> Iterator[tuple[int, str, bytes]]:
    """Regular members in order, one at a time; nothing but the current one is held, and the contents of those
    that are not ``wanted`` are passed over."""
    number = 0
    with tarfile.open(fileobj=stream, mode="r|*") as tar:
        for info in tar:
            if info.isreg() and not META_NAME.match(info.name):
                yield number, info.name, tar.extractfile(info).read() if wanted is None or wanted(info.name) else b""
                number += 1
            tar.members = []


def _samples(members, keys, lower: bool, suffixes):
    """Runs of members with one key; a stored suffix that comes again cuts its run in two."""
    named = ((*keys(name), data) for _, name, data in members)
    for key, run in itertools.groupby((m for m in named if m[0] is not None), key=operator.itemgetter(0)):
        sample = {}
        for _, given, data in run:
            suffix = given.lower() if lower else given
            if suffix in sample:
                yield key, sample
                sample = {}
            if suffixes is None or suffix in suffixes:
                sample[suffix] = data
        yield key, sample


def _read(open_rows, produce, schema: pa.Schema, on_error: str):
    """Rows of every shard, in batches of bounded bytes; a damaged shard ends early."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for url, source in open_rows(batch):
                try:
                    for row, n in produce(url, source()):
                        held.append(row)
                        size += n
                        if size >= FLUSH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                except (tarfile.TarError, OSError, EOFError) as err:
                    if on_error == "fail":
                        raise
                    warnings.warn(f"reading {url}: {err!r}, going on", stacklevel=1)
                    held.append({"url": url, "error": repr(err)})
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def _paths(batch):
    for path in batch.column("path").to_pylist():
        yield path, lambda path=path: open_stream(path)


def _contents(batch):
    paths, contents = batch.column("path").to_pylist(), batch.column("content")
    for i, path in enumerate(paths):
        yield path, lambda i=i: io.BytesIO(contents[i].as_py())


def _check(on_error: str) -> None:
    if on_error not in ("skip", "fail"):
        raise ValueError(f"on_error must be skip or fail, not {on_error!r}")


def tar_samples(
    shards: DataFrame,
    keys: Callable[[str], tuple] = split_name,
    lower: bool = True,
    suffixes: Sequence[str] | None = None,
    on_error: str = "skip",
    with_rejects: bool = False,
    hollow: Sequence[str] = (),
) -> DataFrame:
    """(url, key, sample_no, parts) for a table of shards. Parts with a ``hollow`` suffix are there, but empty.

    Shards are streamed by the tasks that hold their path; with a ``content`` column (a stream of
    files) the bytes come from the row. ``with_rejects`` keeps one row with ``error`` for each
    damaged shard, whose samples before the damage are kept either way.
    """
    _check(on_error)
    schema = pa.schema([
        ("url", pa.string()), ("key", pa.string()), ("sample_no", pa.int64()),
        ("parts", pa.map_(pa.string(), pa.binary())), ("error", pa.string()),
    ])

    def wanted(name: str) -> bool:
        suffix = keys(name)[1]
        return suffix is None or (suffix.lower() if lower else suffix) not in hollow

    def produce(url, stream):
        for i, (key, parts) in enumerate(_samples(_members(stream, wanted if hollow else None), keys, lower, suffixes)):
            row = {"url": url, "key": key, "sample_no": i, "parts": list(parts.items())}
            yield row, sum(map(len, parts.values())) + 64

    rows = _contents if "content" in shards.columns else _paths
    out = shards.mapInArrow(_read(rows, produce, schema, on_error), SAMPLE_SCHEMA)
    return out if with_rejects else out.filter("error IS NULL").drop("error")


def tar_members(shards: DataFrame, on_error: str = "skip", with_rejects: bool = False) -> DataFrame:
    """(url, member_no, fname, content) for a table of shards, not grouped."""
    _check(on_error)
    schema = pa.schema([
        ("url", pa.string()), ("member_no", pa.int64()), ("fname", pa.string()),
        ("content", pa.binary()), ("error", pa.string()),
    ])

    def produce(url, stream):
        for number, name, data in _members(stream):
            yield {"url": url, "member_no": number, "fname": name, "content": data}, len(data) + 64

    rows = _contents if "content" in shards.columns else _paths
    out = shards.mapInArrow(_read(rows, produce, schema, on_error), MEMBER_SCHEMA)
    return out if with_rejects else out.filter("error IS NULL").drop("error")


def list_shards(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the tar files; the scan makes tasks by file size, so a big shard is a task."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.tar")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path")
    )


def read_tar_samples(spark: SparkSession, path: str, **options) -> DataFrame:
    return tar_samples(list_shards(spark, path), **options)
