"""Writers: feature tables, metric lines, and batches that may be tried again."""

from __future__ import annotations

import itertools
import operator
import time
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_features


def write_features(features: DataFrame, path: str, classes: DataFrame | None = None) -> str:
    """Feature table as parquet, with the class numbering next to it."""
    features.write.mode("overwrite").parquet(f"{path}/features")
    if classes is not None:
        classes.write.mode("overwrite").parquet(f"{path}/classes")
    return path


def load_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_features(spark, f"{path}/features"), spark.read.parquet(f"{path}/classes")


def export_features(features: DataFrame, path: str, key: str = "id", vec: str = "features",
                    label: str = "target", sample: str = "path") -> str:
    """Vectors and labels as parquet and sample paths as JSON lines, aligned by the key."""
    features.select(key, vec).write.mode("overwrite").parquet(f"{path}/features")
    features.select(key, label).write.mode("overwrite").parquet(f"{path}/labels")
    features.select(key, sample).write.mode("overwrite").json(f"{path}/paths")
    return path


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics as appended JSON lines."""
    metrics.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def retried(action: Callable[[], None], attempts: int = 5, first_wait: float = 0.5,
            sleep: Callable[[float], None] = time.sleep) -> int:
    """Run an action, again after a growing pause when it fails; the number of attempts made."""
    for attempt in range(1, attempts + 1):
        try:
            action()
            return attempt
        except Exception:
            if attempt == attempts:
                raise
            sleep(first_wait * 2 ** (attempt - 1))
    raise ValueError("attempts must be at least 1")


def idempotent_parquet(path: str, attempts: int = 5, first_wait: float = 0.5) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer with one folder per batch id, so that writing a batch again
    replaces what an earlier attempt left."""
    def write(batch: DataFrame, batch_id: int) -> None:
        retried(lambda: batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"), attempts, first_wait)

    return write


def retried_jdbc(url: str, table: str, attempts: int = 5, first_wait: float = 0.5, **options) -> Callable[[DataFrame], int]:
    """Append a table over JDBC, tried again with a growing pause."""
    def write(df: DataFrame) -> int:
        return retried(lambda: df.write.mode("append").options(**options).jdbc(url, table), attempts, first_wait)

    return write


def write_files(files: DataFrame, root: str, part: str | None = None, end: bytes = b"") -> int:
    """Write (path, content) rows as files below ``root``; the number written. The tasks write
    through the file system of ``root``, a row at a time.

    With ``part``, the rows of a path are one file, put together in the order of that column (nulls last), and
    ``end`` follows; a task holds no more of it than the rows of a batch.
    """
    def rows(batches):
        n = 0
        for batch in batches:
            contents = batch.column("content")
            for path, content in zip(batch.column("path"), contents):
                yield (path.as_py() if part else n), path.as_py(), content.as_buffer()
                n += 1

    def run(batches):
        if root.startswith("file:"):
            system, base = fs.LocalFileSystem(), "/" + root[len("file:") :].lstrip("/")
        else:
            system, base = fs.FileSystem.from_uri(root)
        n = 0
        for _, pieces in itertools.groupby(rows(batches), key=operator.itemgetter(0)):
            out = None
            for _, path, content in pieces:
                if out is None:
                    target = f"{base}/{path}"
                    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(target)
                out.write(content)
            out.write(end)
            out.close()
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    content = F.col("content").cast("binary").alias("content")
    if part:
        files = files.repartition("path").sortWithinPartitions("path", F.asc_nulls_last(part))
    return files.select("path", content).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
