"""Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import match_prototypes
from ..session import cut_lineage
from ..sources.sinks import idempotent_parquet, retried
from ..sources.tar import tar_samples

SHARD_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_shards(spark: SparkSession, path: str, pattern: str = "*.tar", max_files: int | None = None, **how) -> DataFrame:
    """Samples of the shards that arrive in a folder."""
    reader = spark.readStream.format("binaryFile").schema(SHARD_SCHEMA).option("pathGlobFilter", pattern)
    reader = reader.option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # Only the path travels; each task opens its shards itself.
    return tar_samples(reader.load(path).select("path"), **how)


def stream_table(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_meter(
    stream: DataFrame, value: str, weight: str, by: Sequence[str], step: str, every: int, path: str, checkpoint: str
) -> StreamingQuery:
    """Weighted running mean per log window of steps, kept as sums below ``path``, a folder per micro-batch.

    The sums of a batch are worked out from its rows alone, so the stream holds no state however many windows
    there are or how late a row comes; a batch that is repeated replaces its folder. ``read_meter`` gives the
    windows so far, those that are still open too.
    """
    windowed = stream.withColumn("window_no", F.floor(F.col(step) / every))
    write, total = idempotent_parquet(path), F.sum(F.col(value) * F.col(weight))
    return foreach_batch(
        windowed, lambda batch, number: write(batch.groupBy(*by, "window_no").agg(total.alias("total"), F.sum(weight).alias("weight")), number), checkpoint)


def read_meter(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """(by..., window_no, total, weight, avg) of the batches written so far."""
    total, n = F.sum("total"), F.sum("weight")
    return spark.read.parquet(path).groupBy(*by, "window_no").agg(total.alias("total"), n.alias("weight"), (total / n).alias("avg"))


def stream_meter_by_time(stream: DataFrame, value: str, weight: str, by: Sequence[str], ts: str, width: str, lateness: str = "10 minutes") -> DataFrame:
    """The same by event-time windows; a window is final once the watermark has passed it."""
    total, n = F.sum(F.col(value) * F.col(weight)), F.sum(weight)
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    out = timed.groupBy(F.window("_ts", width), *by).agg(total.alias("total"), n.alias("weight"), (total / n).alias("avg"))
    return out.select(F.col("window.start").alias("window_start"), *by, "total", "weight", "avg")


def stream_scores(stream: DataFrame, prototypes: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """Arriving features against fixed prototypes of any size: the prototypes are written once, each
    micro-batch is matched as a table and written below ``path`` by its id. ``how`` as in match_prototypes."""
    fixed = cut_lineage(prototypes.select(*how.get("group", ()), F.col(how["label"]).cast("bigint").alias(how["label"]), how["proto_vec"]))
    write = idempotent_parquet(path)
    return foreach_batch(stream, lambda batch, number: write(match_prototypes(batch, fixed, fixed=True, **how), number), checkpoint)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Process what has arrived into files; a later call with the same checkpoint goes on where
    this one stopped."""
    query = (
        stream.writeStream.outputMode(mode).format(fmt).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return query


def foreach_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def retry_sink(
    stream: DataFrame, path: str, checkpoint: str, attempts: int = 5, first_wait: float = 0.5,
    write: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Micro-batches written by id, tried again on failure; a repeated batch replaces itself. Another
    ``write`` must do the same."""
    once = write or idempotent_parquet(path, attempts=1)
    return foreach_batch(stream, lambda batch, number: retried(lambda: once(batch, number), attempts, first_wait), checkpoint)
