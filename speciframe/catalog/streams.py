"""Streaming forms, compared with the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..session import scratch_path
from ..sources import sinks
from ..streaming import streams
from .base import ctes, members, query, table
from .evaluation import HOW, RANKED, WINDOWED, _metered, prototypes
from .sources import TAR_SQL, _described, write_shards


def _stream(spark, sf, name):
    # A table is a file or a folder of files. A file stream takes a single file only as a match of a pattern.
    base = sf.rstrip("/")
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    return streams.stream_table(spark, f"{base}/{name}.[p]arquet", schema, "*")


def _paths(spark, name):
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


@query("stream_shards", TAR_SQL)
def stream_shards(spark, sf):
    root = scratch_path(spark, "arriving")
    write_shards(spark, members(spark, sf), root)
    out, checkpoint = _paths(spark, "stream-shards")
    described = streams.stream_shards(spark, root).select(
        paths.file_name("url").alias("url"), "sample_no", "key", _described("parts").alias("parts")
    )
    streams.run_available(described, out, checkpoint)
    return spark.read.parquet(out)


@query("stream_meter", WINDOWED)
def stream_meter(spark, sf):
    out, checkpoint = _paths(spark, "stream-meter")
    log = _stream(spark, sf, "events").selectExpr("event_id AS step", "event_type AS metric", "value AS val", "1 + event_id % 8 AS n")
    streams.stream_meter(log, "val", "n", ["metric"], "step", 100, out, checkpoint)
    return _metered(streams.read_meter(spark, out, ["metric"]), "metric", "window_no")


@query(
    "stream_meter_by_time",
    ctes("meter") + """, w AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS window_start FROM meter)
 SELECT epoch(window_start)::BIGINT AS window_start, metric, round(sum(val * n), 4) AS total, sum(n)::BIGINT AS weight, round(sum(val * n) / sum(n), 6) AS avg
 FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts::TIMESTAMP) FROM meter) - INTERVAL 10 MINUTE GROUP BY 1, 2""",
)
def stream_meter_by_time(spark, sf):
    out, checkpoint = _paths(spark, "stream-time")
    log = _stream(spark, sf, "events").selectExpr("event_type AS metric", "value AS val", "1 + event_id % 8 AS n", "ts")
    streams.run_available(streams.stream_meter_by_time(log, "val", "n", ["metric"], "ts", "1 hour"), out, checkpoint)
    # Seconds of the wall clock, whatever the session's zone is.
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(window_start AS timestamp_ntz))")
    return _metered(spark.read.parquet(out).withColumn("window_start", seconds), "window_start", "metric")


@query("stream_results", "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def stream_results(spark, sf):
    out, checkpoint = _paths(spark, "stream-results")
    lines = _stream(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    streams.run_available(lines, out, checkpoint, fmt="json")
    return spark.read.schema("conv_id bigint, turn bigint, role string, n int").json(out)


@query("stream_scores", RANKED + " SELECT id, CAST(class_idx AS BIGINT) AS pred, round(score, 9) AS score FROM r WHERE rank = 1")
def stream_scores(spark, sf):
    out, checkpoint = _paths(spark, "stream-scores")
    arriving = _stream(spark, sf, "embeddings").selectExpr("vec_id AS id", "embedding AS features")
    streams.stream_scores(arriving, prototypes(spark, sf), out, checkpoint, keep=["id"], **HOW)
    best = F.get("hits", F.lit(0))
    return spark.read.parquet(out).select("id", best["label"].alias("pred"), F.round(best["score"], 9).alias("score"))


@query("stream_resume", "SELECT doc_id, lang FROM documents")
def stream_resume(spark, sf):
    """Three runs on one checkpoint: the second finds what arrived since the first, the third nothing."""
    out, checkpoint = _paths(spark, "stream-resume")
    folder = scratch_path(spark, "arriving")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    early = F.coalesce(F.col("lang") == "en", F.lit(False))
    for part in (docs.filter(early), docs.filter(~early), None):
        if part is not None:
            part.write.mode("append").parquet(folder)
        streams.run_available(streams.stream_table(spark, folder, docs.schema), out, checkpoint)
    return spark.read.parquet(out)


@query("retry_sink", "SELECT o_orderkey, o_custkey FROM orders")
def retry_sink(spark, sf):
    """The first attempt breaks after it has written; the second replaces what it left."""
    out, checkpoint = _paths(spark, "retry")
    store, broken = sinks.idempotent_parquet(out, attempts=1), []

    def write(batch, number):
        store(batch, number)
        if not broken:
            broken.append(number)
            raise OSError("the connection was lost")

    arriving = _stream(spark, sf, "orders").select("o_orderkey", "o_custkey")
    streams.retry_sink(arriving, out, checkpoint, first_wait=0.1, write=write)
    return spark.read.parquet(out).select("o_orderkey", "o_custkey")
