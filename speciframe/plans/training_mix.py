"""From shard lists to training batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import IMAGE_SUFFIXES, file_name, image_part, text_part
from ..functions.templates import random_text_type
from ..functions.tokens import CONTEXT_LENGTH, Vocabulary, encode_text, frame_tokens
from ..operators.joins import replay_pairing
from ..operators.ranking import assign_batches, assign_workers, epoch_shuffle
from ..operators.samples import complete_samples, pick_parts
from ..operators.sampling import weighted_resample
from ..session import cut_lineage
from ..sources.tar import tar_samples


def shards_for_epoch(
    spark: SparkSession, shards: DataFrame, seed: int, epoch: int, resample: int | None = None, weight: str | None = None,
    nodes: int = 1, workers: int = 1,
) -> DataFrame:
    """(url, position, node, worker): shards drawn with replacement, or all of them in the order of
    this epoch, dealt out to nodes and workers."""
    if resample is not None:
        drawn = weighted_resample(spark, shards, resample, seed, epoch, weight, ["url"]).withColumnRenamed("draw", "position")
    else:
        drawn = epoch_shuffle(shards, seed, epoch, ["url"])
    return assign_workers(drawn, ["position"], nodes, workers)


TEXT_TYPES = ["sci", "com", "taxon", "sci_com", "taxon_com"]


def usable_samples(samples: DataFrame, text_type: str = "") -> DataFrame:
    """Complete samples with their image part and the text column ``text``; for ``random`` with one column
    for each text type, all of which a sample must have. Other parts go."""
    types = TEXT_TYPES if text_type == "random" else [text_type]
    picked = pick_parts(complete_samples(samples), types).drop("parts")
    if text_type not in ("", "random"):
        picked = picked.withColumnRenamed(text_type, "text")
    there = F.col("image").isNotNull()
    for name in types if text_type == "random" else ["text"]:
        there &= F.col(name).isNotNull()
    return picked.filter(there)


def framed_texts(rows: DataFrame, text, vocabulary: Vocabulary, length: int = CONTEXT_LENGTH, mode: str = "lower") -> DataFrame:
    """Rows with the framed ``tokens`` of a text in place of their text columns."""
    coded = rows.withColumn("_ids", encode_text(text.cast("string"), vocabulary, mode))
    framed = frame_tokens("_ids", vocabulary.start_id, vocabulary.end_id, length)
    return coded.withColumn("tokens", framed).drop("_ids", "text", *TEXT_TYPES)


def training_batches(
    samples: DataFrame, size: int, seed: int, epoch: int, keys: Sequence[str], train: bool = True
) -> DataFrame:
    """Batches in the order of this epoch; training drops a short last batch, validation keeps it."""
    return assign_batches(samples, size, seed=seed + epoch, keys=keys, drop_last=train)


def training_mix(
    main: DataFrame, replay: DataFrame | None, vocabulary: Vocabulary, size: int, replay_size: int, seed: int, epoch: int,
    keys: Sequence[str] = ("url", "key", "sample"), text_type: str = "", path: str | None = None, length: int = CONTEXT_LENGTH,
) -> DataFrame:
    """Main batches, each followed by its replay batch. For the text type ``random`` every batch has one
    type, drawn by epoch and batch number. With ``path`` they are written, one batch after the other, and
    read back."""
    def batched(samples, size):
        rows = usable_samples(samples, text_type)
        if text_type != "random":
            return training_batches(cut_lineage(framed_texts(rows, F.col("text"), vocabulary, length)), size, seed, epoch, keys)
        cut = training_batches(cut_lineage(rows), size, seed, epoch, keys)
        return framed_texts(cut, random_text_type(F.col("batch_no"), TEXT_TYPES, seed + epoch), vocabulary, length)

    batches = batched(main, size)
    if replay is not None:
        batches = replay_pairing(batches, batched(replay, replay_size))
    if path is None:
        return batches
    batches.repartitionByRange("batch_no").sortWithinPartitions("batch_no").write.mode("overwrite").parquet(path)
    return batches.sparkSession.read.parquet(path)


def mix_from_shards(
    spark: SparkSession, main: DataFrame, replay: DataFrame | None, vocabulary: Vocabulary, size: int, replay_size: int, seed: int, epoch: int,
    text_type: str = "", length: int = CONTEXT_LENGTH, resample: int | None = None, weight: str | None = None,
) -> DataFrame:
    """From tables of shards (path[, weight]) to batches with contents: (url, shard, key, sample_no[, draw], tokens,
    batch_no, segment, image, caption).

    Shards are read twice. The first reading leaves images out: samples are filtered, tokenised, put in the order
    of the epoch and cut into batches, each followed by its replay batch. The second gives image and caption,
    which meet their batches by shard and sample in a hash join whose held side has no contents, so no
    content is ever sorted or numbered. With ``resample``, shards are drawn with replacement and a shard's samples
    come once per draw. With the text type ``random`` there is no caption beside the tokens. Shards of one name in different folders are told apart by their path in the result, and
    ordered by name.
    """
    keys = ["shard", "key", "sample_no"] + (["draw"] if resample is not None else [])

    def samples(shards: DataFrame) -> DataFrame:
        read = tar_samples(shards.select("path").distinct(), hollow=IMAGE_SUFFIXES).withColumn("shard", file_name("url"))
        if resample is None:
            return read
        drawn = weighted_resample(spark, shards.withColumn("url", F.col("path")), resample, seed, epoch, weight, ["url"])
        return read.join(drawn.select("url", "draw"), "url")

    batches = training_mix(samples(main), None if replay is None else samples(replay), vocabulary, size, replay_size, seed, epoch, keys, text_type, None, length)
    every = main.select("path") if replay is None else main.select("path").union(replay.select("path"))
    texts = TEXT_TYPES if text_type == "random" else [text_type]
    contents = tar_samples(every.distinct(), suffixes=[*IMAGE_SUFFIXES, *[f"{t}.txt" if t else "txt" for t in texts]])
    caption = F.lit(None).cast("binary") if text_type == "random" else text_part("parts", text_type)
    contents = contents.select("url", "sample_no", image_part("parts").alias("image"), caption.alias("caption"))
    return contents.join(batches.drop("image").hint("shuffle_hash"), ["url", "sample_no"])
