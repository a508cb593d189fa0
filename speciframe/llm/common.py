"""What the text operators share: ASCII word rules, digests, and the vocabulary of span lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a class for regular expressions: space and the six ASCII controls.
SPACE = "\\x20\\x09-\\x0D"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet")


#: Rows of an Arrow batch that goes to Python. Texts are long; Spark's default of 10,000 rows would hold tens
#: of megabytes in the JVM and again in each Python worker.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after holding the session's Arrow batches to ``BATCH_ROWS`` rows."""
    session = docs.sparkSession
    if not 0 < int(session.conf.get(_BATCH)) <= BATCH_ROWS:
        session.conf.set(_BATCH, str(BATCH_ROWS))
    return docs


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """``row``, a struct of all columns, and the ``needed`` ones beside it: no name that an operator gives can
    meet a column of the user's, and ``row.*`` gives them back."""
    return docs.select(F.struct("*").alias("row"), *[F.col(f"`{c}`") for c in needed])


def words_of(text: str | None) -> list[bytes]:
    """Words of the whole text in UTF-8. ``bytes.split`` cuts at exactly the ASCII white space."""
    return text.encode().split() if text else []


def lowered_words_of(text: str | None) -> list[bytes]:
    """As ``words_of`` with A-Z in lower case; ``bytes.lower`` changes nothing else."""
    return text.encode().lower().split() if text else []


def held_out(doc_id: Column) -> Column:
    """One document in five: crc32 of the id's text, modulo 5, is 0. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def span_text(kind: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", kind, start.cast("string"), end.cast("string"))
