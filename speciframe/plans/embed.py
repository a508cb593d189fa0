"""The model as a function from a column to unit vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V

#: A factory run once per Python worker; it returns the function from a batch to a matrix.
Embedder = Callable[[], Callable[[np.ndarray], np.ndarray]]


def hashing_embedder(dim: int = 32) -> Embedder:
    """A model stand-in without weights: words are hashed to signed dimensions."""
    def load():
        import zlib

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for i, text in enumerate(texts):
                for word in str(text).lower().split():
                    code = zlib.crc32(word.encode("utf-8"))
                    out[i, code % dim] += 1.0 if code & 0x80000000 else -1.0
            return out

        return predict

    return load


def embed(df: DataFrame, column: str, embedder: Embedder, keep: Sequence[str], out: str = "vector", batch_size: int = 512) -> DataFrame:
    """(keep..., out): unit vectors of a column, batch by batch inside the tasks."""
    run = predict_batch_udf(embedder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.select(*keep, run(F.col(column)).alias("_v")).select(*keep, V.l2_normalize("_v").cast("array<float>").alias(out))


def shared_features(df: DataFrame, column: str, embedder: Embedder, keep: Sequence[str], path: str) -> DataFrame:
    """Vectors computed once, written, and read back, for any number of evaluations."""
    embed(df, column, embedder, keep, "features").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
