"""Classification by text prototypes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.templates import EVALUATION_TEMPLATES, Template, expand_prompts
from ..operators.aggregates import vector_mean
from ..operators.metrics import accuracy_ks, topk_accuracy
from ..operators.scoring import match_prototypes
from ..session import cut_lineage
from .embed import Embedder, embed

LOGIT_SCALE = 100.0


def ensemble_prototypes(embedded: DataFrame, cls: str, vec: str, out: str = "w") -> DataFrame:
    """(class, w): mean of the unit vectors of a class, scaled to unit length again."""
    unit = embedded.select(cls, V.l2_normalize(vec).alias("_u"))
    return vector_mean(unit, "_u", [cls], "_m").select(cls, V.l2_normalize("_m").alias(out))


def text_prototypes(
    classes: DataFrame, embedder: Embedder, templates: Sequence[Template] = EVALUATION_TEMPLATES, name: str = "name",
    class_idx: str = "class_idx",
) -> DataFrame:
    """Prototypes of the classes from their prompts."""
    prompts = expand_prompts(classes.select(class_idx, name), name, templates)
    return ensemble_prototypes(embed(prompts, "prompt", embedder, [class_idx]), class_idx, "vector")


def zero_shot_eval(
    features: DataFrame, prototypes: DataFrame, key: str = "id", vec: str = "features", target: str = "target",
    class_idx: str = "class_idx", proto_vec: str = "w", scale: float = LOGIT_SCALE, ks: Sequence[int] | None = None,
) -> DataFrame:
    """One row: n and the accuracy at 1, 3 and 5 (at most the number of classes)."""
    written = cut_lineage(prototypes.select(F.col(class_idx).cast("bigint").alias(class_idx), proto_vec))
    ks = accuracy_ks(written.count()) if ks is None else list(ks)
    ranked = match_prototypes(
        features, written, fixed=True, vec=vec, proto_vec=proto_vec, label=class_idx, k=1, metric="dot", scale=scale,
        truth=target, keep=[key],
    )
    # A sample whose class has no prototype can never be right.
    return topk_accuracy(ranked.withColumn("n_better", F.coalesce("n_better", F.lit(1 << 62))), ks)
