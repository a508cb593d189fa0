"""Prompt templates. The texts are part of the expected results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import seeded_int

SIMPLE_TEMPLATES = (
    "itap of a {}.",
    "a bad photo of the {}.",
    "a origami {}.",
    "a photo of the large {}.",
    "a {} in a video game.",
    "art of the {}.",
    "a photo of the small {}.",
)

IMAGE_TEMPLATES = (
    "a bad photo of a {}.",
    "a photo of many {}.",
    "a sculpture of a {}.",
    "a photo of the hard to see {}.",
    "a low resolution photo of the {}.",
    "a rendering of a {}.",
    "graffiti of a {}.",
    "a bad photo of the {}.",
    "a cropped photo of the {}.",
    "a tattoo of a {}.",
    "the embroidered {}.",
    "a photo of a hard to see {}.",
    "a bright photo of a {}.",
    "a photo of a clean {}.",
    "a photo of a dirty {}.",
    "a dark photo of the {}.",
    "a drawing of a {}.",
    "a photo of my {}.",
    "the plastic {}.",
    "a photo of the cool {}.",
    "a close-up photo of a {}.",
    "a black and white photo of the {}.",
    "a painting of the {}.",
    "a painting of a {}.",
    "a pixelated photo of the {}.",
    "a sculpture of the {}.",
    "a bright photo of the {}.",
    "a cropped photo of a {}.",
    "a plastic {}.",
    "a photo of the dirty {}.",
    "a jpeg corrupted photo of a {}.",
    "a blurry photo of the {}.",
    "a photo of the {}.",
    "a good photo of the {}.",
    "a rendering of the {}.",
    "a {} in a video game.",
    "a photo of one {}.",
    "a doodle of a {}.",
    "a close-up photo of the {}.",
    "a photo of a {}.",
    "the origami {}.",
    "the {} in a video game.",
    "a sketch of a {}.",
    "a doodle of the {}.",
    "a origami {}.",
    "a low resolution photo of a {}.",
    "the toy {}.",
    "a rendition of the {}.",
    "a photo of the clean {}.",
    "a photo of a large {}.",
    "a rendition of a {}.",
    "a photo of a nice {}.",
    "a photo of a weird {}.",
    "a blurry photo of a {}.",
    "a cartoon {}.",
    "art of a {}.",
    "a sketch of the {}.",
    "a embroidered {}.",
    "a pixelated photo of a {}.",
    "itap of the {}.",
    "a jpeg corrupted photo of the {}.",
    "a good photo of a {}.",
    "a plushie {}.",
    "a photo of the nice {}.",
    "a photo of the small {}.",
    "a photo of the weird {}.",
    "the cartoon {}.",
    "art of the {}.",
    "a drawing of the {}.",
    "a photo of the large {}.",
    "a black and white photo of a {}.",
    "the plushie {}.",
    "a dark photo of a {}.",
    "itap of a {}.",
    "graffiti of the {}.",
    "a toy {}.",
    "itap of my {}.",
    "a photo of a cool {}.",
    "a photo of a small {}.",
    "a tattoo of the {}.",
)

# The evaluation list has one plain template in front of the others.
EVALUATION_TEMPLATES = ("a photo of {}.",) + IMAGE_TEMPLATES

Template = str | Callable[[Column], Column]


def fill(template: Template, name: Column) -> Column:
    """A format string with ``{}``, or a function from the name column to the prompt column."""
    if callable(template):
        return template(name)
    return F.replace(F.lit(template), F.lit("{}"), name)


def expand_prompts(
    classes: DataFrame, name: str, templates: Sequence[Template] = EVALUATION_TEMPLATES
) -> DataFrame:
    """One row per class and template. The templates are a short literal list, so this is a
    row-wise generator without join or shuffle."""
    templates = list(templates)
    if not any(callable(t) for t in templates):
        listed = classes.select("*", F.posexplode(F.lit(templates)).alias("template_id", "prompt"))
        return listed.withColumn("prompt", F.replace("prompt", F.lit("{}"), F.col(name)))
    entries = [
        F.struct(F.lit(i).alias("template_id"), fill(t, F.col(name)).alias("prompt"))
        for i, t in enumerate(templates)
    ]
    return classes.select("*", F.inline(F.array(*entries)))


def random_text_type(step, names: Sequence[str], seed: int = 0) -> Column:
    """One of the text columns, chosen by the step."""
    pick = F.pmod(seeded_int(seed, step), F.lit(len(names)).cast("bigint")).cast("int")
    return F.element_at(F.array(*[F.col(n) for n in names]), pick + 1)
