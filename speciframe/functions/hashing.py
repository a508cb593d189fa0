"""Seeded pseudo-random order and uniforms that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed, *keys) -> Column:
    """md5 of ``seed:key:key...`` as 32 hex digits; sorting by it is a seeded shuffle."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", first.cast("string"), *[p.cast("string") for p in parts]))


def seeded_int(seed, *keys) -> Column:
    """First eight hex digits of the seeded key as an integer in [0, 2^32)."""
    return F.conv(F.substring(seeded_key(seed, *keys), 1, 8), 16, 10).cast("bigint")


def seeded_uniform(seed, *keys) -> Column:
    """Uniform double in [0, 1)."""
    return seeded_int(seed, *keys).cast("double") / F.lit(4294967296.0)
