"""Repeatable uniforms: the same row draws the same number in every run and on every executor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *ids: Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of an md5 over the seed and the ids."""
    text = F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def gumbel(seed: int, *ids: Column) -> Column:
    """Standard Gumbel noise; the half step keeps the logarithm finite."""
    u = uniform(seed, *ids) + F.lit(0.5 / 4294967296.0)
    return -F.log(-F.log(u))
