"""Uniform numbers from a key: the same for any partitioning, order of rows or engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(which: int, seed: int, *key: Column | str) -> Column:
    """The ``which``-th (0 to 3) uniform in [0, 1) of a key: 32 bits of its MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.lit(k) if isinstance(k, str) else k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text), 8 * which + 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def draw(u: Column, n: Column) -> Column:
    """One of 1 to n."""
    return F.floor(u * n).cast("bigint") + F.lit(1)
