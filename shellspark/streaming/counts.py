"""Counts of minimum distances over frames that arrive as a stream of molecule pairs.

Counts add up over frames, so a stream needs no watermark: the histogram is its state, of as many rows as bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bin_of


def md_count(pairs: DataFrame, step: float) -> DataFrame:
    """bin and md_count of a stream (or table) of pairs with d and w; for the complete output mode."""
    return pairs.groupBy(bin_of(F.col("d"), step).alias("bin")).agg(F.sum("w").alias("md_count"))
