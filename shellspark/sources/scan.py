"""What a format gives: the cells, and the coordinates of chosen frames and of the first atoms only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen(first: int, last: int, stride: int) -> Column:
    """Is ``frame`` one of first:stride:last (-1: to the end)?"""
    own = F.col("frame") >= first
    if last >= 0:
        own &= F.col("frame") <= last
    return own & (F.pmod(F.col("frame") - first, F.lit(stride)) == 0) if stride > 1 else own


@dataclass
class Scan:
    """cells: frame, m, volume; read: from the first and last frame (-1: to the end), the stride and the last atom (0: all), the table
    frame, atom_index, x, y, z."""

    cells: DataFrame
    read: Callable[[int, int, int, int], DataFrame]

    @classmethod
    def of(cls, coords: DataFrame, cells: DataFrame) -> Scan:
        """Over tables: the choice becomes filters, also on ``span`` (a range of frames by which they may be stored)."""

        def read(first: int, last: int, stride: int, lastatom: int) -> DataFrame:
            own = coords.where(chosen(first, last, stride)) if (first, last, stride) != (1, -1, 1) else coords
            return own.where(F.col("atom_index") <= lastatom) if lastatom else own

        return cls(cells, read)

    def coords(self, first: int = 1, last: int = -1, stride: int = 1, lastatom: int = 0) -> DataFrame:
        return self.read(first, last, stride, lastatom)
