"""Scalars of the histograms: bins, shells, units and number formats."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Avogadro number and the unit conversions that follow from it.
MOLE = 6.022140857e23
CM3_PER_MOL = MOLE / 1e24
MOL_PER_L = 1e27 / MOLE


def bin_of(distance: Column, step: float) -> Column:
    """Bin of a distance, from 1 (null: null)."""
    return F.when(distance.isNotNull(), F.greatest(F.lit(1), F.ceil(distance / F.lit(float(step))))).cast("int")


def shell_volume(i: Column, step: float) -> Column:
    """Volume of the spherical shell of bin i."""
    r = (i - 1) * F.lit(float(step))
    s = r + F.lit(float(step))
    return F.lit(4 * math.pi / 3) * (s * s * s - r * r * r)


def shell_radius(i: Column, step: float) -> Column:
    """Radius that halves the volume of the shell of bin i."""
    r = (i - 1) * F.lit(float(step))
    s = r + F.lit(float(step))
    return F.cbrt(F.lit(0.5) * (s * s * s + r * r * r))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def quotient(a: Column, b: Column) -> Column:
    """a / b with the signed infinities and NaN of IEEE arithmetic."""
    inf = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b != 0, a / b).otherwise(inf)


def formatted(x: Column) -> Column:
    """Fixed or scientific notation in twelve columns, rounded from the binary value as C does.

    Java rounds the shortest decimal that stands for the number, so about one of ten million numbers has another last digit there.
    """

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else "%12.7f" % v if abs(v) < 998 else "%12.5e" % v for v in column.to_pylist()], pa.string())

    return text(x.cast("double"))


def interpolated(x0: Column, x1: Column, y0: Column, y1: Column, x: Column) -> Column:
    return y0 + (y1 - y0) / (x1 - x0) * (x - x0)
