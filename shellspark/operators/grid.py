"""A 3D grid around the solute, coloured by the contributions of the nearest atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc


def lattice(atoms: DataFrame, dmax: float, step: float) -> DataFrame:
    """Points of a regular grid over the atoms' box and dmax around it: gx, gy, gz."""
    box = atoms.agg(*(f(c).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, 0), (F.max, 1))))
    count = {c: F.ceil((F.col(f"{c}1") - F.col(f"{c}0") + 2 * dmax) / step + 1).cast("int") for c in "xyz"}
    rows = box
    for c in "xyz":
        rows = rows.withColumn(f"i{c}", F.explode(F.sequence(F.lit(1), count[c])))
        if c == "x":  # planes of points are made by separate tasks
            rows = rows.repartition("ix")
    return rows.select("ix", "iy", "iz", *((F.col(f"{c}0") - dmax + F.lit(step) * (F.col(f"i{c}") - 1)).alias(f"g{c}") for c in "xyz"))


def nearest_atom(points: DataFrame, atoms: DataFrame, dmax: float) -> DataFrame:
    """The closest atom within dmax of each point, without periodic images, by an equi-join on cells of that size."""
    cell = lambda c: F.floor(F.col(c) / dmax).cast("bigint")
    own = atoms.select("atom", "x", "y", "z")
    for c in "xyz":  # there are far fewer atoms than points, so atoms go to their neighbours' cells
        own = own.withColumn(f"c{c}", F.explode(F.array(*(cell(c) + k for k in (-1, 0, 1)))))
    far = points.select("*", *(cell(f"g{c}").alias(f"c{c}") for c in "xyz"))
    dx, dy, dz = (F.col(c) - F.col(f"g{c}") for c in "xyz")
    near = far.join(own, ["cx", "cy", "cz"]).withColumn("r", F.sqrt(dx * dx + dy * dy + dz * dz)).where(F.col("r") <= dmax)
    return near.groupBy("ix", "iy", "iz", "gx", "gy", "gz").agg(F.min(F.struct("r", "atom")).alias("m")).select("ix", "iy", "iz", "gx", "gy", "gz", "m.*")


def grid3d(atoms: DataFrame, profiles: DataFrame, dmin: float = 1.5, dmax: float = 5.0, step: float = 0.5) -> DataFrame:
    """Points with dmin < r < dmax: ix, iy, iz, gx, gy, gz, atom, r and value, scaled to 0 to 1.

    atoms: atom, x, y, z; profiles: atom, bin, d and the atom's contribution, for bins around [dmin, dmax].
    """
    span = profiles.agg(F.min("d"), F.max("d")).first()
    if span[0] is None or dmin < span[0] or dmax > span[1]:
        raise ValueError("dmin and dmax must lie within the distances of the result")
    w = Window.partitionBy("atom").orderBy("bin")
    steps = profiles.withColumns({"d0": F.lag("d").over(w), "v0": F.lag("value").over(w)}).where("d0 is not null")
    points = nearest_atom(lattice(atoms, dmax, step), atoms, dmax).where((F.col("r") > dmin) & (F.col("r") < dmax))
    # Each atom has at most as many profile rows as there are bins.
    rows = points.join(steps, "atom").where((F.col("d0") <= F.col("r")) & (F.col("r") < F.col("d")))
    rows = rows.withColumn("c", sc.interpolated(F.col("d0"), F.col("d"), F.col("v0"), F.col("value"), F.col("r"))).where("c > 0")
    ends = rows.agg(F.min("c").alias("low"), F.max("c").alias("high"))
    scaled = rows.crossJoin(F.broadcast(ends)).withColumn("value", sc.ratio(F.col("c") - F.col("low"), F.col("high") - F.col("low")))  # one row
    return scaled.select("ix", "iy", "iz", "gx", "gy", "gz", "atom", "r", "value")
