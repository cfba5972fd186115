"""Weighted histograms of minimum distances, in all and by group of atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bin_of


def weighted(md: DataFrame, frames: DataFrame) -> DataFrame:
    return md.join(frames.select("frame", "w"), "frame")


def histogram(rows: DataFrame, distance: str, step: float, weight: Column, name: str) -> DataFrame:
    """bin and the summed weight of rows with a distance."""
    return rows.where(F.col(distance).isNotNull()).groupBy(bin_of(F.col(distance), step).alias("bin")).agg(F.sum(weight).alias(name))


def counts(md: DataFrame, step: float, suffix: str = "") -> DataFrame:
    """bin, md_count and rdf_count from one aggregation of the pairs."""
    w = F.col("w")
    both = md.select(F.explode(F.array(F.struct(bin_of(F.col("d"), step).alias("bin"), w.alias("a"), F.lit(0.0).alias("b")), F.struct(bin_of(F.col("d_ref"), step).alias("bin"), F.lit(0.0).alias("a"), F.when(F.col("d_ref").isNotNull(), w).otherwise(0.0).alias("b")))).alias("r")).select("r.*")
    return both.where("bin is not null").groupBy("bin").agg(F.sum("a").alias(f"md_count{suffix}"), F.sum("b").alias(f"rdf_count{suffix}"))


def group_counts(md: DataFrame, step: float, groups: DataFrame | None = None, autocorrelation: bool = False, name: str = "n") -> DataFrame:
    """side, group_id, bin and the summed weight of each side's closest atoms.

    Without ``groups`` (side, group_id, atom), an atom's group is its type.  Where solute and solvent are the same, half of
    the weight goes to each of the two atoms, and both sides get the sum.
    """
    half = F.lit(0.5) if autocorrelation else F.lit(1.0)
    sides = F.array(F.struct(F.lit("solute").alias("side"), F.col("i").alias("atom"), F.col("satype").alias("atype")), F.struct(F.lit("solvent").alias("side"), F.col("j").alias("atom"), F.col("vatype").alias("atype")))
    rows = md.select(bin_of(F.col("d"), step).alias("bin"), (F.col("w") * half).alias("w"), F.explode(sides).alias("s")).select("bin", "w", "s.*")
    if autocorrelation:
        rows = rows.drop("side").crossJoin(F.broadcast(md.sparkSession.createDataFrame([("solute",), ("solvent",)], "side string")))
    if groups is None:
        rows = rows.withColumn("group_id", F.col("atype").cast("int"))
    else:
        rows = rows.join(groups.select("side", "group_id", "atom"), ["side", "atom"])
    return rows.groupBy("side", "group_id", "bin").agg(F.sum("w").alias(name))


def dense(spark, nbins: int) -> DataFrame:
    """All bins, from 1."""
    return spark.range(1, nbins + 1).select(F.col("id").cast("int").alias("bin"))
