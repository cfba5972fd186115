"""From counts to distribution functions, coordination numbers, integrals, volumes and densities."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..options import VERSION, Options

SCALARS = ("volume_total", "volume_domain", "volume_bulk", "density_solvent", "density_solute", "density_solvent_bulk")


def all_bins():
    """A window over all bins; there is one row per bin, at most a few thousand."""
    return Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def so_far():
    """A window over the bins up to the row's own."""
    return Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)


@dataclass
class Result:
    """bins: one row per bin, with the scalars repeated; groups: side, group_id, group_name, bin, n, n_random."""

    bins: DataFrame
    groups: DataFrame
    options: Options
    n_solute: float
    n_solvent: float
    autocorrelation: bool = False
    solute: object = None
    solvent: object = None
    files: tuple = ()
    weights: tuple = ()
    version: str = VERSION
    extra: dict = field(default_factory=dict)

    @property
    def nbins(self) -> int:
        return self.options.nbins

    def scalars(self) -> DataFrame:
        return self.bins.where("bin = 1").select(*SCALARS)

    def coordination_number(self) -> DataFrame:
        return self.bins.select("bin", "d", "coordination_number")

    def tail(self) -> DataFrame:
        """Mean and sample deviation of mddf and rdf over about the last Å."""
        first = int(self.nbins - 1 / self.options.binstep)
        rows = self.bins.where(F.col("bin") >= first)
        return rows.agg(F.avg("mddf").alias("mddf_mean"), F.stddev_samp("mddf").alias("mddf_std"), F.avg("rdf").alias("rdf_mean"), F.stddev_samp("rdf").alias("rdf_std"))


def distributions(bins: DataFrame, fix: Column) -> DataFrame:
    """Random counts times ``fix``, running sums, ratios (0 where nothing is expected) and Kirkwood-Buff integrals."""
    out = bins.withColumns({c: F.col(c) * fix for c in ("md_count_random", "rdf_count_random")})
    out = out.withColumns({"coordination_number": F.sum("md_count").over(so_far()), "coordination_number_random": F.sum("md_count_random").over(so_far()), "sum_rdf_count": F.sum("rdf_count").over(so_far()), "sum_rdf_count_random": F.sum("rdf_count_random").over(so_far())})
    per = sc.quotient(F.lit(sc.CM3_PER_MOL), F.col("density_solvent_bulk"))
    return out.withColumns({"mddf": sc.ratio(F.col("md_count"), F.col("md_count_random")), "rdf": sc.ratio(F.col("rdf_count"), F.col("rdf_count_random")), "kb": per * (F.col("coordination_number") - F.col("coordination_number_random")), "kb_rdf": per * (F.col("sum_rdf_count") - F.col("sum_rdf_count_random"))})


def mddf_bins(counts: DataFrame, random: DataFrame, options: Options, n_solute: float, n_solvent: float, solvent_nmols: float, q: float, v: float) -> DataFrame:
    """All bins with every per-bin quantity and the scalars."""
    spark, o = counts.sparkSession, options
    bins = spark.range(1, o.nbins + 1).select(F.col("id").cast("int").alias("bin"))
    bins = bins.join(counts, "bin", "left").join(random, "bin", "left")
    by = {"md_count": n_solute * q, "rdf_count": n_solute * q, "md_count_random": o.n_random_samples * q, "rdf_count_random": o.n_random_samples * q}
    bins = bins.withColumns({c: F.coalesce(c, F.lit(0.0)) / F.lit(float(x)) for c, x in by.items()})
    bins = bins.withColumns({"d": sc.shell_radius(F.col("bin"), o.binstep), "shell_volume": F.lit(v) * (F.col("rdf_count_random") / F.lit(float(solvent_nmols)))})
    inside, outside = F.col("bin") < o.ibulk, F.col("bin") >= o.ibulk
    total = lambda c, where: F.sum(F.when(where, F.col(c)).otherwise(0.0)).over(all_bins())
    domain = total("shell_volume", inside)
    if o.usecutoff:
        bulk, n_bulk = total("shell_volume", outside), total("rdf_count", outside)
    else:
        bulk, n_bulk = F.lit(v) - domain, F.lit(float(solvent_nmols)) - total("rdf_count", F.lit(True))
    bins = bins.withColumns({"volume_total": F.lit(v), "volume_domain": domain, "volume_bulk": bulk, "density_solvent": F.lit(n_solvent / v), "density_solute": F.lit(n_solute / v), "n_bulk": n_bulk})
    bins = bins.withColumn("density_solvent_bulk", sc.quotient(F.col("n_bulk"), F.col("volume_bulk"))).drop("n_bulk")
    return distributions(bins, F.col("density_solvent_bulk") / F.col("density_solvent"))


def coordination_bins(counts: DataFrame, options: Options, n_solute: float, n_solvent: float, q: float, v: float) -> DataFrame:
    """The bins without a random reference: what depends on it is 0."""
    spark, o = counts.sparkSession, options
    bins = spark.range(1, o.nbins + 1).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left")
    zero = F.lit(0.0)
    bins = bins.withColumns({c: F.coalesce(c, zero) / F.lit(float(n_solute * q)) for c in ("md_count", "rdf_count")})
    bins = bins.withColumns({"d": sc.shell_radius(F.col("bin"), o.binstep), "coordination_number": F.sum("md_count").over(so_far()), "sum_rdf_count": F.sum("rdf_count").over(so_far())})
    none = ("shell_volume", "md_count_random", "rdf_count_random", "coordination_number_random", "sum_rdf_count_random", "mddf", "rdf", "kb", "kb_rdf", "volume_domain", "volume_bulk", "density_solvent_bulk")
    return bins.withColumns({c: zero for c in none} | {"volume_total": F.lit(v), "density_solvent": F.lit(n_solvent / v), "density_solute": F.lit(n_solute / v)})


def group_rows(md: DataFrame, random: DataFrame | None, n_solute: float, samples: int, q: float, fix: DataFrame | None) -> DataFrame:
    """Scaled group counts: side, group_id, bin, n, n_random (times the density fix, a one-row table)."""
    rows = md.withColumn("n", F.col("n") / F.lit(float(n_solute * q)))
    if random is None:
        return rows.withColumn("n_random", F.lit(0.0))
    other = random.withColumn("n_random", F.col("n_random") / F.lit(float(samples * q)))
    rows = rows.join(other, ["side", "group_id", "bin"], "full").select("side", "group_id", "bin", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("n_random", F.lit(0.0)).alias("n_random"))
    return rows.crossJoin(F.broadcast(fix)).withColumn("n_random", F.col("n_random") * F.col("fix")).drop("fix")  # fix has one row
