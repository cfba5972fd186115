"""Results made from a result: contributions of groups, g(r), merging, another bulk density, an overview, comparison."""

from __future__ import annotations

import math
import warnings
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from . import finalise as fi
from .selection import Group

TYPES = ("mddf", "md_count", "coordination_number", "kbi")


def as_type(rows: DataFrame, bins: DataFrame, kind: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Summed group counts (by, bin, n, n_random) over all bins as a contribution: by, bin, d, value."""
    if kind not in TYPES:
        raise ValueError(f"the type must be one of {', '.join(TYPES)}")
    own = bins.select("bin", "d", "md_count_random", "density_solvent_bulk")
    if by:
        keys = rows.select(*by).distinct()
        own = keys.join(F.broadcast(own), how="cross")  # the bins of a histogram: Options.nbins rows
    out = own.join(rows, [*by, "bin"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("n", "n_random")})
    if kind == "mddf":
        value = sc.ratio(F.col("n"), F.col("md_count_random"))
    elif kind == "md_count":
        value = F.col("n")
    else:
        run = Window.partitionBy(*(by or (F.lit(0),))).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        value = F.sum("n").over(run)
        if kind == "kbi":
            value = sc.quotient(F.lit(sc.CM3_PER_MOL), F.col("density_solvent_bulk")) * (value - F.sum("n_random").over(run))
    return out.select(*by, "bin", "d", value.alias("value"))


def _chosen(result: fi.Result, group: Group) -> tuple[DataFrame, float]:
    """Group rows that the group stands for, and what to divide them by."""
    side = getattr(result, group.side)
    rows = result.groups.where(F.col("side") == group.side)
    custom = side is not None and side.custom_groups
    if group.index is not None or group.name is not None:
        if not custom:
            raise ValueError("group numbers and names need custom groups")
        side.atom_group(group.name if group.name is not None else group.index)
        which = group.index if group.index is not None else side.group_names.index(group.name) + 1
        return rows.where(F.col("group_id") == which), 1.0
    if custom:
        raise ValueError("with custom groups contributions are by group number or name")
    if group.atom_names is not None:
        missing = set(group.atom_names) - set(side.group_names)
        if missing:
            raise ValueError(f"there are no atoms named {', '.join(sorted(missing))}")
        return rows.where(F.col("group_id").isin([k for k, x in enumerate(side.group_names, 1) if x in group.atom_names])), 1.0
    types = side.types(group.atom_indices)
    times = rows.sparkSession.createDataFrame([(t, float(types.count(t))) for t in sorted(set(types))], "group_id int, times double")
    rows = rows.join(F.broadcast(times), "group_id").withColumns({c: F.col(c) * F.col("times") for c in ("n", "n_random")})
    return rows, float(side.nmols)


def contributions(result: fi.Result, group: Group, type: str = "mddf") -> DataFrame:  # noqa: A002
    """bin, d and value: what the group contributes to the distribution, counts, coordination number or integral."""
    if type not in TYPES:
        raise ValueError(f"the type must be one of {', '.join(TYPES)}")
    if not isinstance(group, Group):
        raise TypeError("contributions are those of a SoluteGroup or SolventGroup")
    rows, share = _chosen(result, group)
    if type == "mddf" and result.bins.agg(F.max("md_count_random")).first()[0] == 0:
        warnings.warn("all random counts are zero, so the contributions are", stacklevel=2)
    summed = rows.groupBy("bin").agg((F.sum("n") / share).alias("n"), (F.sum("n_random") / share).alias("n_random"))
    return as_type(summed, result.bins, type)


def coordination_number(result: fi.Result, group: Group | None = None) -> DataFrame:
    return result.coordination_number() if group is None else contributions(result, group, "coordination_number")


def gr(bins: DataFrame, binstep: float, count: str = "rdf_count", density: str = "density_solvent_bulk") -> DataFrame:
    """bin, d, gr and kb of a count against analytic shells."""
    g = sc.quotient(F.col(count) / sc.shell_volume(F.col("bin"), binstep), F.col(density))
    rows = bins.select("bin", "d", g.alias("gr"))
    step = F.lit(4 * math.pi) * (F.col("gr") - 1) * F.col("d") * F.col("d") * binstep
    return rows.withColumn("kb", F.lit(sc.CM3_PER_MOL) * F.sum(step).over(fi.so_far()))


def renormalize(result: fi.Result, density: float, unit: str = "mol/L") -> fi.Result:
    """The result for another bulk density; the density that the result reports stays."""
    if unit not in ("mol/L", "sites/Angs3"):
        raise ValueError("the unit must be mol/L or sites/Angs3")
    rho = density / sc.MOL_PER_L if unit == "mol/L" else density
    fix = F.lit(rho) / F.col("density_solvent_bulk")
    one = result.bins.where("bin = 1").select(fix.alias("fix"))
    groups = result.groups.crossJoin(F.broadcast(one)).withColumn("n_random", F.col("n_random") * F.col("fix")).drop("fix")  # one row
    return replace(result, bins=fi.distributions(result.bins, fix), groups=groups)


def merge_weights(files: list[tuple[str, int]]) -> list[float]:
    """Each file's share of all frames."""
    total = sum(n for _, n in files)
    return [n / total for _, n in files]


def merge(results: list[fi.Result]) -> fi.Result:
    """Mean of results, weighted by their frame weights."""
    first = results[0]
    for other in results[1:]:
        if other.nbins != first.nbins:
            raise ValueError("the results have different numbers of bins")
        if not math.isclose(other.options.cutoff, first.options.cutoff):
            raise ValueError("the results have different cutoffs")
        if other.solute != first.solute or other.solvent != first.solvent or other.autocorrelation != first.autocorrelation:
            raise ValueError("the results have different selections")
        if (other.n_solute, other.n_solvent) != (first.n_solute, first.n_solvent):
            raise ValueError("the results have different numbers of molecules")
    q = [r.extra["q"] for r in results]
    share = [x / sum(q) for x in q]
    files = tuple(f for r in results for f in r.files)
    weights = tuple(merge_weights([(str(f[0]), f[1]) for f in files])) if files else tuple(share)
    if len(weights) == len(share) and any(not math.isclose(a, b) for a, b in zip(weights, share, strict=True)):
        warnings.warn("frame weights make the weights of the results differ from their shares of frames", stacklevel=2)
    names = [c for c in first.bins.columns if c not in ("bin", "d")]
    scaled = [r.bins.select("bin", "d", *((F.col(c) * w).alias(c) for c in names)) for r, w in zip(results, share, strict=True)]
    bins = reduce(DataFrame.unionByName, scaled).groupBy("bin").agg(F.first("d").alias("d"), *(F.sum(c).alias(c) for c in names))
    own = [r.groups.select("side", "group_id", "bin", (F.col("n") * w).alias("n"), (F.col("n_random") * w).alias("n_random")) for r, w in zip(results, share, strict=True)]
    groups = reduce(DataFrame.unionByName, own).groupBy("side", "group_id", "bin").agg(F.sum("n").alias("n"), F.sum("n_random").alias("n_random"))
    return replace(first, bins=bins, groups=groups, files=files, weights=weights, extra=first.extra | {"q": sum(q)})


def overview(result: fi.Result) -> DataFrame:
    """One row: densities in mol/L and molar volumes in cm3/mol."""
    s = result.scalars()
    c = lambda name: F.col(f"density_{name}") * sc.MOL_PER_L
    molar = lambda name: sc.quotient(F.lit(1000.0), c(name))
    own = molar("solvent") if result.autocorrelation else sc.quotient(F.lit(sc.CM3_PER_MOL) * (F.col("density_solvent_bulk") * F.col("volume_total") - F.lit(float(result.n_solvent))), F.col("density_solvent_bulk"))
    return s.select(c("solute").alias("solute_mol_per_l"), c("solvent").alias("solvent_mol_per_l"), c("solvent_bulk").alias("solvent_bulk_mol_per_l"), molar("solvent").alias("solvent_molar_volume"), molar("solvent_bulk").alias("solvent_molar_volume_bulk"), own.alias("solute_molar_volume"), (F.col("volume_domain") * sc.CM3_PER_MOL).alias("domain_molar_volume"))


def smooth(rows: DataFrame, column: str, half: int, order: str = "bin") -> DataFrame:
    """Moving average over ``half`` bins to each side."""
    return rows.withColumn(f"{column}_smooth", F.avg(column).over(Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(-half, half)))


def differences(a: fi.Result, b: fi.Result, tolerance: float = 0.0) -> DataFrame:
    """column and bin of the values of two results that differ by more than the relative tolerance."""
    names = [c for c in a.bins.columns if c != "bin"]
    long = lambda r, v: r.bins.select("bin", F.explode(F.create_map(*(x for c in names for x in (F.lit(c), F.col(c).cast("double"))))).alias("column", v))
    both = long(a, "a").join(long(b, "b"), ["bin", "column"], "full")
    return both.where(~(F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance * F.greatest(F.abs("a"), F.abs("b")), F.lit(False)) | F.col("a").eqNullSafe(F.col("b"))))
