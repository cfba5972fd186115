"""Text reports of a result and PDB files of a grid, as tables of lines and as files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators.finalise import Result

COLUMNS = ("d", "mddf", "kb", "md_count", "md_count_random", "coordination_number", "coordination_number_random", "shell_volume")


def main_table(result: Result) -> DataFrame:
    """bin and line: the eight columns of the main table."""
    return result.bins.select("bin", F.concat(*(x for c in COLUMNS for x in (F.lit("  "), sc.formatted(F.col(c))))).alias("line"))


def group_table(result: Result, side: str, kind: str = "mddf") -> DataFrame:
    """bin, d and one column per group."""
    from ..operators.derived import as_type

    rows = as_type(result.groups.where(F.col("side") == side).groupBy("group_id", "bin").agg(F.sum("n").alias("n"), F.sum("n_random").alias("n_random")), result.bins, kind, ("group_id",))
    ids = [r[0] for r in rows.select("group_id").distinct().orderBy("group_id").collect()]
    return rows.groupBy("bin").pivot("group_id", ids).agg(F.first("value")).join(result.bins.select("bin", "d"), "bin").select("bin", "d", *(F.col(f"`{k}`").alias(f"group_{k}") for k in ids))


def group_names(result: Result, side: str, names=None) -> list[str]:
    own = getattr(result, side)
    default = list(own.group_names) if own is not None else []
    if names is None:
        return default
    if own is not None and len(names) != own.n_groups:
        raise ValueError("as many names as groups are needed")
    return list(names)


def write(path: str, result: Result, solute_group_names=None, solvent_group_names=None) -> tuple[str, str, str]:
    """Write the main table and those of the groups' contributions (a histogram's rows) beside it."""
    path = os.path.expanduser(path)
    stem, ext = os.path.splitext(path)
    s = result.scalars().first()
    head = ["#", f"# Minimum-distance distribution, version {result.version}", "#", "# Trajectory files and weights:"]
    head += [f"#  {f[0]} - w = {w}" for f, w in zip(result.files, result.weights, strict=False)]
    molar = lambda x: sc.CM3_PER_MOL / x if x else float("inf")
    head += ["#", f"# Density of solvent in the box (sites/A^3): {s.density_solvent:15.8f}", f"# Density of solvent in bulk (sites/A^3): {s.density_solvent_bulk:15.8f}", f"# Molar volume of solvent in the box (cc/mol): {molar(s.density_solvent):14.8f}", f"# Molar volume of solvent in bulk (cc/mol): {molar(s.density_solvent_bulk):14.8f}", "#", "# " + ", ".join(COLUMNS)]
    with open(path, "w") as f:
        f.write("\n".join([*head, *(r.line for r in main_table(result).orderBy("bin").collect())]) + "\n")
    out = [path]
    for side, names in (("solute", solute_group_names), ("solvent", solvent_group_names)):
        own = f"{stem}-GROUP_CONTRIBUTIONS_{side.upper()}{ext or '.dat'}"
        rows = group_table(result, side).orderBy("bin").collect()
        titles = group_names(result, side, names)
        with open(own, "w") as f:
            f.write(f"# Contributions of the groups of the {side}\n# " + " ".join(["distance", *titles]) + "\n")
            for r in rows:
                f.write("  ".join(f"{x:12.7f}" if abs(x) < 998 else f"{x:12.5e}" for x in r[1:]) + "\n")
        out.append(own)
    return tuple(out)


def pdb_lines(grid: DataFrame) -> DataFrame:
    """Grid points as PDB ATOM lines: occupancy is the distance, the temperature factor the value."""
    line = F.format_string("ATOM  %5d %-4s %-4s%1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", F.pmod(F.col("atom"), F.lit(100000)), F.lit("X"), F.lit("GRD"), F.lit("A"), F.lit(1), "gx", "gy", "gz", "r", "value")
    return grid.select("ix", "iy", "iz", line.alias("line"))


def write_grid(path: str, grid: DataFrame) -> str:
    """Write the grid's points as a PDB file."""
    with open(os.path.expanduser(path), "w") as f:
        for r in pdb_lines(grid).orderBy("ix", "iy", "iz").toLocalIterator():
            f.write(r.line + "\n")
        f.write("END\n")
    return path


def title(result: Result) -> str:
    """The heading of a run."""
    kind = "autocorrelation" if result.autocorrelation else "solute and solvent"
    return f"Shell analysis of {kind}, format {result.version}"


def volumes(result: Result) -> str:
    s = result.scalars().first()
    rows = (("Total", s.volume_total), ("Solute domain", s.volume_domain), ("Bulk", s.volume_bulk))
    return "Mean volumes (A^3)\n" + "\n".join(f"  {k}: {v:.6g}" for k, v in rows)


def densities(result: Result) -> str:
    s = result.scalars().first()
    rows = (("Solvent", s.density_solvent), ("Solvent in bulk", s.density_solvent_bulk), ("Solute", s.density_solute))
    return "Mean densities (sites/A^3)\n" + "\n".join(f"  {k}: {v:.6g}" for k, v in rows)


def summary(result: Result) -> str:
    """A result in words: run, files, selections, options, volumes and densities, and the tail of the distribution."""
    t = result.tail().first()
    number = lambda x: "-" if x is None else f"{x:.4f}"
    rows = [title(result), *(f"  file {f[0]}, weight {w:.4g}" for f, w in zip(result.files, result.weights, strict=False))]
    rows += [f"  solute: {result.solute or result.n_solute}", f"  solvent: {result.solvent or result.n_solvent}", str(result.options)]
    rows += [volumes(result), densities(result), f"Long-range mean (deviation): {number(t.mddf_mean)} ({number(t.mddf_std)}), expected 1"]
    return "\n".join(rows)


def overview_text(result: Result) -> str:
    """Concentrations and molar volumes in words."""
    from ..operators.derived import overview

    r = overview(result).first().asDict()
    return "Overview\n" + "\n".join(f"  {k.replace('_', ' ')}: {v:.6g}" for k, v in r.items() if v is not None)
