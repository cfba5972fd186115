"""The library's functions under one roof: reading, selecting, calculating, analysing, writing."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import derived, grid
from .operators.derived import as_type, contributions, gr, merge, overview, renormalize
from .operators.finalise import Result
from .operators.residue_map import ResidueContributions
from .operators.selection import AtomSelection, Group, SoluteGroup, SolventGroup, select
from .options import Options
from .plans import engine
from .sinks.persistence import load, load_parquet, save, save_parquet
from .sinks.report import group_names, overview_text, summary, write, write_grid
from .sources.pdb import read_pdb
from .sources.trajectory import Trajectory

__all__ = [
    "AtomSelection", "Options", "ResidueContributions", "Result", "SoluteGroup", "SolventGroup", "Trajectory", "contributions", "coordination_number",
    "gr", "grid3D", "group_names", "load", "load_parquet", "mddf", "merge", "overview", "overview_text", "read_pdb", "renormalize", "save",
    "save_parquet", "select", "summary", "write", "write_grid",
]


def mddf(spark: SparkSession, source: str | Trajectory, *args, trajectory_format: str | None = None, frame_weights=None, coordination_number_only: bool = False, low_memory: bool = False) -> Result:
    """mddf(spark, trajectory, [options]) or mddf(spark, file, solute, [solvent], [options]).

    With one selection the solute is its own solvent.
    """
    selections = [a for a in args if isinstance(a, AtomSelection)]
    options = [a for a in args if isinstance(a, Options)]
    if len(selections) + len(options) != len(args) or len(options) > 1:
        raise TypeError("the arguments are selections, followed by options")
    if isinstance(source, Trajectory):
        if selections:
            raise TypeError("a trajectory has its selections already")
        trajectory = source
    else:
        if not 1 <= len(selections) <= 2:
            raise TypeError("a file needs one or two selections")
        trajectory = Trajectory.open(spark, source, *selections, format=trajectory_format)
    o = options[0] if options else Options()
    result = engine.mddf(trajectory.system(o, frame_weights), coordination_number_only=coordination_number_only)
    if coordination_number_only and not o.silent:
        warnings.warn("only coordination numbers were computed", stacklevel=2)
    return replace(result, solute=trajectory.solute, solvent=trajectory.solvent)


def coordination_number(source: SparkSession | Result, *args, **options) -> Result | DataFrame:
    """coordination_number(spark, trajectory or file, ...) counts only; coordination_number(result, [group]) is that of a result."""
    if isinstance(source, Result):
        group = args[0] if args else options.pop("group", None)
        if group is not None and not isinstance(group, Group):
            raise TypeError("the group is a SoluteGroup or a SolventGroup")
        return derived.coordination_number(source, group)
    if "coordination_number_only" in options:
        raise ValueError("coordination_number_only is set by this function")
    return mddf(source, *args, coordination_number_only=True, **options)


def grid3D(  # noqa: N802
    result: Result, atoms: DataFrame, path: str | None = None, dmin: float = 1.5, dmax: float = 5.0, step: float = 0.5, type: str = "mddf"  # noqa: A002
) -> DataFrame:
    """Grid points around the solute atoms of ``atoms`` (atom_index, x, y, z), valued by the nearest atom's contribution; written as PDB to ``path``."""
    solute = result.solute
    if solute is None or solute.custom_groups:
        raise ValueError("a grid needs the contributions of all solute atoms, not custom groups")
    types = solute.table(atoms.sparkSession).select("atom_index", F.col("atype").alias("group_id"))
    own = atoms.join(types, "atom_index").select(F.col("atom_index").alias("atom"), "group_id", "x", "y", "z")
    if not own.limit(1).count():
        raise ValueError("no atom of the solute is in the table")
    values = as_type(result.groups.where("side = 'solute'"), result.bins, type, ("group_id",))
    profiles = own.select("atom", "group_id").join(values, "group_id").select("atom", "bin", "d", "value")
    points = grid.grid3d(own, profiles, dmin, dmax, step)
    if path is not None:
        write_grid(path, points)
    return points
