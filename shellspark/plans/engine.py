"""The two calculations: minimum-distance distribution functions, and coordination numbers alone."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import finalise as fi
from ..operators import histograms as hi
from ..operators import pairs as pr
from ..operators import random_reference as rr
from ..operators import tallies as ta
from .staging import settled
from .system import System


def minimum_distances(system: System, strategy: str = "cells", few: bool = False) -> DataFrame:
    """Pairs of molecules of the considered frames within the search radius."""
    s = system.pruned()
    near = pr.range_join(s.solute, s.solvent, s.frames, s.options.radius, s.ortho, strategy=strategy, lcell=s.options.lcell, few=few)
    return pr.min_distance(near, s.irefatom, autocorrelation=s.autocorrelation)


def least_pairs(system: System) -> DataFrame:
    """The same pairs and distances to the reference atom, made where the molecules meet: frame, smol, vmol, d, i, j, d_ref."""
    s = system.pruned()
    return ta.least_pairs(s.solute, s.solvent, s.frames, s.options.radius, s.irefatom, s.ortho, s.autocorrelation)


def reference_distances(system: System, strategy: str = "cells") -> DataFrame:
    """Pairs of the molecules that the random reference is put around, a few for each frame."""
    refs = rr.reference_solutes(system.pruned()).select("frame", "sidx").distinct()
    return minimum_distances(replace(system, solute=system.solute.join(F.broadcast(refs), ["frame", "sidx"])), strategy, few=True)


def random_distances(system: System, md: DataFrame | None = None, strategy: str = "cells") -> DataFrame:
    if md is None:
        md = settled(reference_distances(system, strategy), "pairs")
    return rr.random_pairs(system.pruned(), md, strategy)


def tallies(system: System) -> DataFrame:
    """Pairs of molecules of the considered frames, counted by frame, bin and groups; the pairs themselves are not kept."""
    s = system.pruned()
    return ta.tally(s.solute, s.solvent, s.frames, s.options.radius, s.options.binstep, s.irefatom, s.ortho, s.groups, s.autocorrelation)


def mddf(system: System, *, coordination_number_only: bool = False, strategy: str = "cells", md: DataFrame | None = None, random: DataFrame | None = None, counted: DataFrame | None = None) -> fi.Result:
    """The full calculation; ``md`` or ``counted`` (the tallies), and ``random`` may be given if they are at hand."""
    o, (q, v, _) = system.options, system.weight()
    frames = system.considered()
    if md is None and strategy == "cells":
        counted = settled(tallies(system), "tallies") if counted is None else counted
        counts, groups = ta.counts(counted, frames), ta.group_counts(counted, frames, system.autocorrelation)
    else:
        md = settled(minimum_distances(system, strategy), "pairs") if md is None else md
        own = hi.weighted(md, frames)
        counts, groups = hi.counts(own, o.binstep), hi.group_counts(own, o.binstep, system.groups, system.autocorrelation)
    if coordination_number_only:
        bins = settled(fi.coordination_bins(counts, o, system.n_solute, system.n_solvent, q, v), "bins")
        rows = fi.group_rows(groups, None, system.n_solute, 1, q, None)
    else:
        if random is None:
            random = settled(random_distances(system, md, strategy), "random")
        other = hi.weighted(random, frames)
        bins = settled(fi.mddf_bins(counts, hi.counts(other, o.binstep, "_random"), o, system.n_solute, system.n_solvent, system.solvent_nmols, q, v), "bins")
        if not o.silent and bins.where("md_count > 0 and md_count_random = 0").limit(1).count():
            warnings.warn("some bins have counts but no random ones, so their distribution is 0: more random samples may help", stacklevel=2)
        fix = bins.where("bin = 1").select((F.col("density_solvent_bulk") / F.col("density_solvent")).alias("fix"))
        rows = fi.group_rows(groups, hi.group_counts(other, o.binstep, system.groups, system.autocorrelation, "n_random"), system.n_solute, o.n_random_samples, q, fix)
    return fi.Result(bins, settled(rows, "groups"), o, system.n_solute, system.n_solvent, system.autocorrelation, files=system.files, weights=(1.0,), extra={"q": q, "v": v, "names": system.groups})


def coordination_number(system: System, **options) -> fi.Result:
    if "coordination_number_only" in options:
        raise ValueError("coordination_number_only is set by this function")
    return mddf(system, coordination_number_only=True, **options)
