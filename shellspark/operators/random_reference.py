"""The ideal-gas reference: bulk molecules put at random places around chosen solute molecules.

All random numbers are functions of (seed, frame, sample, slot), so results do not depend on partitions.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.rng import draw, uniform
from ..plans.staging import settled
from ..plans.system import System
from . import pairs as pr

#: Slots that are made together.
SPAN = 1 << 14


def _per_frame(atoms: DataFrame, idx: str) -> DataFrame:
    return atoms.groupBy("frame").agg(F.max(idx).alias("n"))


def reference_solutes(system: System) -> DataFrame:
    """frame, k and the solute molecule drawn, with replacement."""
    o = system.options
    n = _per_frame(system.solute, "sidx")
    rows = n.select("frame", "n", F.explode(F.sequence(F.lit(1), F.lit(o.n_random_samples))).alias("k"))
    return rows.select("frame", "k", draw(uniform(0, o.seed, F.col("frame"), "ref", F.col("k")), F.col("n")).alias("sidx"))


def bulk_molecules(system: System, md: DataFrame, refs: DataFrame) -> DataFrame:
    """frame, k, vidx, its number rn among the sample's bulk molecules, and their count nb.

    Bulk: beyond dbulk but in range, or, without a separate cutoff, not in range at all; if there are none, all molecules.
    """
    o = system.options
    own = refs.join(md.select("frame", "sidx", "vidx", "d"), ["frame", "sidx"])
    molecules = lambda frames: system.solvent.join(F.broadcast(frames), "frame", "left_semi").select("frame", "vidx").distinct()
    if o.usecutoff:
        bulk = own.where(F.col("d") > o.dbulk).select("frame", "k", "vidx")
    else:
        others = refs.join(molecules(refs.select("frame").distinct()), "frame")
        others = others.where("sidx <> vidx") if system.autocorrelation else others
        bulk = others.join(own.select("frame", "k", "vidx"), ["frame", "k", "vidx"], "left_anti").select("frame", "k", "vidx")
    empty = refs.join(bulk.select("frame", "k").distinct(), ["frame", "k"], "left_anti").select("frame", "k")
    rows = bulk.union(empty.join(molecules(empty.select("frame").distinct()), "frame").select("frame", "k", "vidx"))
    # A sample's molecules are those of one frame: bounded by the simulated system, not by the trajectory.
    w = Window.partitionBy("frame", "k")
    return rows.withColumn("rn", F.row_number().over(w.orderBy("vidx")).cast("bigint")).withColumn("nb", F.count(F.lit(1)).over(w))


def unwrapped(system: System) -> DataFrame:
    """Solvent atoms moved to the image nearest to their molecule's reference atom, relative to the molecule's mean: frame, vidx, vatype, vatom, ux, uy, uz."""
    ref = system.solvent.where(F.col("vatype") == system.irefatom).select("frame", "vidx", *(F.col(f"v{c}").alias(f"r{c}") for c in "xyz"))
    cells = system.frames.select("frame", "m")
    cells = cells if system.ortho else settled(geo.reduced(cells), "cells")
    rows = system.solvent.join(ref, ["frame", "vidx"]).join(cells, "frame")
    image = geo.nearest(F.col("m"), system.ortho, *(F.col(f"v{c}") - F.col(f"r{c}") for c in "xyz"))
    rows = rows.withColumn("u", image).select("frame", "vidx", "vmol", "vatype", "vatom", *(F.col(f"u.{c}").alias(f"u{c}") for c in "xyz"))
    mean = rows.groupBy("frame", "vidx").agg(*(F.avg(f"u{c}").alias(f"m{c}") for c in "xyz"))
    return rows.join(mean, ["frame", "vidx"]).select("frame", "vidx", "vmol", "vatype", "vatom", *((F.col(f"u{c}") - F.col(f"m{c}")).alias(f"u{c}") for c in "xyz"))


def surroundings(system: System, refs: DataFrame, extent: float) -> DataFrame:
    """frame, k, the cell m and its heights h, the fractions a of an atom of the sample's solute molecule, and how far from it the centres
    of copies can be that have an atom within the search radius; ``extent``: the greatest distance of a copy's atom from its centre.
    """
    atoms = system.solute.join(F.broadcast(refs), ["frame", "sidx"])
    one = atoms.groupBy("frame", "k").agg(F.min(F.struct("satom", "sx", "sy", "sz")).alias("one"))
    rows = atoms.join(one, ["frame", "k"]).join(system.frames.select("frame", "m"), "frame")
    # Any image bounds the least distance to the other atoms from above.
    away = geo.nearest(F.col("m"), system.ortho, *(F.col(f"s{c}") - F.col(f"one.s{c}") for c in "xyz"), within=True)
    own = rows.groupBy("frame", "k").agg(F.first("m").alias("m"), F.first("one").alias("one"), F.max(F.sqrt(away["d2"])).alias("far"))
    m = F.col("m")
    f = geo.fractions(m, *(F.col(f"one.s{c}") for c in "xyz"))
    h = [m[k] for k in (0, 4, 8)] if system.ortho else geo.heights(m)
    return own.select("frame", "k", F.array(*h).alias("h"), F.array(*f).alias("a"), (F.lit(system.options.radius + extent) + F.col("far")).alias("reach"))


def slots(system: System, bulk: DataFrame, around: DataFrame | None = None) -> DataFrame:
    """One row for each solvent molecule of a sample: the bulk molecule it copies, its centre in fractions of the cell and its angles.

    ``around``: only those of which an atom can be in range, by ``surroundings``.
    """
    o = system.options
    count = bulk.groupBy("frame", "k").agg(F.max("nb").alias("nb"))
    n = _per_frame(system.solvent, "vidx")
    # A sample's slots are dealt over tasks in spans.
    spans = count.join(n, "frame").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / SPAN))).alias("span"))
    spans = spans.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame", "k", "span")
    last = F.least(F.col("n").cast("bigint"), (F.col("span") + 1) * SPAN)
    rows = spans.select("frame", "k", "nb", F.explode(F.sequence(F.col("span") * SPAN + 1, last)).alias("slot"))
    u = lambda c, tag: uniform(c, o.seed, F.col("frame"), tag, F.col("k"), F.col("slot"))
    two_pi = F.lit(6.283185307179586)
    if around is not None:
        # As a generator's row, the fractions are drawn once and not put into each expression that uses them.
        rows = rows.select("*", F.inline(F.array(F.struct(*(u(c, "pick").alias(f"f{c}") for c in (1, 2, 3)))))).join(F.broadcast(around), ["frame", "k"])
        # No image is nearer than the distance between planes; where the vectors are at right angles, the three add up.
        gap = [F.col("h")[c - 1] * F.abs(f - F.round(f)) for c, f in ((c, F.col(f"f{c}") - F.col("a")[c - 1]) for c in (1, 2, 3))]
        least = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]) if system.ortho else F.greatest(*gap)
        rows = rows.where(least <= F.col("reach") * (1 + 1e-9) + 1e-6).select("frame", "k", "nb", "slot")
    drawn = rows.select("frame", "k", "slot", draw(u(0, "pick"), F.col("nb")).alias("rn"), *(u(c, "pick").alias(f"f{c}") for c in (1, 2, 3)), *((two_pi * u(c, "turn")).alias(a) for c, a in enumerate(("beta", "gamma", "theta"))))
    return drawn.join(bulk.select("frame", "k", "rn", "vidx"), ["frame", "k", "rn"])


def random_move(placed: DataFrame, local: DataFrame, frames: DataFrame) -> DataFrame:
    """Atoms of the copies, turned and put at their places: frame, k, slot, vidx (the slot), vatype, vatom, vx, vy, vz."""
    rows = placed.join(local, ["frame", "vidx"]).join(frames.select("frame", "m"), "frame")
    a = geo.euler(F.col("beta"), F.col("gamma"), F.col("theta"))
    u, m = [F.col(f"u{c}") for c in "xyz"], F.col("m")
    f = [F.col(f"f{c}") for c in (1, 2, 3)]
    at = [f[0] * m[t] + f[1] * m[3 + t] + f[2] * m[6 + t] for t in range(3)]
    turned = [a[t][0] * u[0] + a[t][1] * u[1] + a[t][2] * u[2] for t in range(3)]
    return rows.select("frame", "k", F.col("slot").alias("vidx"), F.col("slot").alias("vmol"), "vatype", "vatom", *((turned[t] + at[t]).alias(f"v{c}") for t, c in enumerate("xyz")))


def random_pairs(system: System, md: DataFrame, strategy: str = "cells") -> DataFrame:
    """Least distances of the copies to their sample's solute molecule: frame, k, sidx, vidx (the slot), d, i, j, d_ref."""
    refs = reference_solutes(system)
    bulk = settled(bulk_molecules(system, md, refs), "bulk")
    # The bulk molecules alone are copied, and of the copies those alone are made that can be near the solute molecule.
    local = settled(unwrapped(replace(system, solvent=system.solvent.join(bulk.select("frame", "vidx").distinct(), ["frame", "vidx"], "left_semi"))), "local")
    extent = local.agg(F.max(F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2))).first()[0] or 0.0
    placed = slots(system, bulk, settled(surroundings(system, refs, extent), "surroundings"))
    moved = random_move(placed, local, system.frames)
    solute = system.solute.join(refs, ["frame", "sidx"])
    near = pr.range_join(solute, moved, system.frames, system.options.radius, system.ortho, ("frame", "k"), strategy, system.options.lcell)
    return pr.min_distance(near, system.irefatom, ("frame", "k"), system.autocorrelation)
