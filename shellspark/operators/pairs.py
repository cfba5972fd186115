"""The periodic range join and the least distance of each pair of molecules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..plans.staging import settled


KEPT = ("mol", "idx", "atype", "atom")


def _checked(m: Column, size: tuple, cutoff: float) -> Column:
    """The cell; an error where the cutoff exceeds half of its least height, beyond which an atom can have two images in range."""
    least = F.least(*size)
    text = F.concat(F.lit(f"the cutoff, {cutoff}, exceeds half of the least height of a cell, "), least.cast("string"))
    return F.when(least < 2 * cutoff * (1 - 1e-12), F.raise_error(text).cast("array<double>")).otherwise(m)


def _wrapped(m: Column, ortho: bool, names: list[str]) -> list[Column]:
    """Coordinates along the cell vectors, from 0 to below 1."""
    x = [F.col(c) for c in names]
    f = [e / m[k] for e, k in zip(x, (0, 4, 8), strict=True)] if ortho else geo.fractions(m, *x)
    return [e - F.floor(e) for e in f]


def _placed(m: Column, ortho: bool, f: list[Column]) -> list[Column]:
    if ortho:
        return [e * m[k] for e, k in zip(f, (0, 4, 8), strict=True)]
    return [f[0] * m[t] + f[1] * m[3 + t] + f[2] * m[6 + t] for t in range(3)]


def cells(frames: DataFrame, cutoff: float, ortho: bool, lcell: int = 1) -> DataFrame:
    """frame, m (reduced), the heights hx to hz and the numbers nx to nz of cells no smaller than cutoff / lcell along them."""
    cell, m = frames.select("frame", "m"), F.col("m")
    size = [m[0], m[4], m[8]] if ortho else list(geo.heights(m))
    cell = cell if ortho else geo.reduced(cell)
    counts = [F.greatest(F.lit(1), F.floor(x * lcell / cutoff)).cast("int") for x in size]
    own = {f"h{axis}": x for axis, x in zip("xyz", size, strict=True)} | {f"n{axis}": k for axis, k in zip("xyz", counts, strict=True)}
    # Written once, a row for each frame: plans stay small, and a cutoff that does not fit is found at once.
    return settled(cell.select("frame", _checked(m, size, cutoff).alias("m"), *(c.alias(k) for k, c in own.items())), "cells")


def place(f: Column, k: Column) -> Column:
    """The cell of a coordinate along a cell vector."""
    return F.least(F.floor(f * k), k - 1).cast("int")


def copies(atoms: DataFrame, reach: float, ortho: bool, around: int) -> DataFrame:
    """Atoms sx, sy and sz, with the columns of ``cells``, once for each cell that a sphere around them can touch, ``around`` cells to each side.

    cx to cz: the cell; tx to tz: the whole turns to take from the coordinates along the cell vectors; fx to fz: what then is left.
    """
    m = F.col("m")
    x = [F.col(f"s{axis}") for axis in "xyz"]
    f = [e / m[k] for e, k in zip(x, (0, 4, 8), strict=True)] if ortho else list(geo.fractions(m, *x))
    # As a generator's row, the fractions are computed once and not put into each expression that uses them.
    left = atoms.select("*", F.inline(F.array(F.struct(*(e.alias(f"f{axis}") for axis, e in zip("xyz", f, strict=True))))))
    left = left.withColumns({f"t{axis}": F.floor(f"f{axis}") for axis in "xyz"} | {f"f{axis}": F.col(f"f{axis}") - F.floor(f"f{axis}") for axis in "xyz"})
    for axis in "xyz":
        f, k, height, turn = (F.col(f"{c}{axis}") for c in "fnht")
        at = F.explode(F.sequence(place(f, k) - around, place(f, k) + around))
        # How far the atom is from the cell along this axis, and the turns around the cell that lead there.
        own = F.col(f"at{axis}")
        gap = height * F.greatest(F.lit(0.0), own / k - f, f - (own + 1) / k)
        left = left.withColumn(f"at{axis}", at).where(gap <= reach * (1 + 1e-9)).withColumns({f"g{axis}": gap, f"c{axis}": F.pmod(own, k), f"t{axis}": turn + F.floor(own / k), f"f{axis}": f - F.floor(own / k)})
    gaps = [F.col(f"g{axis}") for axis in "xyz"]
    within = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) if ortho else F.greatest(*(g * g for g in gaps))
    return left.where(within <= reach * reach * (1 + 1e-9))


def range_join(
    solute: DataFrame,
    solvent: DataFrame,
    frames: DataFrame,
    cutoff: float,
    ortho: bool = True,
    keys: tuple[str, ...] = ("frame",),
    strategy: str = "cells",
    lcell: int = 1,
    within: float | None = None,
    few: bool = False,
) -> DataFrame:
    """Solute and solvent atoms within ``cutoff`` under the minimum image, with d2; equal keys only.

    ``cells``: atoms are put into cells no smaller than cutoff / lcell; the solute's atoms go to the neighbouring cells that a sphere around
    them can reach, each copy moved by the cell vectors that this takes, and an equi-join on keys and cell finds the pairs.  So distances
    are plain differences, the cell vectors are not in the shuffle, the work follows the number of neighbours, and hot frames are split
    by cell.  ``brute`` joins on the keys alone and rounds the difference's fractions.

    Both are exact: within half of the least height no atom has two images in range, and the one in range has fractions of at most
    a half.  Skewed cells are first replaced by reduced ones of the same lattice, whose heights are larger; a cutoff beyond half
    of the least height is an error.  ``within``: the greatest distance that is kept, if it is not the cutoff.
    """
    cell, m = cells(frames, cutoff, ortho, lcell), F.col("m")
    n, size = ([F.col(f"{c}{axis}") for axis in "xyz"] for c in "nh")
    more = [f"{c}{axis}" for c in "nh" for axis in "xyz"]
    # What is joined is named anew, so no column of the keys or of the other side clashes.
    left = solute.select(*keys, *(f"s{c}" for c in (*KEPT, *"xyz"))).join(cell, "frame")
    right = solvent.select(*keys, *(f"v{c}" for c in (*KEPT, *"xyz"))).join(cell, "frame")
    if strategy == "brute":
        pairs = left.join(right.drop("m", *more), list(keys))
        image = geo.nearest(m, ortho, *(F.col(f"v{c}") - F.col(f"s{c}") for c in "xyz"), within=True)
        out = pairs.withColumn("d2", image["d2"])
    elif strategy == "cells":
        left = copies(left, cutoff, ortho, lcell)
        columns = [*keys, *(f"s{c}" for c in KEPT)]
        right = right.withColumns({f"f{axis}": f for axis, f in zip("xyz", _wrapped(m, ortho, ["vx", "vy", "vz"]), strict=True)})
        own = [F.col(f"f{axis}") for axis in "xyz"]
        at = [place(f, k).alias(f"c{axis}") for axis, f, k in zip("xyz", own, n, strict=True)]
        moved = lambda s: [e.alias(f"{s}{axis}") for axis, e in zip("xyz", _placed(m, ortho, [F.col(f"f{axis}") for axis in "xyz"]), strict=True)]
        if ortho:  # the difference of the plain coordinates first, then whole edges, so that equal distances are equal bit by bit
            turns = lambda s, t: [(t(axis) * F.col(f"h{axis}")).alias(f"{s}{axis}") for axis in "xyz"]
            left = left.select(*columns, "cx", "cy", "cz", "sx", "sy", "sz", *turns("p", lambda axis: F.col(f"t{axis}")))
            right = right.select(*keys, *(f"v{c}" for c in KEPT), *at, "vx", "vy", "vz", *turns("q", lambda axis: F.floor(F.col(f"v{axis}") / F.col(f"h{axis}"))))
            d = [(F.col(f"v{axis}") - F.col(f"s{axis}")) - (F.col(f"q{axis}") - F.col(f"p{axis}")) for axis in "xyz"]
        else:
            left = left.select(*columns, "cx", "cy", "cz", *moved("s"))
            right = right.select(*keys, *(f"v{c}" for c in KEPT), *at, *moved("v"))
            d = [F.col(f"v{axis}") - F.col(f"s{axis}") for axis in "xyz"]
        left = settled(left, "copies") if few else left
        out = left.join(right, [*keys, "cx", "cy", "cz"]).withColumn("d2", d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    most = cutoff if within is None else within
    return out.where(F.col("d2") <= most * most).select(*keys, *(f"{s}{c}" for s in "sv" for c in KEPT), "d2")


def min_distance(pairs: DataFrame, irefatom: int, keys: tuple[str, ...] = ("frame",), autocorrelation: bool = False) -> DataFrame:
    """One row per pair of molecules: d, the atoms i and j (and their types), and d_ref to the solvent's reference atom (null: none in range).

    Equal distances are settled by the atoms' numbers.
    """
    if autocorrelation:
        pairs = pairs.where("sidx <> vidx")
    d = F.sqrt("d2")
    least = F.min(F.struct(d.alias("d"), F.col("satom").alias("i"), F.col("vatom").alias("j"), "satype", "vatype")).alias("p")
    ref = F.min(F.when(F.col("vatype") == irefatom, d)).alias("d_ref")
    out = pairs.groupBy(*keys, "sidx", "vidx").agg(F.first("smol").alias("smol"), F.first("vmol").alias("vmol"), least, ref)
    return out.select(*keys, "sidx", "vidx", "smol", "vmol", "p.*", "d_ref")
