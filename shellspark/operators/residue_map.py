"""Contributions by residue: residue_pos, resnum, label, bin, d, value; arithmetic, slices, extrema."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import VERSION
from ..plans.staging import settled
from . import contours
from . import derived as de
from .finalise import Result
from .selection import ONE_LETTER, AtomSelection, Group


def labels(resname, resnum, one_letter: bool = True):
    """Residue labels such as A31."""
    code = F.create_map(*(F.lit(x) for item in ONE_LETTER.items() for x in item))
    return F.concat(F.coalesce(code[resname], resname) if one_letter else resname, resnum.cast("string"))


def bin_slice(bins: DataFrame, dmin: float, dmax: float) -> tuple[int, int]:
    """First bin beyond dmin to first bin beyond dmax, both included."""
    r = bins.agg(F.min(F.when(F.col("d") > dmin, F.col("bin"))).alias("a"), F.min(F.when(F.col("d") > dmax, F.col("bin"))).alias("b"), F.max("bin").alias("n")).first()
    return r.a or 1, r.b or r.n


@dataclass
class ResidueContributions:
    table: DataFrame
    version: str = VERSION

    @classmethod
    def make(cls, result: Result, atoms: DataFrame, dmin: float = 1.5, dmax: float = 3.5, type: str = "mddf") -> ResidueContributions:  # noqa: A002
        """atoms: residue, resnum, resname and atom_index of solute atoms; all residues in one aggregation."""
        if isinstance(atoms, (Group, AtomSelection)):
            raise TypeError("a residue map is made from a table of atoms")
        side = result.solute
        if side is not None and side.custom_groups:
            raise ValueError("a residue map needs the contributions of all atoms, not custom groups")
        if not atoms.limit(1).count():
            raise ValueError("there are no atoms")
        own = result.groups.where("side = 'solute'")
        if side is not None:
            types = side.table(atoms.sparkSession).select("atom_index", F.col("atype").alias("group_id"))
            atoms = atoms.join(types, "atom_index")
            share = float(side.nmols)
        else:
            atoms, share = atoms.withColumn("group_id", F.col("atom_index")), 1.0
        residues = atoms.select("residue", "resnum", "resname", "group_id")
        summed = residues.join(own, "group_id").groupBy("residue", "bin").agg((F.sum("n") / share).alias("n"), (F.sum("n_random") / share).alias("n_random"))
        names = residues.groupBy("residue").agg(F.first("resnum").alias("resnum"), F.first("resname").alias("resname"))
        names = names.withColumn("place", F.row_number().over(Window.orderBy("residue")))  # one row per residue of the solute
        missing = names.select("residue").join(summed.select("residue").distinct(), "residue", "left_anti").select("residue", F.lit(1).alias("bin"), F.lit(0.0).alias("n"), F.lit(0.0).alias("n_random"))
        values = de.as_type(summed.unionByName(missing), result.bins, type, ("residue",))
        a, b = bin_slice(result.bins, dmin, dmax)
        rows = values.where(F.col("bin").between(a, b)).join(names, "residue")
        columns = [F.col("place").alias("residue_pos"), "resnum", labels(F.col("resname"), F.col("resnum")).alias("label"), "bin", "d", "value"]
        # Residues times distances: written once, as arithmetic, slices and comparisons read it again and again.
        return cls(settled(rows.select(*columns), "residues"), result.version)

    def _with(self, other: ResidueContributions, value) -> ResidueContributions:
        a, b = self.table, other.table.select("residue_pos", "bin", F.col("d").alias("d2"), F.col("label").alias("label2"), F.col("value").alias("value2"))
        both = a.join(b, ["residue_pos", "bin"], "full")
        bad = both.agg(F.max(F.when(F.col("d").isNull() | F.col("d2").isNull() | (F.abs(F.col("d") - F.col("d2")) > 1e-9), 1).otherwise(0)).alias("bad"), F.max(F.when(F.col("label") != F.col("label2"), 1).otherwise(0)).alias("labels")).first()
        if bad.bad:
            raise ValueError("the maps have different residues or distances")
        if bad.labels:
            warnings.warn("the labels of the maps differ", stacklevel=3)
        return replace(self, table=both.withColumn("value", value).select("residue_pos", "resnum", "label", "bin", "d", "value"))

    def __add__(self, other):
        return self._with(other, F.col("value") + F.col("value2"))

    def __sub__(self, other):
        return self._with(other, F.col("value") - F.col("value2"))

    def __mul__(self, other):
        if isinstance(other, ResidueContributions):
            return self._with(other, F.col("value") * F.col("value2"))
        return replace(self, table=self.table.withColumn("value", F.col("value") * float(other)))

    __rmul__ = __mul__

    def __truediv__(self, other):
        """Where the divisor is 0 the quotient is 0, with a warning."""
        if isinstance(other, ResidueContributions):
            if other.table.where("value = 0").limit(1).count():
                warnings.warn("the divisor has zeros, where the quotient is 0", stacklevel=2)
            return self._with(other, F.when(F.col("value2") != 0, F.col("value") / F.col("value2")).otherwise(0.0))
        return replace(self, table=self.table.withColumn("value", F.col("value") / float(other)))

    def __getitem__(self, which: int | slice) -> ResidueContributions:
        """Residues by position from 1; a slice has both ends, as in a range a to b by step."""
        if isinstance(which, int):
            which = slice(which, which, 1)
        a, b, step = which.start or 1, which.stop, which.step or 1
        keep = (F.col("residue_pos") >= a) & (F.pmod(F.col("residue_pos") - a, F.lit(step)) == 0)
        return replace(self, table=self.table.where(keep if b is None else keep & (F.col("residue_pos") <= b)))

    def __iter__(self):
        """The maps of the residues one by one; of a single residue its values by distance."""
        places = [r[0] for r in self.table.select("residue_pos").distinct().orderBy("residue_pos").collect()]
        if len(places) == 1:
            yield from self.values()
        else:
            yield from (self[k] for k in places)

    def values(self) -> list[float]:
        """The values of a single residue by distance."""
        rows = self.table.select("residue_pos", "bin", "value").orderBy("bin").collect()  # as many as bins
        if len({r.residue_pos for r in rows}) > 1:
            raise ValueError("the map has several residues; choose one, as in map[1]")
        return [r.value for r in rows]

    def __lt__(self, other):
        raise TypeError("maps have no order; use findmax() of a residue")

    def __len__(self) -> int:
        return self.table.select("residue_pos").distinct().count()

    def __eq__(self, other) -> bool:
        return isinstance(other, ResidueContributions) and not self.table.exceptAll(other.table).limit(1).count() and not other.table.exceptAll(self.table).limit(1).count()

    __hash__ = None

    def copy(self) -> ResidueContributions:
        return replace(self)

    def extrema(self) -> DataFrame:
        return self.table.agg(F.min("value").alias("least"), F.max("value").alias("largest"))

    def findmax(self) -> DataFrame:
        """residue_pos, the largest value and the first bin that has it."""
        best = self.table.groupBy("residue_pos").agg(F.max(F.struct("value", (-F.col("bin")).alias("b"))).alias("m"))
        return best.select("residue_pos", F.col("m.value").alias("value"), (-F.col("m.b")).alias("bin"))

    def plot_data(self, max_residues: int = 2000, max_ticks: int = 50) -> DataFrame:
        """The map thinned for plotting: at most so many residues, with a label on at most so many."""
        n = len(self)
        by, tick = max(1, -(-n // max_residues)), max(1, -(-n // max_ticks))
        rows = self.table.where(F.pmod(F.col("residue_pos") - 1, F.lit(by)) == 0)
        return rows.withColumn("tick", F.when(F.pmod(F.col("residue_pos") - 1, F.lit(tick)) == 0, F.col("label")))

    def contours(self, levels: list[float] | None = None, max_residues: int = 2000) -> DataFrame:
        """Isolines of the map: level, line, place, residue, d, closed (``contours.lines``)."""
        rows = self.plot_data(max_residues).drop("tick")
        return contours.lines(contours.segments(rows, contours.levels_of(rows) if levels is None else levels))

    def filled_contours(self, levels: list[float] | None = None, max_residues: int = 2000) -> DataFrame:
        """The map, thinned for plotting, with the band of each value between levels."""
        rows = self.plot_data(max_residues)
        return contours.bands(rows, contours.levels_of(rows) if levels is None else levels)

    def heatmap(self, width: int = 60) -> str:
        """The map as text: a line for each distance bin, darker for larger values."""
        rows = self.plot_data(width).orderBy("bin", "residue_pos").collect()
        top = max((abs(r.value) for r in rows), default=0) or 1
        lines: dict[float, str] = {}
        for r in rows:
            lines[r.d] = lines.get(r.d, "") + " .:-=+*#%@"[min(9, int(9 * abs(r.value) / top))]
        return "\n".join(f"{d:7.3f} |{x}|" for d, x in lines.items())

    def save(self, path: str) -> None:
        rows = [r.asDict() for r in self.table.orderBy("residue_pos", "bin").collect()]
        with open(path, "w") as f:
            json.dump({"Version": self.version, "residues": rows}, f)

    @classmethod
    def load(cls, spark, path: str) -> ResidueContributions:
        from ..sinks.persistence import read_json

        data = read_json(path)
        rows = [(r["residue_pos"], r["resnum"], r["label"], r["bin"], r["d"], r["value"]) for r in data["residues"]]
        return cls(spark.createDataFrame(rows, "residue_pos int, resnum int, label string, bin int, d double, value double"), data["Version"])
