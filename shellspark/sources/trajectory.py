"""Trajectories: a table of coordinates and one of cells, with two selections."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators.selection import AtomSelection
from ..options import Options
from ..plans.staging import settled
from ..plans.system import System
from . import dcd, pdb, xtc
from .scan import Scan


def _parquet(spark: SparkSession, path: str) -> Scan:
    """Coordinates by spans of frames: the frames of a choice imply spans, so other folders are not opened."""
    coords, cells = spark.read.parquet(f"{path}/coords"), spark.read.parquet(f"{path}/cells")
    if "span" not in coords.columns:
        return Scan.of(coords, cells)
    size = int(spark.read.parquet(f"{path}/layout").first().frames_per_file)

    def read(first: int, last: int, stride: int, lastatom: int) -> DataFrame:
        spans = F.col("span") >= (first - 1) // size
        own = coords.where(spans & (F.col("span") <= (last - 1) // size) if last >= 0 else spans)
        return Scan.of(own.drop("span"), cells).coords(first, last, stride, lastatom)

    return Scan(cells, read)


#: Readers by format: functions (spark, path) that return a Scan, or coords and cells.  Others can be registered under a name of their own.
FORMATS: dict[str, Callable] = {"pdb": pdb.scan, "dcd": dcd.scan, "xtc": xtc.scan, "parquet": _parquet}
_NAMES = {"PDBTraj": "pdb", "NamdDCD": "dcd", "XTC": "xtc"}


def register(name: str, reader: Callable) -> None:
    """Add a format: a function (spark, path) that returns a Scan, or coords and cells."""
    FORMATS[name.lower()] = reader


def write_parquet(coords: DataFrame, cells: DataFrame, path: str, frames_per_file: int = 64) -> None:
    """Store a trajectory by ranges of frames, so that frame filters prune files and row groups."""
    spans = F.floor((F.col("frame") - 1) / frames_per_file).cast("int")
    coords.withColumn("span", spans).repartition("span").sortWithinPartitions("frame", "atom_index").write.partitionBy("span").parquet(f"{path}/coords")
    cells.write.parquet(f"{path}/cells")
    coords.sparkSession.createDataFrame([(frames_per_file,)], "frames_per_file int").coalesce(1).write.parquet(f"{path}/layout")


@dataclass
class Trajectory:
    spark: SparkSession
    filename: str
    solute: AtomSelection
    solvent: AtomSelection
    scan: Scan
    format: str = ""

    @property
    def coords(self) -> DataFrame:
        return self.scan.coords()

    @property
    def cells(self) -> DataFrame:
        return self.scan.cells

    @classmethod
    def open(cls, spark: SparkSession, filename: str, solute: AtomSelection, solvent: AtomSelection | None = None, format: str | None = None) -> Trajectory:  # noqa: A002
        filename = os.path.expanduser(filename)
        kind = _NAMES.get(format, format) if format else os.path.splitext(filename)[1].lstrip(".") or "parquet"
        if kind.lower() not in FORMATS:
            raise ValueError(f"no reader for the format {kind!r}")
        scan = FORMATS[kind.lower()](spark, filename)
        return cls(spark, filename, solute, solvent or solute, scan if isinstance(scan, Scan) else Scan.of(*scan), kind.lower())

    @property
    def autocorrelation(self) -> bool:
        return self.solute.indices == self.solvent.indices

    def irefatom(self) -> int:
        """The atom of the first solvent molecule that is closest to its mean, in the first frame."""
        first = self.solvent.table(self.spark).where("mol = 1")
        rows = self.scan.coords(1, 1, lastatom=max(self.solvent.indices)).join(first, "atom_index").select("atype", "x", "y", "z").orderBy("atype").collect()
        mean = [sum(r[c] for r in rows) / len(rows) for c in "xyz"]
        return min(rows, key=lambda r: (sum((r[c] - m) ** 2 for c, m in zip("xyz", mean, strict=True)), r.atype)).atype

    def system(self, options: Options | None = None, frame_weights=None) -> System:
        o = options or Options()
        cells = settled(self.cells, "cells")  # a row for each frame
        info = cells.agg(F.count(F.lit(1)).alias("n"), F.min_by("m", "frame").alias("m"), F.sum(F.col("m").isNull().cast("int")).alias("none")).first()
        if not info.n:
            raise ValueError("the trajectory has no frames")
        if info.none:
            raise ValueError("a frame has no unit cell")
        last = info.n if o.lastframe < 0 else o.lastframe
        if last > info.n:
            raise ValueError(f"lastframe is {last}, but the trajectory has {info.n} frames")
        if o.irefatom > self.solvent.natomspermol:
            raise ValueError("irefatom is larger than the number of atoms of a solvent molecule")
        frames = cells.select("frame", "m", "volume")
        if frame_weights is None:
            frames = frames.withColumn("w", F.lit(1.0))
        else:
            weights = [float(w) for w in frame_weights]
            if len(weights) < last:
                raise ValueError("there must be a weight for each frame up to the last")
            own = self.spark.createDataFrame([(k, w) for k, w in enumerate(weights, 1)], "frame int, w double")
            frames = frames.join(own, "frame")
        read = lambda sel: self.scan.coords(o.firstframe, o.lastframe, o.stride, max(sel.indices))
        side = lambda sel, s: read(sel).join(sel.table(self.spark), "atom_index").select("frame", *(F.col(c).cast("bigint").alias(s + t) for c, t in (("mol", "mol"), ("mol", "idx"))), F.col("atype").alias(f"{s}atype"), F.col("atom_index").cast("bigint").alias(f"{s}atom"), *(F.col(c).alias(s + c) for c in "xyz"))
        groups = None
        if self.solute.custom_groups or self.solvent.custom_groups:
            parts = [sel.groups(self.spark).select(F.lit(name).alias("side"), "group_id", "group_name", F.col("atom_index").cast("bigint").alias("atom")) for name, sel in (("solute", self.solute), ("solvent", self.solvent))]
            groups = parts[0].unionByName(parts[1])
        iref = o.irefatom if o.irefatom > 0 else self.irefatom()
        ortho = bool(cells.orderBy("frame").limit(1).select(geo.is_orthorhombic(F.col("m"))).first()[0])
        n = len(range(o.firstframe, last + 1, o.stride))
        return System(side(self.solute, "s"), side(self.solvent, "v"), frames, self.solute.nmols, self.solvent.nmols, self.solute.natomspermol, self.solvent.natomspermol, o, iref, ortho, self.autocorrelation, groups, files=((self.filename, n),))

    def __str__(self) -> str:
        r = self.cells.agg(F.count(F.lit(1)).alias("n"), F.min_by("m", "frame").alias("m"), F.min_by("volume", "frame").alias("v")).first()
        cell = "none" if r.m is None else f"{' '.join(f'{x:g}' for x in r.m)} (volume {r.v:g} A^3)"
        parts = [f"Trajectory {self.filename}", f"format: {self.format or 'tables'}, {r.n} frame{'s' * (r.n != 1)}", f"first cell: {cell}", f"solute: {self.solute}", f"solvent: {self.solvent}"]
        return "\n  ".join(parts)
