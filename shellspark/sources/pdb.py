"""PDB files: structures, and trajectories of frames that end in END or ENDMDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..plans.staging import settled
from .scan import Scan


def _cut(a: int, b: int):
    return F.trim(F.substring("value", a, b - a + 1))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The file's lines with their frame and order; large files are read in blocks, a folder's files in the order of their names.

    The frame of a line is one more than the terminators before it: those of earlier blocks, summed over the few blocks, and those
    before it in its own block.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    raw = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("line"))
    end = F.rtrim("value").isin("END", "ENDMDL")
    atom = F.substring("value", 1, 6).isin("ATOM  ", "HETATM")
    raw = raw.withColumns({"end": end.cast("int"), "is_atom": atom, "kind": F.substring("value", 1, 6)})
    # Two terminators in a row (ENDMDL, then END at the end of the file) close one frame: those without atoms before them count for nothing.
    in_block = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = raw.withColumn("ends_before", F.coalesce(F.sum("end").over(in_block), F.lit(0)))
    blocks = raw.groupBy("file", "block").agg(F.sum("end").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")  # a row for each block
    rows = rows.join(blocks.withColumn("earlier", earlier).select("file", "block", "earlier"), ["file", "block"])
    rows = rows.withColumn("part", F.col("ends_before") + F.col("earlier"))
    full = rows.where("is_atom").select("part").distinct()
    numbered = full.withColumn("frame", F.row_number().over(Window.orderBy("part")).cast("int"))  # a row for each frame
    return rows.join(numbered, "part").select("frame", "file", "block", "line", "kind", "is_atom", "value")


def _atoms(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("file", "block", "line")
    rows = rows.where("is_atom").withColumn("atom_index", F.row_number().over(order).cast("int"))
    number = lambda a, b: F.expr(f"try_cast(trim(substring(value, {a}, {b - a + 1})) as double)")
    whole = lambda a, b: F.expr(f"try_cast(trim(substring(value, {a}, {b - a + 1})) as int)")
    texts = {"name": _cut(13, 16), "resname": _cut(18, 21), "chain": _cut(22, 22), "resnum": whole(23, 26)}
    numbers = {"x": number(31, 38), "y": number(39, 46), "z": number(47, 54), "occup": number(55, 60), "beta": number(61, 66)}
    columns = {"index_pdb": whole(7, 11), **texts, **numbers, "segname": _cut(73, 76), "element": _cut(77, 78)}
    return rows.select(*by, "atom_index", *(c.alias(name) for name, c in columns.items()))


def read_pdb(spark: SparkSession, path: str, selection: str | None = None) -> DataFrame:
    """All atoms of a file, numbered through, with residue and model numbers.

    Atoms and residues are counted in each model, and on from the models before it: no task sees more than a model.
    """
    from ..operators.selection import select

    own = _atoms(lines(spark, path).withColumn("model", F.col("frame")), ("model",))
    order = Window.partitionBy("model").orderBy("atom_index")
    key = F.concat_ws("\x00", "chain", "segname", "resnum", "resname")
    before = F.lag(key).over(order)
    new = (before.isNull() | (before != key)).cast("int")
    own = own.withColumn("new", new).withColumn("residue", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sizes = own.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("residues"))  # a row for each model
    earlier = Window.orderBy("model").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("model", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "residues")))
    shifted = {"atom_index": F.col("atom_index") + F.col("n_before"), "residue": F.col("residue") + F.col("residues_before")}
    out = own.join(sizes, "model").withColumns({k: c.cast("int") for k, c in shifted.items()}).drop("new", "n_before", "residues_before")
    return out if selection is None else select(out, selection)


def scan(spark: SparkSession, path: str) -> Scan:
    """The text is parsed and numbered once; what is read from then on is the table of that."""
    coords, cells = trajectory(spark, path)
    return Scan.of(settled(coords, "pdb"), settled(cells, "cells"))


def trajectory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """coords (frame, atom_index, x, y, z) and cells (frame, m, volume); a frame without CRYST1 has the cell before it."""
    rows = lines(spark, path)
    coords = _atoms(rows, ("frame",)).select("frame", "atom_index", "x", "y", "z")
    part = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    cryst = rows.where("kind = 'CRYST1'").select("frame", *(part[k].cast("double").alias(f"p{k}") for k in range(1, 7)))
    own = cryst.groupBy("frame").agg(F.first(geo.cell_matrix(*(F.col(f"p{k}") for k in range(1, 7)))).alias("m"))
    frames = coords.select("frame").distinct().join(own, "frame", "left")
    carried = F.last("m", ignorenulls=True).over(Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = frames.withColumn("m", carried).withColumn("volume", geo.volume(F.col("m")))
    return coords, cells
