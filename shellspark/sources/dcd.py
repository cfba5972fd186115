"""DCD trajectories with unit cells, read by a Python data source in ranges of frames.

A file is a header of three records and frames of four: the cell (six doubles: A, gamma, B, beta, alpha, C) and x, y and z (floats).
All frames have one size, so a frame is found by its offset, and the frame count follows from the file's size; a file that ends
within a frame is an error.  A folder of files is one trajectory in the order of their names.

The first and last frame, the stride and the last atom are options of the source, so tasks seek to the chosen frames and to the first part of
each record, and nothing else is read.  The cells are a source of their own that reads 56 bytes a frame.  Filters of a query are not
pushed: Spark keeps what a Python source has been given with the table, so a second query over one table would see the first one's.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geometry as geo
from . import files
from .scan import Scan

SCHEMAS = {
    "coords": "frame int, atom_index int, x double, y double, z double",
    "cells": "frame int, a double, gamma double, b double, beta double, alpha double, c double",
}
CELL = 56  # bytes of the cell's record


@dataclass(frozen=True)
class Layout:
    order: str
    first: int
    size: int
    natoms: int
    frames: int


def layout(path: str) -> Layout:
    with files.opened(path) as f:
        head = f.read(4)
        order = "<" if head == struct.pack("<i", 84) else ">" if head == struct.pack(">i", 84) else ""
        if not order:
            raise ValueError(f"{path} is not a DCD file")
        f.seek(0)
        records = []
        for _ in range(3):
            (n,) = struct.unpack(order + "i", f.read(4))
            records.append(f.read(n))
            if f.read(4) != struct.pack(order + "i", n):
                raise ValueError(f"{path}: a header record is broken")
        first = f.tell()
        (natoms,) = struct.unpack(order + "i", records[2][:4])
        mark = f.read(4)
        if mark and (len(mark) < 4 or struct.unpack(order + "i", mark)[0] != 48):
            raise ValueError(f"{path} has no unit cells")
        f.seek(0, 2)
        size = CELL + 3 * (8 + 4 * natoms)
        frames, rest = divmod(f.tell() - first, size)
        if rest:
            raise ValueError(f"{path} ends within frame {frames + 1}: {rest} of {size} bytes")
        return Layout(order, first, size, natoms, frames)


@dataclass
class Frames(InputPartition):
    """Numbers of frames, from 1."""

    numbers: list[int]


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block, self.what = options["path"], int(options.get("frames_per_task", 64)), options.get("what", "coords")
        self.most = int(options.get("lastatom", 0))
        self.first, self.last, self.stride = (int(options.get(k, v)) for k, v in (("first", 1), ("last", -1), ("stride", 1)))
        self.parts = [(uri, layout(uri)) for uri in files.parts(self.path, ".dcd")]
        if len({at.natoms for _, at in self.parts}) != 1:
            raise ValueError(f"the files of {self.path} differ in their numbers of atoms")
        self.ends = list(accumulate(at.frames for _, at in self.parts))

    def chosen(self) -> range:
        last = self.ends[-1] if self.last < 0 else min(self.last, self.ends[-1])
        return range(max(1, self.first), last + 1, self.stride)

    def partitions(self):
        own = self.chosen()
        return [Frames(list(own[k : k + self.block])) for k in range(0, len(own), self.block)] or [Frames([])]

    def read(self, partition):
        names = [x.split()[0] for x in SCHEMAS[self.what].split(", ")]
        for part, own in groupby(partition.numbers, lambda k: bisect_left(self.ends, k)):
            uri, at = self.parts[part]
            with files.opened(uri) as f:
                for k in own:
                    start = at.first + (k - 1 - (self.ends[part] - at.frames)) * at.size
                    columns = self.cell(f, at, start, k) if self.what == "cells" else self.atoms(f, at, start, k)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names)

    @staticmethod
    def cell(f, at: Layout, start: int, k: int) -> list[np.ndarray]:
        f.seek(start)
        return [np.array([k], np.int32), *(np.array([float(v)]) for v in np.frombuffer(f.read(CELL), at.order + "f8", 6, 4))]

    def atoms(self, f, at: Layout, start: int, k: int) -> list[np.ndarray]:
        most, xyz = min(self.most or at.natoms, at.natoms), []
        for axis in range(3):
            f.seek(start + CELL + axis * (8 + 4 * at.natoms) + 4)
            xyz.append(np.frombuffer(f.read(4 * most), at.order + "f4").astype(np.float64))
        return [np.full(most, k, np.int32), np.arange(1, most + 1, dtype=np.int32), *xyz]


class DCDSource(DataSource):
    """spark.read.format("dcd").load(path); options: what (coords or cells), first, last (-1: to the end), stride, lastatom, frames_per_task."""

    @classmethod
    def name(cls):
        return "dcd"

    def schema(self):
        return SCHEMAS[self.options.get("what", "coords")]

    def reader(self, schema):
        return Reader(self.options)


def scan(spark: SparkSession, path: str) -> Scan:
    spark.dataSource.register(DCDSource)
    source = lambda **own: spark.read.format("dcd").options(**own).load(path)
    angles = geo.dcd_angles(*(F.col(c) for c in ("alpha", "beta", "gamma")))
    m = geo.cell_matrix(F.col("a"), F.col("b"), F.col("c"), *angles)
    cells = source(what="cells").select("frame", m.alias("m")).withColumn("volume", geo.volume(F.col("m")))

    def read(first: int, last: int, stride: int, lastatom: int) -> DataFrame:
        return source(first=first, last=last, stride=stride, lastatom=lastatom)

    return Scan(cells, read)


def trajectory(spark: SparkSession, path: str, lastatom: int = 0) -> tuple[DataFrame, DataFrame]:
    """coords (frame, atom_index, x, y, z) and cells (frame, m, volume)."""
    own = scan(spark, path)
    return own.coords(lastatom=lastatom), own.cells


def write_parts(coords: DataFrame, cells: DataFrame, path: str, frames_per_file: int = 64) -> None:
    """Write frames as a folder of files, each by one task; cells: frame and the six numbers a, gamma, b, beta, alpha, c."""
    span = F.floor((F.col("frame") - 1) / frames_per_file).cast("int").alias("span")
    six = ("a", "gamma", "b", "beta", "alpha", "c")

    def of(key, own: pa.Table, box: pa.Table) -> pa.Table:
        own = own.sort_by([("frame", "ascending"), ("atom_index", "ascending")])
        frame, x = own["frame"].to_numpy(), np.stack([own[c].to_numpy() for c in "xyz"], axis=1)
        cell = {r["frame"]: [r[c] for c in six] for r in box.to_pylist()}
        at = np.flatnonzero(np.diff(frame, prepend=-1))
        write(f"{path}/part-{key[0].as_py():010d}.dcd", [(cell[int(frame[a])], part) for a, part in zip(at, np.split(x, at[1:]), strict=True)])
        return pa.table({"n": pa.array([len(at)], pa.int64())})

    left = coords.select(span, "frame", "atom_index", "x", "y", "z").groupBy("span")
    left.cogroup(cells.select(span, "frame", *six).groupBy("span")).applyInArrow(of, "n long").collect()  # a number for each file


def write(path: str, frames: list[tuple[list[float], np.ndarray]]) -> None:
    """Write a file: for each frame the six cell numbers in their order and an array (atoms, 3)."""
    record = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    natoms = len(frames[0][1])
    head = record(b"CORD" + struct.pack("<8i", len(frames), 1, 1, len(frames), 0, 0, 0, 0) + struct.pack("<f", 1.0) + struct.pack("<11i", 1, *[0] * 9, 24))
    parts = [head, record(struct.pack("<i", 1) + b" " * 80), record(struct.pack("<i", natoms))]
    for cell, x in frames:
        parts.append(record(struct.pack("<6d", *cell)))
        parts += [record(np.asarray(x[:, t], "<f4").tobytes()) for t in range(3)]
    files.put(path, *parts)
