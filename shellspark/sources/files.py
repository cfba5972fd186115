"""Files that tasks read by offset and write whole: local or mounted paths, and what pyarrow's file systems reach."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _system(uri: str):
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def opened(uri: str):
    """The file for reading at any place."""
    system, path = _system(uri)
    return system.open_input_file(path)


def put(uri: str, *parts: bytes) -> None:
    """Write a file under a name of its own and give it its name when it is whole, so repeated tasks are harmless."""
    from pyarrow.fs import FileType

    system, path = _system(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(own, compression=None) as f:
        for part in parts:
            f.write(part)
    try:
        system.move(own, path)
    except OSError:
        if system.get_file_info(path).type != FileType.File:
            raise
        system.delete_file(own)


def parts(uri: str, suffix: str) -> list[str]:
    """The file, or a folder's files with the suffix, in the order of their names."""
    from pyarrow import fs

    system, path = _system(uri)
    if system.get_file_info(path).type != fs.FileType.Directory:
        return [uri]
    found = [x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.lower().endswith(suffix)]
    if not found:
        raise ValueError(f"{uri} has no trajectory files")
    return [f"{uri.rstrip('/')}/{os.path.basename(x)}" for x in sorted(found)]


def listed(spark: SparkSession, path: str, suffix: str) -> list[tuple[str, int]]:
    """Name and length of a file, or of a folder's files with the suffix, in the order of their names."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length")
    name = F.lower("path")
    kept = rows.where(name.endswith(suffix)) if suffix and not path.lower().endswith(suffix) else rows
    found = sorted((r.path, r.length) for r in kept.collect())
    if not found:
        raise ValueError(f"{path} has no trajectory files")
    return found


def ranges(spark: SparkSession, files: list[tuple[str, int]], size: int) -> DataFrame:
    """number (of the file), uri, length, start and end: the files cut into ranges of ``size`` bytes, a task for each."""
    rows = spark.createDataFrame([(k, uri, n) for k, (uri, n) in enumerate(files)], "number int, uri string, length long")
    cut = rows.where("length > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    cut = cut.withColumn("end", F.least(F.col("length"), F.col("start") + size))
    tasks = sum(-(-n // size) for _, n in files)
    return cut.repartition(max(1, min(tasks, 10_000)), "number", "start")


def numbered(found: DataFrame) -> DataFrame:
    """``found`` (number, start, place in the range, ...) with ``frame`` in place of the three: frames count on over ranges and files."""
    from pyspark.sql import Window

    each = found.groupBy("number", "start").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("number", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("before", before).drop("n")
    return found.join(each, ["number", "start"]).withColumn("frame", (F.col("before") + F.col("place") + 1).cast("int")).drop("number", "start", "place", "before")


def spread(index: DataFrame, spark: SparkSession, frame_bytes: float, frames: int, task_bytes: int = 32 << 20) -> DataFrame:
    """The rows of an index dealt to tasks that read about ``task_bytes`` each, and to all cores at least."""
    tasks = max(spark.sparkContext.defaultParallelism, int(frame_bytes * frames / task_bytes))
    return index.repartition(max(1, min(frames, tasks)), "frame")
