"""Saved results: one JSON document, or a folder of parquet tables; versions are checked on reading."""

from __future__ import annotations

import json
import re
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..operators.finalise import Result
from ..operators.selection import AtomSelection
from ..options import VERSION, Options
from . import nested

OLDEST = "2.0.0"
_GROUPS = "side string, group_id int, bin int, n double, n_random double"


def _parts(version: str) -> tuple[int, ...]:
    return tuple(int(x) for x in re.findall(r"\d+", version)[:3])


def check_version(version: str) -> None:
    if _parts(version) > _parts(VERSION):
        raise ValueError(f"the file was written by a newer version, {version}")
    if _parts(version) < _parts(OLDEST):
        raise ValueError(f"the file was written by a version that is too old, {version}")


def read_json(path: str) -> dict:
    """The document, if its version fits; a document without one has version 1.0.0."""
    with open(path) as f:
        text = f.read()
    m = re.search(r'"Version"\s*:\s*"([^"]*)"', text)
    check_version(m[1] if m else "1.0.0")
    try:
        return json.loads(text)
    except ValueError as e:
        raise ValueError(f"{path} is not a saved result") from e


def _document(result: Result) -> dict:
    """All of a result but its tables."""
    own = lambda s: None if s is None else asdict(s)
    options = {k: v for k, v in asdict(result.options).items() if k not in ("_", "bulk_range")}
    return {
        "Version": VERSION,
        "options": options,
        "n_solute": result.n_solute,
        "n_solvent": result.n_solvent,
        "autocorrelation": result.autocorrelation,
        "solute": own(result.solute),
        "solvent": own(result.solvent),
        "files": result.files,
        "weights": result.weights,
        "q": result.extra.get("q"),
    }


def _side(s: dict | None) -> AtomSelection | None:
    if s is None:
        return None
    names, groups = tuple(s["group_names"]), tuple(map(tuple, s["group_atom_indices"]))
    return AtomSelection(tuple(s["indices"]), s["nmols"], s["natomspermol"], names, groups)


def _result(data: dict, bins: DataFrame, groups: DataFrame) -> Result:
    options = dict(data["options"])
    if not options.get("usecutoff"):
        options.pop("cutoff", None)
        options.pop("usecutoff", None)
    return Result(
        bins,
        groups,
        Options(**options),
        data["n_solute"],
        data["n_solvent"],
        data["autocorrelation"],
        _side(data["solute"]),
        _side(data["solvent"]),
        tuple(map(tuple, data["files"])),
        tuple(data["weights"]),
        data["Version"],
        {"q": data.get("q")},
    )


def save(path: str, result: Result) -> str:
    """Write the result (its tables have as many rows as bins and groups) as JSON."""
    groups = result.groups.select("side", "group_id", "bin", "n", "n_random").orderBy("side", "group_id", "bin")
    tables = {
        "bin_columns": result.bins.columns,
        "bins": [list(r) for r in result.bins.orderBy("bin").collect()],
        "groups": [list(r) for r in groups.collect()],
    }
    with open(path, "w") as f:
        json.dump(_document(result) | tables, f)
    return path


def load(spark: SparkSession, path: str) -> Result:
    """Read a saved result, of this package or in the layout of nested vectors (``nested``), current or older."""
    if nested.version_of(path)[1]:
        return nested.load(spark, path)
    data = read_json(path)
    try:
        kinds = ", ".join(f"{c} {'int' if c == 'bin' else 'double'}" for c in data["bin_columns"])
        bins = spark.createDataFrame([tuple(r) for r in data["bins"]], kinds)
        groups = spark.createDataFrame([tuple(r) for r in data["groups"]], _GROUPS)
        return _result(data, bins, groups)
    except (KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"{path} is not a saved result") from e


def save_parquet(path: str, result: Result) -> None:
    """bins and groups as tables, and beside them the rest of the result as one document."""
    result.bins.write.parquet(f"{path}/bins")
    result.groups.write.parquet(f"{path}/groups")
    spark = result.bins.sparkSession
    spark.createDataFrame([(json.dumps(_document(result)),)], "document string").coalesce(1).write.parquet(f"{path}/document")


def load_parquet(spark: SparkSession, path: str) -> Result:
    """The result that save_parquet() has written."""
    data = json.loads(spark.read.parquet(f"{path}/document").first().document)
    check_version(data["Version"])
    return _result(data, spark.read.parquet(f"{path}/bins"), spark.read.parquet(f"{path}/groups"))
