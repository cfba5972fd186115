"""Results as one JSON document of nested vectors: the layout of other implementations, current and of versions 2.0.0 to 2.17.1.

Per-bin quantities are vectors, group counts are vectors of vectors (group, bin) by side.  Documents up to 2.17.1 have no random
counts of groups; the schema follows from the version, which stands before the first comma.  Spark parses the document and turns the
vectors into rows by their positions; the driver sees the scalars only.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.finalise import Result
from ..operators.selection import AtomSelection
from ..options import VERSION, Options
from ..sources import files

LAST_LEGACY = "2.17.1"
VECTORS = (
    "d", "md_count", "md_count_random", "coordination_number", "coordination_number_random", "mddf", "kb",
    "rdf_count", "rdf_count_random", "sum_rdf_count", "sum_rdf_count_random", "rdf", "kb_rdf",
)
SIDES = ("solute", "solvent")
_OPTIONS = {
    "firstframe": "int", "lastframe": "int", "stride": "int", "irefatom": "int", "n_random_samples": "int", "binstep": "double", "dbulk": "double", "cutoff": "double",
    "usecutoff": "boolean", "lcell": "int", "GC": "boolean", "GC_threshold": "double", "seed": "int", "StableRNG": "boolean", "nthreads": "int", "silent": "boolean",
}
_FILE = f"filename: string, options: struct<{', '.join(f'{k}: {v}' for k, v in _OPTIONS.items())}>, irefatom: int, lastframe_read: int, nframes_read: int, frame_weights: array<double>"
_SELECTION = "nmols: double, natomspermol: int, indices: array<int>, custom_groups: boolean, group_atom_indices: array<array<int>>, group_names: array<string>"


def schema(legacy: bool) -> str:
    """The document's columns."""
    groups = [f"{s}_group_count{r}" for s in SIDES for r in (("",) if legacy else ("", "_random"))]
    parts = ["Version string, nbins int, dbulk double, cutoff double, autocorrelation boolean"]
    parts += [f"{v} array<double>" for v in VECTORS] + [f"{s} struct<{_SELECTION}>" for s in SIDES] + [f"{g} array<array<double>>" for g in groups]
    parts.append("density struct<solute: double, solvent: double, solvent_bulk: double>, volume struct<total: double, bulk: double, domain: double, shell: array<double>>")
    return ", ".join([*parts, f"files array<struct<{_FILE}>>, weights array<double>"])


def version_of(path: str) -> tuple[str, bool]:
    """The version, which is sought before the first comma (none: 1.0.0), and whether the document has this layout."""
    with files.opened(path) as f:
        head = f.read(4096).decode(errors="replace")
    found = re.search(r'"Version"\s*:\s*"([^"]*)"', head.split(",", 1)[0])
    return (found[1] if found else "1.0.0"), bool(re.search(r'"nbins"\s*:', head))


def load(spark: SparkSession, path: str) -> Result:
    """The result of a document in this layout."""
    from .persistence import _parts, check_version

    version, _ = version_of(path)
    check_version(version)
    legacy = _parts("2.0.0") < _parts(version) <= _parts(LAST_LEGACY)
    if legacy:
        warnings.warn(f"{path} is of version {version}, which has no random counts of groups: they are 0", stacklevel=3)
    # Version 2.0.0 itself is read by what it has.
    document = spark.read.schema(schema(legacy)).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    small = [c for c in document.columns if c not in VECTORS and "group_count" not in c and c not in ("volume", "nbins")]
    lengths = [F.size(v).alias(f"n_{v}") for v in VECTORS]
    volume = [F.col(f"volume.{v}").alias(f"volume_{v}") for v in ("total", "bulk", "domain")]
    rows = document.select("nbins", *small, *volume, *lengths, F.size("volume.shell").alias("n_shell"), F.size("solute_group_count").alias("n_groups")).take(2)
    row = rows[0].asDict(recursive=True) if len(rows) == 1 else {}
    nbins = row.get("nbins")
    if not nbins or any(row[f"n_{v}"] != nbins for v in (*VECTORS, "shell")) or not row["files"] or not row["solute"] or not row["solvent"] or row["density"] is None or row["n_groups"] < 0:
        raise ValueError(f"{path} is not a saved result")
    zipped = F.arrays_zip(*VECTORS, F.col("volume.shell").alias("shell_volume"))
    bins = document.select(F.posexplode(zipped).alias("k", "v")).select((F.col("k") + 1).alias("bin"), "v.*")
    scalars = {f"volume_{v}": row[f"volume_{v}"] for v in ("total", "domain", "bulk")} | {f"density_{k}": v for k, v in row["density"].items()}
    bins = bins.withColumns({k: F.lit(float(v)) for k, v in scalars.items()})
    parts = [groups_of(document, s, legacy) for s in SIDES]
    file = row["files"][0]
    options = {k: v for k, v in file["options"].items() if v is not None}
    if not options.get("usecutoff"):
        options.pop("cutoff", None)
        options.pop("usecutoff", None)
    weights = [w for f in row["files"] for w in (f["frame_weights"] or [])]
    return Result(
        bins,
        parts[0].unionByName(parts[1]),
        Options(**options),
        row["solute"]["nmols"],
        row["solvent"]["nmols"],
        row["autocorrelation"],
        _side(row["solute"]),
        _side(row["solvent"]),
        tuple((f["filename"], f["nframes_read"]) for f in row["files"]),
        tuple(row["weights"]),
        version,
        {"q": sum(weights) or float(sum(f["nframes_read"] or 0 for f in row["files"]))},
    )


def groups_of(document: DataFrame, side: str, legacy: bool) -> DataFrame:
    """side, group_id, bin, n, n_random: the positions in the nested vectors count from 1."""

    def each(column: str, name: str) -> DataFrame:
        rows = document.select(F.posexplode(column).alias("g", "own")).select((F.col("g") + 1).alias("group_id"), F.posexplode("own").alias("b", name))
        return rows.select("group_id", (F.col("b") + 1).alias("bin"), name)

    out = each(f"{side}_group_count", "n")
    if legacy:
        out = out.withColumn("n_random", F.lit(0.0))
    else:
        out = out.join(each(f"{side}_group_count_random", "n_random"), ["group_id", "bin"], "left").fillna(0.0, ["n_random"])
    return out.select(F.lit(side).alias("side"), "group_id", "bin", "n", "n_random")


def _side(s: dict) -> AtomSelection | None:
    if not s["indices"]:
        return None
    groups = tuple(map(tuple, s["group_atom_indices"] or ())) if s["custom_groups"] else ()
    return AtomSelection(tuple(s["indices"]), int(s["nmols"]), s["natomspermol"], tuple(s["group_names"] or ()), groups)


def save(path: str, result: Result, version: str = VERSION) -> str:
    """Write a document in this layout (to be read by versions up to the given one, without random counts up to 2.17.1)."""
    from .persistence import _parts

    legacy = _parts("2.0.0") < _parts(version) <= _parts(LAST_LEGACY)
    spark, o, nbins = result.bins.sparkSession, result.options, result.nbins
    ordered = F.array_sort(F.collect_list(F.struct("bin", *VECTORS, "shell_volume")))
    scalars = ("volume_total", "volume_bulk", "volume_domain", "density_solute", "density_solvent", "density_solvent_bulk")
    row = result.bins.agg(ordered.alias("b"), *(F.first(c).alias(c) for c in scalars))
    vector = lambda v: F.transform("b", lambda x: x[v])
    every = F.sequence(F.lit(1), F.lit(nbins))
    dense = lambda keys, values, empty: F.transform(keys, lambda k: F.coalesce(F.try_element_at(values, k), empty))
    zeros = F.transform(every, lambda _: F.lit(0.0))
    columns = {"Version": F.lit(version), "nbins": F.lit(nbins), "dbulk": F.lit(float(o.dbulk)), "cutoff": F.lit(float(o.cutoff))}
    columns |= {v: vector(v) for v in VECTORS[:7]} | {"autocorrelation": F.lit(bool(result.autocorrelation))}
    columns |= {side: _selection(getattr(result, side), n) for side, n in zip(SIDES, (result.n_solute, result.n_solvent), strict=True)}
    counted = {}
    for side in SIDES:
        own = result.groups.where(F.col("side") == side)
        for name, c in (("", "n"), ("_random", "n_random"))[: 1 if legacy else 2]:
            by_bin = own.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.col(c).alias("x")))).alias("m"))
            vectors = by_bin.select("group_id", dense(every, F.col("m"), F.lit(0.0)).alias("v"))
            table = vectors.agg(F.map_from_entries(F.collect_list(F.struct("group_id", "v"))).alias("g"), F.max("group_id").alias("most"))
            keys = F.when(F.col("most").isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.coalesce("most", F.lit(1))))
            key = f"{side}_group_count{name}"
            row = row.crossJoin(table.select(dense(keys, F.col("g"), zeros).alias(key)))  # one row each
            counted[key] = F.col(key)
    columns |= {k: counted[k] for k in sorted(counted, key=lambda k: k.endswith("_random"))}
    columns |= {v: vector(v) for v in VECTORS[7:]}
    columns["density"] = F.struct(*(F.col(f"density_{k}").alias(k) for k in ("solute", "solvent", "solvent_bulk")))
    columns["volume"] = F.struct(*(F.col(f"volume_{k}").alias(k) for k in ("total", "bulk", "domain")), vector("shell_volume").alias("shell"))
    options = F.struct(*(F.lit(getattr(o, k)).cast(kind).alias(k) for k, kind in _OPTIONS.items()))
    file = lambda name, n: F.struct(F.lit(name).alias("filename"), options.alias("options"), F.lit(o.irefatom).alias("irefatom"), F.lit(n).cast("int").alias("lastframe_read"), F.lit(n).cast("int").alias("nframes_read"), F.array().cast("array<double>").alias("frame_weights"))
    columns["files"] = F.array(*(file(name, n) for name, n in result.files))
    columns["weights"] = F.array(*(F.lit(float(w)) for w in result.weights))
    text = row.select(F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())), {"ignoreNullFields": "false"}).alias("text"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document in batch.column(0).to_pylist():
                files.put(path, document.encode())
            yield batch.select([]).append_column("n", pa.array([1] * len(batch), pa.int64()))

    if text.mapInArrow(put, "n long").count() != 1:
        raise ValueError("the result has no bins")
    spark.catalog.refreshByPath(path)
    return path


def _selection(s: AtomSelection | None, n: float):
    """nmols counts molecules; without a selection there are no atoms."""
    ints = lambda own: F.array(*(F.lit(int(i)) for i in own)).cast("array<int>")
    groups = F.array(*(ints(g) for g in s.group_atom_indices)) if s and s.custom_groups else F.array().cast("array<array<int>>")
    names = F.array(*(F.lit(x) for x in s.group_names)) if s and s.group_names else F.array().cast("array<string>")
    fields = (F.lit(int(n) if n == int(n) else float(n)), F.lit(s.natomspermol if s else 0), ints(s.indices if s else ()), F.lit(bool(s and s.custom_groups)), groups, names)
    return F.struct(*(f.alias(k.split(":")[0]) for f, k in zip(fields, _SELECTION.split(", "), strict=True)))
