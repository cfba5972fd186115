"""Queries of the analytics engine by key, over trajectories made of the relational tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import registry_sql
from .functions import geometry as geo
from .functions import rng
from .functions import scalars as sc
from .operators import contours
from .operators import derived as de
from .operators import finalise as fi
from .operators import grid as gd
from .operators import histograms as hi
from .operators import pairs as pr
from .operators import random_reference as rr
from .operators import residue_map as rm
from .operators import tallies as ta
from .operators.selection import AtomSelection, SoluteGroup, SolventGroup, TableSelection, molecule_index, predicate
from .plans import engine
from .plans.staging import settled, shared_dir
from .plans.system import System
from .sources import tables
from .sources.scan import Scan
from .sources.trajectory import Trajectory

WEIGHTS = "(1 + frame % 4) / 4"
RESIDUES = 7
_MEMO: dict[tuple, object] = {}
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _memo(spark: SparkSession, key: tuple, make: Callable):
    """A value made once for a session and a folder; the pairs of molecules are what most queries share."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def forget() -> None:
    """Drop all that queries share."""
    _MEMO.clear()


def _atoms(spark, d) -> DataFrame:
    return _memo(spark, ("atoms", d), lambda: settled(tables.atoms(spark, d), "atoms"))


def _system(spark, d, **kind) -> System:
    return _memo(spark, ("system", d, str(kind)), lambda: tables.system(spark, d, every=_atoms(spark, d), **kind))


def _md(spark, d, **kind) -> DataFrame:
    """All pairs of molecules, as rows that are kept nowhere."""
    return engine.least_pairs(_system(spark, d, **kind))


def _near(spark, d) -> DataFrame:
    """The pairs of the random reference's molecules alone."""
    return _memo(spark, ("near", d), lambda: settled(engine.reference_distances(_system(spark, d)), "pairs"))


def _random(spark, d) -> DataFrame:
    return _memo(spark, ("random", d), lambda: settled(engine.random_distances(_system(spark, d), _near(spark, d)), "random"))


def _tallies(spark, d, groups: str = "", **kind) -> DataFrame:
    """All pairs of molecules, counted; a few rows for each frame and bin."""

    def make():
        s = _system(spark, d, **kind)
        return settled(engine.tallies(replace(s, groups=_groups(spark, d, groups)) if groups else s), "tallies")

    return _memo(spark, ("tallies", d, groups, str(kind)), make)


def _result(spark, d, groups: str = "") -> fi.Result:
    """The full result; groups: by atom type, custom (the order's priority) or residue."""

    def make():
        s = _system(spark, d)
        if groups:
            s = replace(s, groups=_groups(spark, d, groups))
        return engine.mddf(s, counted=_tallies(spark, d, groups), random=_random(spark, d))

    return _memo(spark, ("result", d, groups), make)


def _groups(spark, d, kind: str) -> DataFrame:
    side = F.when(F.col("mol") % 97 < 3, "solute").otherwise("solvent").alias("side")
    atoms = _atoms(spark, d)
    if kind == "residue":
        return atoms.select(side, (1 + F.col("mol") % RESIDUES).cast("int").alias("group_id"), F.lit("").alias("group_name"), "atom")
    return atoms.select(side, F.substring("priority", 1, 1).cast("int").alias("group_id"), F.col("priority").alias("group_name"), "atom")


def _out(df: DataFrame) -> DataFrame:
    """Numbers as the oracle has them: bigint, or double rounded to six places."""
    kinds = dict(df.dtypes)
    cast = lambda c: F.col(c).cast("bigint") if kinds[c] in ("int", "smallint", "tinyint") else F.round(c, 6) + F.lit(0.0) if kinds[c] == "double" else F.col(c)
    return df.select(*(cast(c).alias(c) for c in df.columns))


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
        return _out(f(spark, sf_dir))

    run.__name__ = f.__name__
    _QUERIES[f.__name__.removeprefix("q_")] = run
    return run


def _labelled(spark, d) -> DataFrame:
    """The atoms as a structure: names by atom type, residue names and numbers by molecule."""
    names = F.array(*map(F.lit, registry_sql.ATOM_NAMES))
    residues = F.array(*map(F.lit, registry_sql.RESIDUE_NAMES))
    mol = F.col("mol")
    return tables.atoms(spark, d).select(F.col("atom").alias("atom_index"), F.element_at(names, F.col("atype").cast("int")).alias("name"), F.element_at(residues, (mol % len(registry_sql.RESIDUE_NAMES) + 1).cast("int")).alias("resname"), (mol % 1000).alias("resnum"), F.substring(F.lit("ABCDE"), (mol % 5 + 1).cast("int"), F.lit(1)).alias("chain"), mol.alias("residue"), F.lit(1).alias("model"))


# Scans, projections and selections.


@query
def q_sel_name(spark, d):
    return _labelled(spark, d).where(predicate("name O H2")).select("atom_index", "name")


@query
def q_sel_resname(spark, d):
    return _labelled(spark, d).where(predicate("resname ALA WAT or acidic")).select("atom_index", "resname")


@query
def q_sel_range(spark, d):
    return _labelled(spark, d).where(predicate("resnum >= 100 and resnum < 250 and chain A B")).select("atom_index", "resnum", "chain")


@query
def q_sel_bool(spark, d):
    return _labelled(spark, d).where(predicate("not (water or nonpolar) and (name H1 or index <= 30000) and not resnum 7 8 9")).select("atom_index", "name", "resname", "resnum")


@query
def q_molecule_index(spark, d):
    return molecule_index(tables.atoms(spark, d).select(F.col("atom").alias("atom_index")), 3).select("atom_index", "pos", "mol", "atype")


def _selection(spark, d, side: str, custom: bool = False) -> TableSelection:
    """All atoms of a side, named by type; with custom groups by the orders' priorities."""
    rows = _groups(spark, d, "custom").where(F.col("side") == side).select("atom", "group_id", "group_name")
    return TableSelection.make(settled(rows, "selection"), 3, None if custom else registry_sql.ATOM_NAMES)


@query
def q_atom_group(spark, d):
    own = _selection(spark, d, "solute", custom=True).atom_group("2-HIGH")
    return own.select(F.lit(2).alias("group_id"), "atom")


@query
def q_atom_group_names(spark, d):
    own = _selection(spark, d, "solvent", custom=True).atom_group_names()
    return spark.createDataFrame([(k, name) for k, name in enumerate(own, 1)], "group_id int, group_name string")


@query
def q_pruned_scan(spark, d):
    return _system(spark, d).solute.where("frame between 3 and 5").select("frame", "satom", "sx", "sy", "sz")


@query
def q_frame_stride(spark, d):
    s = tables.system(spark, d, firstframe=2, lastframe=17, stride=5).pruned()
    return s.solvent.groupBy("frame").agg(F.count(F.lit(1)).alias("n_atoms"))


@query
def q_frame_weights(spark, d):
    s = tables.system(spark, d, weights=f"CASE WHEN frame = 4 THEN 0 ELSE {WEIGHTS} END")
    return s.considered().select("frame", "w")


@query
def q_irefatom(spark, d):
    every = tables.atoms(spark, d)
    first = _system(spark, d).solvent.where("frame = 1").select("vatom").orderBy("vatom").collect()
    solvent = AtomSelection.make([r.vatom for r in first], natomspermol=3)
    coords = every.select("frame", F.col("atom").alias("atom_index"), "x", "y", "z")
    own = Trajectory(spark, "tables", solvent, solvent, Scan.of(coords, tables.frames(spark, d)))
    return spark.createDataFrame([(solvent.indices[0] // 3, own.irefatom())], "vmol long, irefatom int")


# Cells.


def _some_cells(spark, d) -> DataFrame:
    """A cell for each vector of the embeddings."""
    cell = F.col("cell")
    edges = {c: F.lit(float(a)) + cell % b for a, b, c in ((30, 7, "a"), (40, 5, "b"), (50, 3, "c"))}
    angles = {c: F.lit(90.0) + (cell % 4) * s for s, c in ((0.0, "alpha"), (5.0, "beta"), (7.5, "gamma"))}
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") + 1).alias("cell")).withColumns(edges | angles)
    return rows.withColumn("m", geo.cell_matrix(*(F.col(c) for c in ("a", "b", "c", "alpha", "beta", "gamma"))))


@query
def q_cell_volume(spark, d):
    return _some_cells(spark, d).select("cell", geo.volume(F.col("m")).alias("volume"))


@query
def q_cell_kind(spark, d):
    return _some_cells(spark, d).select("cell", geo.is_orthorhombic(F.col("m")).cast("int").alias("is_ortho"))


@query
def q_avg_volume(spark, d):
    q, v, n = tables.system(spark, d, weights=WEIGHTS).weight()
    return spark.range(1).select(F.lit(q).alias("q"), F.lit(v).alias("volume"), F.lit(n).alias("n_frames"))


# Joins and minimum distances.


def _sides(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Solute and solvent atoms as the range joins need them, and the frames: they ask for no numbers of molecules, so no table of atoms is written."""
    return tables.side_atoms(spark, d, "s"), tables.side_atoms(spark, d, "v"), tables.frames(spark, d)


@query
def q_range_join(spark, d):
    near = pr.range_join(*_sides(spark, d), 4.0)
    return near.select("frame", "satom", "vatom", F.sqrt("d2").alias("d"))


@query
def q_range_join_lcell(spark, d):
    """The same pairs by smaller cells."""
    near = pr.range_join(*_sides(spark, d), 4.0, lcell=2)
    return near.select("frame", "satom", "vatom", F.sqrt("d2").alias("d"))


def _triclinic(solute: DataFrame, solvent: DataFrame, frames: DataFrame) -> DataFrame:
    cell = F.array(*(F.lit(float(x)) for x in registry_sql.SKEWED))
    near = pr.range_join(solute, solvent, frames.withColumn("m", cell), 4.0, ortho=False)
    return near.select("frame", "satom", "vatom", F.sqrt("d2").alias("d"))


@query
def q_range_join_triclinic(spark, d):
    return _triclinic(*_sides(spark, d))


@query
def q_min_distance(spark, d):
    return _md(spark, d).select("frame", "smol", "vmol", "d", "i", "j")


@query
def q_ref_atom_distance(spark, d):
    return _md(spark, d).where("d_ref is not null").select("frame", "smol", "vmol", "d_ref")


@query
def q_mddf_self(spark, d):
    return _md(spark, d, autocorrelation=True).select("frame", "smol", "vmol", "d", "i", "j")


# Histograms.


@query
def q_histogram(spark, d):
    return ta.histogram(_tallies(spark, d), _system(spark, d, weights=WEIGHTS).considered(), "n")


@query
def q_md_count(spark, d):
    return _result(spark, d).bins.select("bin", "md_count")


@query
def q_rdf_count(spark, d):
    return _result(spark, d).bins.select("bin", "rdf_count")


@query
def q_md_count_random(spark, d):
    return hi.counts(hi.weighted(_random(spark, d), _system(spark, d).frames), 0.1, "_random")


@query
def q_group_counts_atom(spark, d):
    return ta.group_counts(_tallies(spark, d), _system(spark, d).considered())


@query
def q_group_counts_custom(spark, d):
    return ta.group_counts(_tallies(spark, d, "custom"), _system(spark, d).considered())


@query
def q_group_counts_self(spark, d):
    return ta.group_counts(_tallies(spark, d, autocorrelation=True), _system(spark, d, autocorrelation=True).considered(), True)


@query
def q_coordination_number(spark, d):
    r = engine.coordination_number(_system(spark, d), counted=_tallies(spark, d))
    return r.bins.select("bin", "d", "md_count", "coordination_number", "sum_rdf_count")


# Random reference.


@query
def q_uniforms(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"))
    return rows.select("key", *(rng.uniform(c, 321, F.col("key"), "test").alias(f"u{c}") for c in range(4)))


@query
def q_ref_solutes(spark, d):
    return rr.reference_solutes(_system(spark, d))


def _bulk(spark, d) -> DataFrame:
    s = _system(spark, d)
    return rr.bulk_molecules(s, _near(spark, d), rr.reference_solutes(s))


@query
def q_bulk_molecules(spark, d):
    return _bulk(spark, d).select("frame", "k", "vidx", "rn", "nb")


@query
def q_bulk_resample(spark, d):
    return rr.slots(_system(spark, d), _bulk(spark, d)).select("frame", "k", "slot", "vidx")


@query
def q_unwrap(spark, d):
    return rr.unwrapped(_system(spark, d)).select("frame", "vatom", "ux", "uy", "uz")


def _moved(s: System, placed: DataFrame) -> DataFrame:
    return rr.random_move(placed, rr.unwrapped(s), s.frames).select("frame", "k", F.col("vidx").alias("slot"), "vatype", "vx", "vy", "vz")


@query
def q_random_move(spark, d):
    s = _system(spark, d)
    return _moved(s, rr.slots(s, _bulk(spark, d)))


@query
def q_eulermat(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("key"))
    a = geo.euler(*(rng.uniform(c, 7, F.col("key")) * 360.0 for c in range(3)), degrees=True)
    return rows.select("key", *(a[i][j].alias(f"a{i + 1}{j + 1}") for i in range(3) for j in range(3)))


# Scalars.


@query
def q_shell_volume(spark, d):
    return _result(spark, d).bins.select("bin", sc.shell_volume(F.col("bin"), 0.1).alias("shell_volume"))


@query
def q_shell_radius(spark, d):
    return _result(spark, d).bins.select("bin", sc.shell_radius(F.col("bin"), 0.1).alias("shell_radius"))


@query
def q_report_format(spark, d):
    x = (F.col("o_totalprice") - 150000.0) / (F.sqrt(F.lit(2.0)) * (1 + F.col("o_orderkey") % 1000))
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), x.alias("x"))
    return rows.select("key", sc.formatted(F.col("x")).alias("text"))


@query
def q_residue_labels(spark, d):
    rows = _labelled(spark, d).select("resname", "resnum").distinct()
    return rows.select("resname", "resnum", rm.labels(F.col("resname"), F.col("resnum")).alias("label"))


# Finalised results.


def _bins(*columns: str):
    def f(spark, d):
        return _result(spark, d).bins.select("bin", "d", *columns)

    return f


for _name, _columns in {"mddf": ("mddf", "coordination_number"), "rdf": ("rdf", "sum_rdf_count"), "kb": ("kb", "coordination_number_random"), "kb_rdf": ("kb_rdf", "sum_rdf_count_random"), "shell_volumes_mc": ("shell_volume",)}.items():
    _f = _bins(*_columns)
    _f.__name__ = f"q_{_name}"
    query(_f)


@query
def q_volumes(spark, d):
    return _result(spark, d).scalars().select("volume_total", "volume_domain", "volume_bulk")


@query
def q_densities(spark, d):
    return _result(spark, d).scalars().select("density_solvent", "density_solute", "density_solvent_bulk")


@query
def q_gr(spark, d):
    return de.gr(_result(spark, d).bins, 0.1)


@query
def q_tail_stats(spark, d):
    return _result(spark, d).tail()


@query
def q_overview(spark, d):
    return de.overview(_result(spark, d))


@query
def q_smooth(spark, d):
    return de.smooth(_result(spark, d).bins.select("bin", "d", "md_count"), "md_count", 4)


@query
def q_renormalize(spark, d):
    return de.renormalize(_result(spark, d), 5.0).bins.select("bin", "mddf", "kb", "rdf")


def _halves(spark, d) -> list[fi.Result]:
    """Results of two ranges of frames, the first with frame weights."""
    out = []
    for kind in ({"firstframe": 1, "lastframe": 8, "weights": WEIGHTS}, {"firstframe": 9, "lastframe": 20}):
        s = _system(spark, d, **kind)
        out.append(engine.coordination_number(s, counted=_tallies(spark, d, **kind)))
    return out


@query
def q_merge(spark, d):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        merged = de.merge(_halves(spark, d))
    return merged.bins.select("bin", "d", "md_count", "rdf_count", "coordination_number")


@query
def q_merge_weights(spark, d):
    by = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    files = sorted((r.o_orderpriority, r.n) for r in by.collect())  # a few priorities
    return spark.createDataFrame([(name, n, w) for (name, n), w in zip(files, de.merge_weights(files), strict=True)], "file string, n_frames int, weight double")


def _group_sum(spark, d, side: str, ids: list[int], groups: str = "", share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    r = _result(spark, d, groups)
    rows = r.groups.where((F.col("side") == side) & F.col("group_id").isin(ids))
    return rows.groupBy("bin").agg((F.sum("n") / share).alias("n"), (F.sum("n_random") / share).alias("n_random")), r.bins


@query
def q_contrib_mddf(spark, d):
    return de.as_type(*_group_sum(spark, d, "solute", [1, 2]), "mddf")


@query
def q_contrib_md_count(spark, d):
    return de.as_type(*_group_sum(spark, d, "solvent", [2]), "md_count")


@query
def q_contrib_cn(spark, d):
    return de.as_type(*_group_sum(spark, d, "solvent", [1, 3]), "coordination_number")


@query
def q_contrib_kbi(spark, d):
    return de.as_type(*_group_sum(spark, d, "solute", [3]), "kbi")


@query
def q_contrib_group(spark, d):
    own = replace(_result(spark, d, "custom"), solute=_selection(spark, d, "solute", custom=True))
    return de.contributions(own, SoluteGroup("2-HIGH"), "md_count")


@query
def q_contrib_atoms(spark, d):
    """The first two atoms of the first solvent molecule."""
    side = _selection(spark, d, "solvent")
    own = replace(_result(spark, d), solvent=side)
    return de.contributions(own, SolventGroup([r.atom for r in side.atoms.select("atom").orderBy("atom").limit(2).collect()]), "coordination_number")


@query
def q_contrib_names(spark, d):
    own = replace(_result(spark, d), solvent=_selection(spark, d, "solvent"))
    return de.contributions(own, SolventGroup(["H1", "H2"]), "mddf")


def _map(spark, d, kind: str) -> rm.ResidueContributions:
    residues = [(k, 100 + k, registry_sql.RESIDUE_NAMES[k - 1], k) for k in range(1, RESIDUES + 1)]
    atoms = spark.createDataFrame(residues, "residue int, resnum int, resname string, atom_index int")
    return rm.ResidueContributions.make(_result(spark, d, "residue"), atoms, 2.0, 7.0, kind)


@query
def q_residue_map(spark, d):
    return _map(spark, d, "md_count").table


@query
def q_rc_add(spark, d):
    return (_map(spark, d, "md_count") + _map(spark, d, "coordination_number")).table


@query
def q_rc_sub(spark, d):
    return (_map(spark, d, "coordination_number") - _map(spark, d, "md_count")).table


@query
def q_rc_mul(spark, d):
    return (_map(spark, d, "coordination_number") * _map(spark, d, "md_count")).table


@query
def q_rc_div(spark, d):
    return (_map(spark, d, "md_count") / _map(spark, d, "coordination_number")).table


@query
def q_rc_scale(spark, d):
    return (2 * _map(spark, d, "md_count") / 5).table


@query
def q_rc_slice(spark, d):
    return _map(spark, d, "coordination_number")[1:6:2].table


@query
def q_rc_findmax(spark, d):
    return _map(spark, d, "md_count").findmax()


@query
def q_rc_extrema(spark, d):
    return _map(spark, d, "coordination_number").extrema()


@query
def q_rc_plot_data(spark, d):
    return _map(spark, d, "coordination_number").plot_data(4, 2)


@query
def q_rc_contours(spark, d):
    """Segments of five isolines."""
    table = _map(spark, d, "coordination_number").table
    found = contours.segments(table, contours.levels_of(table, 5))
    return found.withColumn("level", F.dense_rank().over(Window.orderBy("level"))).select("level", "a", "b", "x0", "d0", "x1", "d1")


@query
def q_rc_contour_lines(spark, d):
    """Ends and points of each isoline."""
    table = _map(spark, d, "coordination_number").table
    found = contours.lines(contours.segments(table, contours.levels_of(table, 5)))
    by = found.groupBy("level", "line").agg(F.count(F.lit(1)).alias("points"), F.max(F.col("closed").cast("int")).alias("closed"))
    by = by.withColumn("level", F.dense_rank().over(Window.orderBy("level")))
    return by.groupBy("level").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("points") - 1).alias("segments"))


@query
def q_grid3d(spark, d):
    atoms = _system(spark, d).solute.where("frame = 1").select(F.col("satom").alias("atom"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"), F.col("satype").alias("group_id"))
    r = _result(spark, d)
    values = de.as_type(r.groups.where("side = 'solute'"), r.bins, "coordination_number", ("group_id",))
    profiles = atoms.select("atom", "group_id").join(values, "group_id").select("atom", "bin", "d", "value")
    return gd.grid3d(atoms, profiles, 1.5, 4.0, 2.0)


@query
def q_report_main(spark, d):
    from .sinks import report

    numbers = F.transform(F.split(F.trim(F.col("line")), " +"), lambda x: x.cast("double"))
    rows = report.main_table(_result(spark, d)).select("bin", numbers.alias("x"))
    return rows.select("bin", *(F.round(F.col("x")[k], 5).alias(c) for k, c in enumerate(report.COLUMNS)))


@query
def q_report_groups(spark, d):
    from .sinks.report import group_table

    return group_table(_result(spark, d), "solvent", "md_count")


def _through_a_document(spark, d, version: str):
    """The result with custom groups, written in the layout of nested vectors and read back."""
    import warnings

    from .sinks import nested, persistence

    path = nested.save(f"{shared_dir(spark, 'result')}/result.json", _result(spark, d, "custom"), version)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return persistence.load(spark, path)


@query
def q_load_groups(spark, d):
    return _through_a_document(spark, d, "2.18.0").groups.select("side", "group_id", "bin", "n", "n_random").where("n <> 0 or n_random <> 0")


@query
def q_load_legacy(spark, d):
    back = _through_a_document(spark, d, "2.17.0")
    values = de.as_type(back.groups.where("side = 'solute' and group_id = 2").select("bin", "n", "n_random"), back.bins, "md_count")
    return values.join(back.bins.select("bin", "mddf", "kb_rdf", "volume_bulk"), "bin")


# Files: written whole from the embeddings (a frame for each, 21 atoms), then scanned; coordinates in hundredths (PDB: thousandths) of an Å.


def _cloud(spark, d) -> tuple[DataFrame, DataFrame]:
    """frame, atom_index, x, y, z; and frame, a, b, c (the edges of its cell)."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") + 1).cast("int").alias("frame"), F.col("embedding").alias("e"), "label")
    each = rows.select("frame", "e", F.explode(F.sequence(F.lit(1), F.lit(21))).alias("atom_index"))
    at = lambda k: F.element_at("e", F.col("atom_index") * 3 - k).cast("double") * F.lit(10.0)
    coords = each.select("frame", "atom_index", at(2).alias("x"), at(1).alias("y"), at(0).alias("z"))
    edge = lambda e: (F.lit(30.0) + e).cast("double")
    return coords, rows.select("frame", edge(F.col("frame") % 7).alias("a"), edge(F.col("frame") % 5).alias("b"), edge(F.col("label")).alias("c"))


def _hundredths(coords: DataFrame, cells: DataFrame, parts: int = 100) -> DataFrame:
    whole = lambda c: F.round(F.col(c) * parts).cast("bigint").alias(c)
    return coords.join(cells.select("frame", "volume"), "frame").select("frame", "atom_index", *map(whole, "xyz"), F.round("volume", 2).alias("volume"))


@query
def q_xtc_scan(spark, d):
    from .sources import xtc

    path, (coords, cells) = shared_dir(spark, "xtc"), _cloud(spark, d)
    zero = F.lit(0.0)
    xtc.write(coords, cells.select("frame", F.array("a", zero, zero, zero, "b", zero, zero, zero, "c").alias("m")), path, frames_per_file=256)
    own = xtc.scan(spark, path, range_bytes=1 << 14)
    return _hundredths(own.coords(), own.cells)


@query
def q_xtc_stride(spark, d):
    """Every seventh frame from the third to the 150th, and the first five atoms."""
    from .sources import xtc

    path, (coords, cells) = shared_dir(spark, "xtc"), _cloud(spark, d)
    zero = F.lit(0.0)
    xtc.write(coords, cells.select("frame", F.array("a", zero, zero, zero, "b", zero, zero, zero, "c").alias("m")), path, frames_per_file=256)
    own = xtc.scan(spark, path, range_bytes=1 << 14)
    return _hundredths(own.coords(3, 150, 7, lastatom=5), own.cells)


def _dcd(spark, d):
    from .sources import dcd

    path, (coords, cells) = shared_dir(spark, "dcd"), _cloud(spark, d)
    right = [F.lit(90.0).alias(c) for c in ("alpha", "beta", "gamma")]
    dcd.write_parts(coords, cells.select("frame", "a", "b", "c", *right), path, frames_per_file=256)
    return dcd.scan(spark, path)


@query
def q_dcd_scan(spark, d):
    own = _dcd(spark, d)
    return _hundredths(own.coords(), own.cells)


@query
def q_dcd_stride(spark, d):
    """Every fifth frame from the second to the 140th, and the first four atoms."""
    own = _dcd(spark, d)
    return _hundredths(own.coords(2, 140, 5, lastatom=4), own.cells)


@query
def q_pdb_scan(spark, d):
    from .sources import pdb

    path, (coords, cells) = shared_dir(spark, "pdb"), _cloud(spark, d)
    box = F.format_string("CRYST1%9.3f%9.3f%9.3f  90.00  90.00  90.00 P 1           1", "a", "b", "c")
    atom = F.format_string("ATOM  %5d  O   WAT X%4d    %8.3f%8.3f%8.3f  0.00  0.00", "atom_index", F.col("atom_index") % 7, "x", "y", "z")
    lines = cells.select("frame", F.lit(0).alias("k"), box.alias("line")).union(coords.select("frame", "atom_index", atom)).union(cells.select("frame", F.lit(99), F.lit("END")))
    body = lines.groupBy("frame").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x.line), "\n").alias("value"))
    body.repartitionByRange(4, "frame").sortWithinPartitions("frame").select("value").write.text(path)
    own, boxes = pdb.trajectory(spark, path)
    return _hundredths(own, boxes, 1000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in registry_sql.all_sql().items() if k in _QUERIES}
