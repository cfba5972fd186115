"""Counts without a table of pairs, against the pairs."""

from dataclasses import replace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shellspark import registry
from shellspark.operators import histograms as hi
from shellspark.operators import pairs as pr
from shellspark.operators import tallies as ta
from shellspark.plans import engine

TABLES = "/root/testdata/sf0.001"


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("kind", ["plain", "groups", "self", "skewed"])
def test_tallies_are_those_of_the_pairs(spark, kind):
    far = {"autocorrelation": True, "dbulk": 25.0, "cutoff": 29.0} if kind == "self" else {}  # there are few solutes
    s = registry.tables.system(spark, TABLES, weights="(1 + frame % 4) / 4", **far)
    if kind == "skewed":
        cell = F.array(*(F.lit(float(x)) for x in registry.registry_sql.SKEWED))
        s = replace(s, ortho=False, frames=s.frames.withColumn("m", cell))
    if kind == "groups":  # of the atoms some are in two groups, and some in none
        one = registry._groups(spark, TABLES, "custom").where("atom % 5 > 0")
        s = replace(s, groups=one.union(one.where("atom % 2 = 0").withColumn("group_id", F.lit(9))))
    md, frames, counted = hi.weighted(engine.minimum_distances(s), s.considered()), s.considered(), engine.tallies(s)
    own = ("bin", "md_count", "rdf_count")
    assert _rows(ta.counts(counted, frames), *own) == _rows(hi.counts(md, 0.1), *own) != []
    own = ("side", "group_id", "bin", "n")
    assert _rows(ta.group_counts(counted, frames, s.autocorrelation), *own) == _rows(hi.group_counts(md, 0.1, s.groups, s.autocorrelation), *own) != []


def test_molecules_that_are_cut_by_the_cell_and_far_from_it(spark):
    """Solvent atoms up to 30 Å from their reference atom, anywhere outside of the cell."""
    rng = np.random.default_rng(11)
    at = rng.normal(0, 60, (60, 3))
    solute = [(1, k, k, a + 1, 3 * k + a, *map(float, at[k] + rng.normal(0, 4, 3))) for k in range(30) for a in range(1 + k % 3)]
    solvent = [(1, k, k, a + 1, 3 * k + a, *map(float, at[k] + rng.normal(0, 12, 3))) for k in range(30, 60) for a in range(3)]
    columns = lambda s: f"frame int, {s}mol long, {s}idx long, {s}atype long, {s}atom long, {s}x double, {s}y double, {s}z double"
    s, v = spark.createDataFrame(solute, columns("s")), spark.createDataFrame(solvent, columns("v"))
    for ortho, m in ((True, [41, 0, 0, 0, 43, 0, 0, 0, 47]), (False, [41, 0, 0, 9, 43, 0, 5, -7, 47])):
        frames = spark.createDataFrame([(1, [float(x) for x in m], 1.0)], "frame int, m array<double>, w double")
        md = hi.weighted(pr.min_distance(pr.range_join(s, v, frames, 15.0, ortho), 2), frames)
        got = ta.counts(ta.tally(s, v, frames, 15.0, 0.5, 2, ortho), frames)
        own = ("bin", "md_count", "rdf_count")
        assert _rows(got, *own) == _rows(hi.counts(md, 0.5), *own) != []


def test_no_table_of_pairs_is_made_for_counts(spark):
    registry.forget()
    for name in ("mddf", "contrib_group", "group_counts_self", "bulk_molecules", "coordination_number"):
        registry.queries()[name](spark, TABLES).collect()
    assert not [k for k in registry._MEMO if "md" in k]
    some = registry._near(spark, TABLES)
    assert some.select("frame", "sidx").distinct().count() <= 40  # two solute molecules a frame


@pytest.mark.parametrize("query", ["min_distance", "ref_atom_distance", "mddf_self"])
def test_all_pairs_are_kept_nowhere(spark, monkeypatch, query):
    """The pairs are quadratic in the atoms of a frame: their rows go to the result and to no table, and only atoms are shuffled."""
    registry.forget()
    names, settled = [], registry.settled
    monkeypatch.setattr(registry, "settled", lambda df, name="stage": names.append(name) or settled(df, name))
    rows = registry.queries()[query](spark, TABLES)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "pairs" not in names and "Aggregate" not in plan and "Join" not in plan.split("MapGroups")[0]
    found = duckdb.connect()
    for name in ("lineitem", "orders"):
        found.execute(f"CREATE VIEW {name} AS FROM '{TABLES}/{name}.parquet'")
    assert sorted(map(tuple, rows.collect())) == sorted(found.execute(registry.oracle_sql()[query]).fetchall())


@pytest.mark.parametrize("kind", ["plain", "self", "skewed"])
def test_streamed_pairs_are_those_of_the_join(spark, kind):
    far = {"autocorrelation": True, "dbulk": 25.0, "cutoff": 29.0} if kind == "self" else {}
    s = registry.tables.system(spark, TABLES, **far)
    if kind == "skewed":
        cell = F.array(*(F.lit(float(x)) for x in registry.registry_sql.SKEWED))
        s = replace(s, ortho=False, frames=s.frames.withColumn("m", cell))
    # Of some molecules an atom is missing, and of some the reference atom.
    s = replace(s, solute=s.solute.where("satom % 7 > 0"), solvent=s.solvent.where("vatom % 5 > 0"))
    own = ("frame", "smol", "vmol", "i", "j", F.round("d", 9), F.coalesce(F.round("d_ref", 9), F.lit(-1.0)))
    assert _rows(engine.least_pairs(s), *own) == _rows(engine.minimum_distances(s), *own) != []


@pytest.mark.parametrize("classes", [1, 3])
def test_single_precision_decides_only_what_it_can(classes):
    """Coordinates in hundredths of an Å have many distances at the bins' edges and many equal ones: counts are those of exact distances."""
    rng, tables = np.random.default_rng(3), []
    for n, s, p, first in ((90, "s", "p", 0), (200, "v", "q", 1000)):
        at = np.round(rng.random((n, 1, 3)) * 14 + rng.integers(-20, 21, (n, 3, 3)) / 20, 2).reshape(-1, 3)
        mol, rank = np.repeat(np.arange(first, first + n), 3), np.tile([1, 2, 3], n)
        on = (rng.random(3 * n) > 0.1) | (rank == 1)
        at, mol, rank = at[on], mol[on], rank[on]
        turn = 60.0 * rng.integers(-1, 2, n)[mol - first]
        of = {f"{s}idx": mol, f"{s}atom": 3 * mol + rank, "isref": rank == 1, f"{s}class": (mol % classes * 3 + rank).astype(str), "frame": np.ones(len(mol), np.int32)}
        tables.append(pa.table(of | {s + a: at[:, k] + turn for k, a in enumerate("xyz")} | {p + a: turn for a in "xyz"}))
    met = ta._Met(*tables, "sidx", "vidx")
    codes = tuple(np.unique(t[c].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1] for t, c in zip(tables, ("sclass", "vclass"), strict=True))
    counts, ref_counts, ssig, vsig = ta._single(met, codes, 10.0, 0.1, 103, False)
    best, which, ref = met.least(np.arange(len(met.smol)), np.arange(len(met.vmol)), 10.0, False)
    bin_of = lambda d: np.maximum(1, np.ceil(d / 0.1)).astype(int)
    m, n = np.nonzero(best < np.inf)
    expected = np.zeros((103, 9), np.int64)
    np.add.at(expected, (bin_of(best[m, n]), which[m, n]), 1)
    assert (counts.sum(axis=(0, 1)).reshape(103, 9) == expected).all() and expected.sum() > 5000
    assert (ref_counts == np.bincount(bin_of(ref[ref < np.inf]), minlength=103)).all()
    s, v = codes[0][met.sall[which[m, n] // 3, m]], codes[1][met.vall[which[m, n] % 3, n]]
    for axes, sig, own in (((1, 2, 4), ssig, s), ((0, 2, 3), vsig, v)):
        by = counts.sum(axis=axes)
        assert {c: k for c in set(own.tolist()) for k in [by.T[sig == c].sum()]} == dict(zip(*np.unique(own, return_counts=True), strict=True))


def test_weights_of_frames_make_no_atoms(spark, monkeypatch):
    """The atoms are made once for a query, however many systems it looks at."""
    registry.forget()
    made, atoms = [], registry.tables.atoms
    monkeypatch.setattr(registry.tables, "atoms", lambda *a, **k: made.append(a) or atoms(*a, **k))
    assert registry.queries()["histogram"](spark, TABLES).count() > 0 and len(made) == 1
