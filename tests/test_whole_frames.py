"""Queries over all frames of the tables, against plain Python."""

import itertools

import numpy as np
import pytest

from shellspark import registry, registry_sql
from shellspark.functions import geometry as geo
from shellspark.operators import pairs as pr

TABLES = "/root/testdata/sf0.001"


def test_molecule_index_over_all_atoms(spark):
    atoms = sorted(r.atom for r in registry.tables.atoms(spark, TABLES).select("atom").collect())
    got = registry.queries()["molecule_index"](spark, TABLES)
    assert sorted(map(tuple, got.collect())) == [(a, k + 1, k // 3 + 1, k % 3 + 1) for k, a in enumerate(atoms)]


def test_triclinic_pairs_of_all_frames(spark):
    s = registry.tables.system(spark, TABLES)
    solute, solvent = s.solute.collect(), s.solvent.collect()
    m = np.array(registry_sql.SKEWED, float).reshape(3, 3)
    shifts = np.array(list(itertools.product(range(-3, 4), repeat=3))) @ m
    expected = {}
    for frame in range(1, 21):
        v = [r for r in solvent if r.frame == frame]
        at = np.array([(r.vx, r.vy, r.vz) for r in v])
        for r in (r for r in solute if r.frame == frame):
            d = np.sqrt((((at - (r.sx, r.sy, r.sz))[:, None] + shifts) ** 2).sum(2).min(1))
            expected |= {(frame, r.satom, v[k].vatom): d[k] for k in np.flatnonzero(d <= 4)}
    found = {(r.frame, r.satom, r.vatom): r.d for r in registry.queries()["range_join_triclinic"](spark, TABLES).collect()}
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(d, abs=2e-6) for k, d in expected.items())


def _points(spark, cells, n=60):
    """A frame for each cell, with solute and solvent atoms anywhere, also outside of the cell."""
    rng = np.random.default_rng(4)
    columns = lambda s: f"frame int, {s}mol long, {s}idx long, {s}atype long, {s}atom long, {s}x double, {s}y double, {s}z double"
    rows = lambda: [(f + 1, k, k, 1, k, *map(float, rng.normal(0, 20, 3))) for f in range(len(cells)) for k in range(1, n + 1)]
    a, b = rows(), rows()
    frames = spark.createDataFrame([(f + 1, [float(x) for x in m]) for f, m in enumerate(cells)], "frame int, m array<double>")
    return a, b, spark.createDataFrame(a, columns("s")), spark.createDataFrame(b, columns("v")), frames


#: The first two are one lattice; the third is that of a cube; the last is left-handed.
UNREDUCED = [(10, 0, 0, 25, 10, 0, 0, 0, 10), (10, 0, 0, 5, 10, 0, 0, 0, 10), (10, 0, 0, 10, 10, 0, -20, 10, 10), (10, 0, 0, 14, 10, 0, -17, 13, 10), (9, 2, -1, 31, 17, 4, -22, 3, -14)]


def test_images_in_cells_that_are_not_reduced(spark):
    """Against all images from -7 to 7 of each vector around the rounded one."""
    a, b, s, v, frames = _points(spark, UNREDUCED)
    least = [np.linalg.det(np.array(geo.reduced_cell(m)).reshape(3, 3)) / max(np.linalg.norm(np.cross(x, y)) for x, y in itertools.combinations(np.array(geo.reduced_cell(m)).reshape(3, 3), 2)) for m in UNREDUCED]
    assert all(np.linalg.det(np.array(geo.reduced_cell(m)).reshape(3, 3)) == pytest.approx(np.linalg.det(np.array(m, float).reshape(3, 3))) for m in UNREDUCED)
    cutoff = min(map(abs, least)) / 2 - 0.01
    assert cutoff > 3.5
    expected = {}
    for f, m in enumerate(UNREDUCED, 1):
        cell = np.array(m, float).reshape(3, 3)
        shifts = np.array(list(itertools.product(range(-7, 8), repeat=3))) @ cell
        for x in (x for x in a if x[0] == f):
            for y in (y for y in b if y[0] == f):
                apart = np.array(y[5:]) - x[5:]
                apart -= np.rint(apart @ np.linalg.inv(cell)) @ cell
                d = np.sqrt(((apart + shifts) ** 2).sum(1).min())
                if d <= cutoff:
                    expected[f, x[4], y[4]] = d
    assert len(expected) > 200
    for strategy, lcell in (("cells", 1), ("cells", 2), ("cells", 3), ("brute", 1)):
        rows = pr.range_join(s, v, frames, cutoff, ortho=False, strategy=strategy, lcell=lcell).collect()
        got = {(r.frame, r.satom, r.vatom): r.d2**0.5 for r in rows}
        assert len(got) == len(rows) and got == pytest.approx(expected, abs=1e-9), (strategy, lcell)


def test_a_cutoff_beyond_half_a_cell_is_refused(spark):
    _, _, s, v, frames = _points(spark, [(20, 0, 0, 0, 20, 0, 0, 0, 9)], 3)
    assert pr.range_join(s, v, frames, 4.5).count() >= 0
    for strategy in ("cells", "brute"):
        with pytest.raises(Exception, match="half of the least height"):
            pr.range_join(s, v, frames, 4.6, strategy=strategy).collect()


def test_smaller_cells_have_fewer_candidates(spark):
    """Equal pairs; and of the rows that meet in a cell, fewer are too far."""
    _, _, s, v, frames = _points(spark, [(60, 0, 0, 0, 60, 0, 0, 0, 60)] * 3, 400)
    found, met = [], []
    for lcell in (1, 2, 3):
        near = pr.range_join(s, v, frames, 8.0, lcell=lcell)
        found.append(sorted(map(tuple, near.select("frame", "satom", "vatom").collect())))
        execution = near._jdf.queryExecution()
        filters = [x for x in str(execution.optimizedPlan().toString()).splitlines() if "Join Inner" in x and "cx" in x]
        assert filters  # an equi-join on the cell
        every = pr.range_join(s, v, frames, 8.0, lcell=lcell, within=1e9)
        met.append(every.count())
    assert found[0] == found[1] == found[2] and len(found[0]) > 300
    assert met[2] < met[1] < met[0] < 400 * 400 * 3 / 2


def test_range_joins_make_no_table_of_atoms(spark, monkeypatch):
    """They need no numbers of molecules: lines and orders are shuffled once, and their atoms go to the join."""
    registry.forget()
    names, settled = [], registry.settled
    for module in (registry, registry.tables):
        monkeypatch.setattr(module, "settled", lambda df, name="stage": names.append(name) or settled(df, name))
    for query in ("range_join", "range_join_lcell", "range_join_triclinic"):
        plan = registry.queries()[query](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
        assert not names and "dense_rank" not in plan and "l_shipdate" not in plan.split("Relation")[0]
