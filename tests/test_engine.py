"""Toy systems with known answers, and brute force in plain Python."""

import itertools
import math
from dataclasses import replace
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shellspark import api
from shellspark.functions import geometry as geo
from shellspark.functions import scalars as sc
from shellspark.operators import derived as de
from shellspark.operators import pairs as pr
from shellspark.operators.residue_map import ResidueContributions
from shellspark.operators.selection import AtomSelection, Group, SoluteGroup, SolventGroup, predicate, select
from shellspark.options import Options
from shellspark.plans import engine
from shellspark.plans.system import System
from shellspark.sinks import persistence, report
from shellspark.sources import dcd, pdb
from shellspark.sources.trajectory import Trajectory, write_parquet
from shellspark.streaming import counts as stream_counts

CELL = "CRYST1   30.   30.   30.  90.00  90.00  90.00 P 1           1\n"


def atom(i, name, res, x, y, z):
    return f"ATOM  {i:5d}  {name:<3s} {res} X   0    {x:8.3f}{y:8.3f}{z:8.3f}  0.00  0.00\n"


def cross_frame():
    out, i = CELL, 0
    for x in (9, 11, 12):
        for name, y, z in (("O", 0, 0), ("H", 2, 0), ("H", 0, 2)):
            i += 1
            out += atom(i, name, "WAT", x, y, z)
    return out + atom(1, "C", "GLY", 0, 0, 0) + "END\n"


@pytest.fixture(scope="module")
def cross(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("toy") / "cross.pdb"
    path.write_text(cross_frame() * 2)
    atoms = pdb.read_pdb(spark, str(path)).where("model = 1")
    solute = AtomSelection.of(select(atoms, "protein"), nmols=1)
    water = AtomSelection.of(select(atoms, "resname WAT"), natomspermol=3)
    return Trajectory.open(spark, str(path), solute, water)


@pytest.fixture(scope="module")
def cross_result(spark, cross):
    return api.mddf(spark, cross, Options(n_random_samples=3000, silent=True))


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_cross(cross_result):
    s = cross_result.scalars().first()
    assert s.volume_total == pytest.approx(27000)
    assert s.density_solute == pytest.approx(1 / 27000)
    assert s.density_solvent == pytest.approx(3 / 27000)
    assert s.density_solvent_bulk == pytest.approx(2 / s.volume_bulk)
    assert s.volume_domain == pytest.approx(4 / 3 * math.pi * 1000, rel=0.12)
    assert total(cross_result.bins, "md_count") == pytest.approx(1)
    assert total(cross_result.bins, "coordination_number") == pytest.approx(51)


def test_coordination_only(spark, cross, cross_result):
    with pytest.warns(UserWarning):
        r = api.coordination_number(spark, cross, Options())
    a, b = (np.array(y.bins.select("bin", "md_count", "coordination_number").orderBy("bin").collect()) for y in (r, cross_result))
    assert a == pytest.approx(b)
    s = r.scalars().first()
    assert s.volume_domain == 0 and s.density_solvent_bulk == 0
    o = de.overview(r).first()
    assert math.isinf(o.solvent_molar_volume_bulk) and o.solute_molar_volume == -math.inf
    with pytest.raises(ValueError):
        api.coordination_number(spark, cross, coordination_number_only=True)
    with pytest.raises(TypeError):
        api.mddf(spark, cross, "options")


def test_conservation(cross_result):
    bins = {r.bin: r for r in cross_result.bins.collect()}
    water = de.contributions(cross_result, SolventGroup(["O", "H"]))
    solute = de.contributions(cross_result, SoluteGroup(["C"]), "kbi")
    for r in water.collect():
        assert r.value == pytest.approx(bins[r.bin].mddf)
    for r in solute.collect():
        assert r.value == pytest.approx(bins[r.bin].kb, abs=1e-6)
    one = de.contributions(cross_result, SolventGroup([1]), "md_count")
    assert total(one, "value") == pytest.approx(1 / 3)  # the first water's oxygen stands for a third of all
    for bad in (SolventGroup(["X"]), SolventGroup([99]), SoluteGroup(1), SoluteGroup("C")):
        with pytest.raises(ValueError):
            de.contributions(cross_result, bad)
    with pytest.raises(ValueError):
        de.contributions(cross_result, SoluteGroup(["C"]), "none")


def test_renormalize(cross_result):
    rho = cross_result.scalars().first().density_solvent_bulk
    double = de.renormalize(cross_result, 2 * rho, "sites/Angs3")
    a = {r.bin: r for r in cross_result.bins.collect()}
    for r in double.bins.collect():
        assert r.mddf == pytest.approx(a[r.bin].mddf / 2)
        assert r.kb == pytest.approx(sc.CM3_PER_MOL / rho * (r.coordination_number - r.coordination_number_random))
    assert double.scalars().first().density_solvent_bulk == pytest.approx(rho)
    with pytest.raises(ValueError):
        de.renormalize(cross_result, 1, "kg")


def test_merge_equal_parts(spark, cross):
    parts = [api.mddf(spark, cross, Options(firstframe=k, lastframe=k, n_random_samples=50)) for k in (1, 2)]
    m = de.merge(parts)
    assert m.weights == (0.5, 0.5)
    assert total(m.bins, "md_count") == pytest.approx(1)
    other = api.mddf(spark, cross, Options(firstframe=1, lastframe=1, n_random_samples=5, dbulk=8.0))
    with pytest.raises(ValueError):
        de.merge([parts[0], other])


@pytest.fixture(scope="module")
def mono(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("mono")
    frame = lambda x: CELL + atom(1, "O", "WAT", 0, 0, 0) + atom(2, "O", "WAT", x, 0, 0) + "END\n"
    (folder / "a.pdb").write_text(frame(5) + frame(11))
    (folder / "dup.pdb").write_text(frame(5) * 2 + frame(11))
    sel = AtomSelection.make([1, 2], natomspermol=1, group_names=["O"])
    return tuple(Trajectory.open(spark, str(folder / f), sel) for f in ("a.pdb", "dup.pdb"))


def test_autocorrelation_and_weights(spark, mono):
    a, dup = mono
    run = lambda t, w=None, **o: api.mddf(spark, t, Options(n_random_samples=200, **o), frame_weights=w)
    assert total(run(a, lastframe=1).bins, "md_count") == pytest.approx(1)
    second = run(a, firstframe=2)
    s = second.scalars().first()
    assert s.density_solvent_bulk == pytest.approx(1 / s.volume_bulk) and s.density_solvent == pytest.approx(2 / 27000)
    both = run(a).scalars().first()
    assert both.density_solvent_bulk == pytest.approx(0.5 / both.volume_bulk)
    two, three = run(a, [2, 1]), run(dup)
    assert total(two.bins, "md_count") == total(three.bins, "md_count") == pytest.approx(2 / 3)
    assert total(run(a, [1, 2]).bins, "md_count") == pytest.approx(1 / 3)
    assert total(run(a, [0, 1]).bins, "md_count") == total(second.bins, "md_count") == 0
    groups = two.groups.groupBy("side").agg(F.sum("n").alias("n")).collect()
    assert [g.n for g in groups] == pytest.approx([2 / 3, 2 / 3])
    with pytest.raises(ValueError):
        run(a, [1])
    with pytest.raises(ValueError):
        run(a, [0, 0])
    with pytest.raises(ValueError):
        run(a, lastframe=9)


def test_merge_with_weights(spark, mono):
    first = api.mddf(spark, mono[0], Options(lastframe=1, n_random_samples=20), frame_weights=[2])
    second = api.mddf(spark, mono[0], Options(firstframe=2, n_random_samples=20))
    with pytest.warns(UserWarning):
        m = de.merge([first, second])
    assert total(m.bins, "md_count") == pytest.approx(2 / 3)


def test_cell_is_carried_over(spark, tmp_path):
    path = tmp_path / "self.pdb"
    water = lambda x, k: "".join(atom(k + i, n, "WAT", x, y, z) for i, (n, y, z) in enumerate((("O", 0, 0), ("H", 2, 0), ("H", 0, 2))))
    path.write_text(CELL + water(0, 1) + water(6, 4) + "ENDMDL\n" + water(0, 1) + water(11, 4) + "ENDMDL\nEND\n")
    coords, cells = pdb.trajectory(spark, str(path))
    assert [(r.frame, r.volume) for r in cells.orderBy("frame").collect()] == [(1, 27000.0), (2, 27000.0)]
    assert coords.where("frame = 2 and atom_index = 4").first().x == 11
    traj = Trajectory.open(spark, str(path), AtomSelection.make(range(1, 7), natomspermol=3))
    assert traj.irefatom() == 1
    assert total(api.mddf(spark, traj, Options(n_random_samples=5)).bins, "md_count") == pytest.approx(0.5 + 0.5 * (11 - 0 <= 10) + 0)
    (tmp_path / "none.pdb").write_text(water(0, 1) + "END\n")
    none = Trajectory.open(spark, str(tmp_path / "none.pdb"), AtomSelection.make([1, 2, 3], nmols=1))
    with pytest.raises(ValueError):
        none.system()
    with pytest.raises(ValueError):
        Trajectory.open(spark, "a.xyz", AtomSelection.make([1], nmols=1))


def _random_system(spark, m, n=(6, 25), frames=2, seed=3):
    rng = random.Random(seed)
    a, b, c = m[:3], m[3:6], m[6:]
    point = lambda: [sum(f * v for f, v in zip(fs, col, strict=True)) for fs in [[rng.uniform(-0.6, 1.6) for _ in range(3)]] for col in zip(a, b, c, strict=True)]
    make = lambda k: [(f, i // 2 + 1, i // 2 + 1, i % 2 + 1, i + 1, *point()) for f in range(1, frames + 1) for i in range(2 * k)]
    left, right = make(n[0]), make(n[1])
    kinds = lambda s: f"frame int, {s}mol bigint, {s}idx bigint, {s}atype int, {s}atom bigint, {s}x double, {s}y double, {s}z double"
    cell = spark.createDataFrame([(f, list(map(float, m))) for f in range(1, frames + 1)], "frame int, m array<double>").withColumn("w", F.lit(1.0)).withColumn("volume", geo.volume(F.col("m")))
    return left, right, spark.createDataFrame(left, kinds("s")), spark.createDataFrame(right, kinds("v")), cell


@pytest.mark.parametrize("m", [(20, 0, 0, 0, 24, 0, 0, 0, 31), (10, 5, 0, 0, 10, 0, 0, 0, 10), (20, 0, 0, 9, 19, 0, -7, 6, 18)])
def test_range_join_is_brute_force(spark, m):
    cutoff = 4.4  # half of the least height is 4.47 in the second cell
    left, right, s, v, frames = _random_system(spark, m)
    ortho = all(m[k] == 0 for k in (1, 2, 3, 5, 6, 7))
    assert bool(frames.select(geo.is_orthorhombic(F.col("m"))).first()[0]) == ortho
    shifts = [[i * m[t] + j * m[3 + t] + k * m[6 + t] for t in range(3)] for i, j, k in itertools.product(range(-4, 5), repeat=3)]
    sh = np.array(shifts)
    expected = {}
    for x in left:
        for y in right:
            if x[0] == y[0]:
                d = np.sqrt((((np.array(y[5:]) - np.array(x[5:])) + sh) ** 2).sum(axis=1)).min()
                if d <= cutoff:
                    expected[x[0], x[4], y[4]] = d
    for strategy in ("cells", "brute"):
        got = {(r.frame, r.satom, r.vatom): math.sqrt(r.d2) for r in pr.range_join(s, v, frames, cutoff, ortho, strategy=strategy).collect()}
        assert got.keys() == expected.keys()
        assert got == pytest.approx(expected)
    least = {}
    for (f, i, j), d in expected.items():
        key = (f, (i + 1) // 2, (j + 1) // 2)
        least[key] = min(least.get(key, (9e9, 0, 0)), (d, i, j))
    md = {(r.frame, r.smol, r.vmol): (r.i, r.j) for r in pr.min_distance(pr.range_join(s, v, frames, cutoff, ortho), 1).collect()}
    assert md == {k: x[1:] for k, x in least.items()}


def test_random_moves_keep_molecules_rigid(spark):
    from shellspark.operators import random_reference as rr

    for m in ((30, 0, 0, 0, 30, 0, 0, 0, 30), (30, 15, 0, 0, 30, 0, 0, 0, 30)):
        _, _, s, v, frames = _random_system(spark, m, (2, 8), 1)
        system = System(s, v, frames, 2, 8, 2, 2, Options(dbulk=4.0, n_random_samples=3), 1, ortho=m[1] == 0)
        md = engine.minimum_distances(system)
        bulk = rr.bulk_molecules(system, md, rr.reference_solutes(system))
        local = rr.unwrapped(system)
        slots = rr.slots(system, bulk)
        moved = rr.random_move(slots, local, frames)
        d = lambda df, keys, p: df.groupBy(*keys).agg(*(F.max(F.when(F.col("vatype") == 1, F.col(p + c))).alias(f"a{c}") for c in "xyz"), *(F.max(F.when(F.col("vatype") == 2, F.col(p + c))).alias(f"b{c}") for c in "xyz"))
        dist = lambda r: math.dist((r.ax, r.ay, r.az), (r.bx, r.by, r.bz))
        before = {r.vidx: dist(r) for r in d(local, ["vidx"], "u").collect()}
        source = {(r.k, r.slot): r.vidx for r in slots.collect()}
        after = {(r.k, r.vidx): dist(r) for r in d(moved, ["k", "vidx"], "v").collect()}
        assert len(after) == 24
        for key, x in after.items():
            assert x == pytest.approx(before[source[key]])


def test_euler(spark):
    for beta, gamma, theta, diagonal in ((0, 0, 0, (1, 1, 1)), (math.pi, 0, 0, (1, -1, -1)), (0, math.pi, 0, (-1, 1, -1)), (0, 0, math.pi, (-1, -1, 1))):
        a = geo.euler(*(F.lit(float(x)) for x in (beta, gamma, theta)))
        row = spark.range(1).select(*(a[i][j].alias(f"a{i}{j}") for i in range(3) for j in range(3))).first()
        assert list(row) == pytest.approx(np.diag(diagonal).ravel().tolist(), abs=1e-12)


def test_scalars(spark):
    row = spark.range(1).select(sc.shell_radius(F.lit(1), 0.1), sc.shell_radius(F.lit(5), 0.3), sc.shell_volume(F.lit(2), 1.0), sc.bin_of(F.lit(0.0), 0.1), sc.bin_of(F.lit(10.0), 0.02), sc.bin_of(F.lit(None).cast("double"), 0.1)).first()
    assert list(row) == [pytest.approx(0.07937005259840998), pytest.approx(1.3664650373440481), pytest.approx(4 * math.pi / 3 * 7), 1, 500, None]


def test_options():
    o = Options()
    assert (o.dbulk, o.cutoff, o.usecutoff, o.nbins) == (10, 10, False, 500)
    assert Options(bulk_range=(8.0, 12.0)).usecutoff and Options(usecutoff=True).cutoff == 14
    assert Options(dbulk=8.0).cutoff == 8 and Options(dbulk=6, usecutoff=True, cutoff=8.2).nbins == 410
    for bad in ({"stride": 0}, {"firstframe": 5, "lastframe": 2}, {"n_random_samples": 0}, {"cutoff": 12.0}, {"cutoff": 12.0, "usecutoff": False}, {"dbulk": 10.0, "cutoff": 9.0, "usecutoff": True}, {"dbulk": 10.005}, {"bulk_range": (8.0,)}, {"bulk_range": (8.0, 12.0), "dbulk": 8.0}, {"bulk_range": (12.0, 8.0)}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_selections(spark):
    with pytest.raises(ValueError):
        AtomSelection.make([], nmols=1)
    for bad in ({}, {"natomspermol": 2}, {"nmols": 2}, {"nmols": 1, "group_atom_indices": [[1, 1]], "group_names": ["a"]}, {"nmols": 1, "group_atom_indices": [[9]], "group_names": ["a"]}, {"nmols": 1, "group_atom_indices": [[1]], "group_names": ["a", "b"]}):
        with pytest.raises(ValueError):
            AtomSelection.make([1, 2, 3], **bad)
    with pytest.warns(UserWarning):
        s = AtomSelection.make([1, 2, 3], nmols=1, group_atom_indices=[[2, 1], [2, 3]], group_names=["a", "b"])
    assert s.atom_group("a") == (1, 2) and s.atom_group(2) == (2, 3) and s.atom_group_names() == ("a", "b")
    for which in ("c", 3):
        with pytest.raises(ValueError):
            s.atom_group(which)
    with pytest.raises(ValueError):
        AtomSelection.make([1], nmols=1).atom_group(1)
    with pytest.raises(TypeError):
        Group("solute")
    with pytest.raises(ValueError):
        SoluteGroup([1, 1])
    atoms = spark.createDataFrame([(1, "CA", "ALA", 1), (2, "OW", "SOL", 2), (3, "N", "ASP", 3), (4, "CB", "LYS", 4)], "atom_index int, name string, resname string, resnum int")
    ids = lambda text: [r.atom_index for r in atoms.where(predicate(text)).orderBy("atom_index").collect()]
    assert ids("protein") == [1, 3, 4] and ids("water or acidic") == [2, 3] and ids("charged and not basic") == [3]
    assert ids("sidechain") == [4] and ids("backbone") == [1, 3] and ids("resnum 1 2 4 and not (name CB)") == [1, 2] and ids("resnum >= 3") == [3, 4]
    assert ids("polar or nonpolar") == ids("protein") and ids("neutral") == [1]
    for bad in ("", "what 3", "(name CA", "name", "protein protein"):
        with pytest.raises(ValueError):
            predicate(bad)


def test_custom_groups_may_overlap(spark, cross):
    water = AtomSelection.make(cross.solvent.indices, natomspermol=3, group_names=["oxygen", "all"], group_atom_indices=[[1, 4, 7], list(range(1, 10))])
    r = api.mddf(spark, Trajectory.open(spark, cross.filename, cross.solute, water), Options(n_random_samples=20))
    assert total(de.contributions(r, SolventGroup("oxygen"), "md_count"), "value") == pytest.approx(1)
    assert total(de.contributions(r, SolventGroup(2), "coordination_number"), "value") == pytest.approx(51)
    with pytest.raises(ValueError):
        de.contributions(r, SolventGroup(["O"]))


def test_residue_map(spark, cross_result, cross, tmp_path):
    atoms = pdb.read_pdb(spark, cross.filename, "protein").where("model = 1")
    rc = ResidueContributions.make(cross_result, atoms, type="coordination_number")
    assert rc.table.count() == 101 and len(rc) == 1
    wide = ResidueContributions.make(cross_result, atoms, 8.0, 9.9, "coordination_number")
    assert total(wide.table, "value") > 0
    assert (wide + wide) == 2 * wide and total((wide - wide).table, "value") == 0 and (wide / wide).extrema().first().largest == 1
    assert (rc / rc).extrema().first().largest == 0  # a quotient by 0 is 0
    with pytest.raises(ValueError):
        rc + wide
    with pytest.raises(TypeError):
        rc < wide  # noqa: B015
    with pytest.raises(TypeError):
        ResidueContributions.make(cross_result, SoluteGroup(["C"]))
    assert wide[1:1] == wide and len(wide[2:5]) == 0 and wide.findmax().first().value == pytest.approx(1)
    assert "|" in wide.heatmap()
    wide.save(str(tmp_path / "rc.json"))
    back = ResidueContributions.load(spark, str(tmp_path / "rc.json"))
    assert back.version == wide.version == persistence.VERSION
    assert sorted(map(tuple, back.table.collect())) == sorted(map(tuple, wide.table.select(*back.table.columns).collect()))
    wide.version = "1.0.0"
    wide.save(str(tmp_path / "old.json"))
    with pytest.raises(ValueError):
        ResidueContributions.load(spark, str(tmp_path / "old.json"))


def test_save_and_load(spark, cross_result, tmp_path):
    path = persistence.save(str(tmp_path / "r.json"), cross_result)
    back = persistence.load(spark, path)
    assert not de.differences(cross_result, back, 1e-12).count()
    assert back.solvent == cross_result.solvent and back.options.nbins == 500
    text = (tmp_path / "r.json").read_text()
    for version in ("1.9.0", "99.0.0"):
        (tmp_path / "v.json").write_text(text.replace(persistence.VERSION, version, 1))
        with pytest.raises(ValueError):
            persistence.load(spark, str(tmp_path / "v.json"))
    for broken in ("", "{}", '{"Version": "2.18.0"}', '{"Version": "2.18.0", "options": '):
        (tmp_path / "b.json").write_text(broken)
        with pytest.raises(ValueError):
            persistence.load(spark, str(tmp_path / "b.json"))


def test_report(spark, cross_result, tmp_path):
    files = report.write(str(tmp_path / "out.dat"), cross_result)
    rows = [x.split() for x in open(files[0]) if not x.startswith("#")]
    assert len(rows) == 500 and len(rows[0]) == 8
    assert sum(float(r[3]) for r in rows) == pytest.approx(1, abs=1e-4)
    assert files[2].endswith("out-GROUP_CONTRIBUTIONS_SOLVENT.dat")
    assert len(next(x for x in open(files[2]) if not x.startswith("#")).split()) == 4
    with pytest.raises(ValueError):
        report.write(str(tmp_path / "x.dat"), cross_result, solvent_group_names=["a"])


def test_dcd(spark, tmp_path):
    rng = np.random.default_rng(1)
    frames = [([30.0, 90.0, 31.0, 90.0, 0.0 if k == 1 else 90.0, 32.0], rng.random((5, 3)) * 30) for k in range(3)]
    path = str(tmp_path / "a.dcd")
    dcd.write(path, frames)
    assert dcd.layout(path).frames == 3
    coords, cells = dcd.trajectory(spark, path, lastatom=4)
    assert coords.count() == 12
    assert [r.volume for r in cells.orderBy("frame").collect()] == pytest.approx([30 * 31 * 32.0] * 3)
    r = coords.where("frame = 2 and atom_index = 3").first()
    assert (r.x, r.y, r.z) == pytest.approx(tuple(frames[1][1][2]), rel=1e-6)
    write_parquet(coords, cells, str(tmp_path / "traj"))
    back = Trajectory.open(spark, str(tmp_path / "traj"), AtomSelection.make([1], nmols=1), format="parquet")
    assert back.coords.count() == 12
    (tmp_path / "bad.dcd").write_bytes(b"none" * 20)
    with pytest.raises(ValueError):
        dcd.layout(str(tmp_path / "bad.dcd"))


def test_stream_equals_batch(spark, cross, tmp_path):
    system = cross.system(Options())
    md = engine.minimum_distances(system).join(system.frames.select("frame", "w"), "frame").select("frame", "d", "w")
    md.write.partitionBy("frame").parquet(str(tmp_path / "pairs"))
    stream = spark.readStream.schema("d double, w double, frame int").parquet(str(tmp_path / "pairs"))
    q = stream_counts.md_count(stream, 0.02).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from counts").collect()} == {tuple(r) for r in stream_counts.md_count(md, 0.02).collect()}


def test_gr(spark):
    bins = spark.range(1, 101).select(F.col("id").cast("int").alias("bin")).withColumn("d", sc.shell_radius(F.col("bin"), 0.1)).withColumn("density_solvent_bulk", F.lit(0.03)).withColumn("rdf_count", sc.shell_volume(F.col("bin"), 0.1) * 0.03)
    last = de.gr(bins, 0.1).orderBy(F.desc("bin")).first()
    assert last.gr == pytest.approx(1) and last.kb == pytest.approx(0, abs=1e-9)


def test_one_namespace_and_texts(spark, cross_result, tmp_path):
    from shellspark import api

    assert all(hasattr(api, name) for name in api.__all__)
    text = api.summary(cross_result)
    assert all(x in text for x in ("Shell analysis", "Mean volumes", "Mean densities", "Options", "Bin step", "expected 1"))
    assert "solvent molar volume" in api.overview_text(cross_result)
    api.save_parquet(str(tmp_path / "r"), cross_result)
    back = api.load_parquet(spark, str(tmp_path / "r"))
    assert not de.differences(cross_result, back, 1e-12).count()
    assert (back.options, back.solute, back.solvent) == (cross_result.options, cross_result.solute, cross_result.solvent)
    assert api.coordination_number(cross_result).count() == 500
    with pytest.raises(TypeError):
        api.coordination_number(cross_result, "CA")
    atoms = spark.createDataFrame([(i, 10.0 * k, 0.0, 0.0) for k, i in enumerate(cross_result.solute.indices)], "atom_index int, x double, y double, z double")
    own = [("solute", g, b, 1.0, 0.0) for g in range(1, cross_result.solute.natomspermol + 1) for b in range(1, 501)]
    even = replace(cross_result, groups=spark.createDataFrame(own, "side string, group_id int, bin int, n double, n_random double"))
    points = api.grid3D(even, atoms, str(tmp_path / "grid.pdb"), 1.5, 9.0, 3.0, "coordination_number")
    lines = (tmp_path / "grid.pdb").read_text().splitlines()
    assert lines[-1] == "END" and len(lines) == points.count() + 1 > 1
    for r in points.limit(5).collect():
        assert 1.5 < r.r < 9 and r.r == pytest.approx(min(math.dist((r.gx, r.gy, r.gz), (10.0 * k, 0, 0)) for k in range(len(cross_result.solute.indices))))
    with pytest.raises(ValueError):
        api.grid3D(cross_result, atoms.limit(0))
