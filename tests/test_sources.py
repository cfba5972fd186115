"""Binary trajectories: XTC and DCD, their indexes, choices of frames, and damaged files."""

import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from shellspark.operators.selection import AtomSelection
from shellspark.options import Options
from shellspark.plans import engine
from shellspark.sources import dcd, files, pdb, xtc
from shellspark.sources.trajectory import Trajectory, write_parquet

CELL = [5.0, 0, 0, 1.0, 4.0, 0, 0.5, 0.25, 3.0]


def waters(n, seed, scale=5.0, spread=0.08):
    """Atoms in threes that lie together, as the small differences want them, with some far apart."""
    rng = np.random.default_rng(seed)
    return np.repeat(rng.random((n // 3 + 1, 3)) * scale, 3, axis=0)[:n] + rng.normal(0, spread, (n, 3)) * rng.choice([0.1, 1, 9], (n, 1))


@pytest.mark.parametrize(("n", "scale", "precision", "long"), [(1, 5, 1000, False), (9, 5, 1000, False), (10, 5, 1000, True), (700, 5, 1000, False), (701, 0.2, 1000, False), (300, 30000, 1000, False), (300, 20, 10, True), (64, 0, 1000, False)])
def test_frames_come_back_at_their_precision(n, scale, precision, long):
    for seed in range(3):
        x = waters(n, seed, scale)
        frame = xtc.pack(x, CELL, 7, 1.5, precision, long)
        assert xtc.frame_size(frame[: xtc.HEADER]) == (n, len(frame)) and len(frame) % 4 == 0
        assert np.abs(xtc.unpack(frame) - x).max() <= (0.5 / precision + 1e-6 if n > 9 else 1e-6 * max(1, scale))


def test_a_packed_frame_bit_by_bit():
    """Ten atoms by hand: full atoms of 9 bits (sizes 8, 8, 8: numbers up to 512 need 10), and one pair by a small difference."""
    full = [[1, 2, 3], [0, 0, 0], [7, 7, 7], [3, 1, 4], [1, 5, 2], [6, 5, 3], [5, 0, 7], [4, 4, 4]]
    bits = ""
    le = lambda v, n: "".join(f"{v >> k & (1 << min(8, n - k)) - 1:0{min(8, n - k)}b}" for k in range(0, n, 8))
    for x, y, z in full:
        bits += le((x * 8 + y) * 8 + z, 10) + "0"
    # One block of a full atom and one neighbour that is written before it: differences (1, -1, 0) + 4 in a range of 8.
    bits += le((2 * 8 + 2) * 8 + 2, 10) + "1" + f"{3 * 1 + 1:05b}" + le((5 * 8 + 3) * 8 + 4, 9)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    head = struct.pack(">3if9fi", 1995, 10, 0, 0.0, *CELL, 10) + struct.pack(">f7i", 100.0, 0, 0, 0, 7, 7, 7, 9) + struct.pack(">i", len(data))
    got = xtc.unpack(head + data + bytes(-len(data) % 4)) * 100
    assert np.rint(got).astype(int).tolist() == [*full, [3, 1, 2], [2, 2, 2]]


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    """Forty frames of 30 atoms: as numbers, as one XTC file and as a folder of three."""
    xs = [waters(30, k) for k in range(40)]
    raw = [xtc.pack(x, CELL, k) for k, x in enumerate(xs)]
    folder = tmp_path_factory.mktemp("xtc")
    (folder / "one.xtc").write_bytes(b"".join(raw))
    for k, (a, b) in enumerate(((0, 13), (13, 14), (14, 40))):
        (folder / "parts").mkdir(exist_ok=True)
        (folder / "parts" / f"p{k}.xtc").write_bytes(b"".join(raw[a:b]))
    return xs, folder


@pytest.mark.parametrize("name", ["one.xtc", "parts"])
@pytest.mark.parametrize("size", [100, 1000, 1 << 20])
def test_an_index_of_any_ranges_has_all_frames(spark, frames, name, size):
    xs, folder = frames
    own = xtc.scan(spark, str(folder / name), size)
    got = {(r.frame, r.atom_index): (r.x, r.y, r.z) for r in own.coords().collect()}
    assert len(got) == 40 * 30
    assert max(np.abs(np.array(v) - 10 * xs[f - 1][a - 1]).max() for (f, a), v in got.items()) < 0.0051
    assert own.coords(2, 30, 3, 4).groupBy("frame").count().orderBy("frame").collect() == [(f, 4) for f in range(2, 31, 3)]
    assert [r.volume for r in own.cells.collect()] == pytest.approx([60000.0] * 40)
    assert own.coords().rdd.getNumPartitions() > 1


def test_magic_numbers_inside_of_frames_are_not_frames(spark, tmp_path):
    """Nine atoms are plain floats: some that look like a header."""
    fake = np.frombuffer(struct.pack(">2i", 1995, 9), ">f4")
    x = np.zeros((9, 3), np.float32)
    x.ravel()[3:5] = x.ravel()[9:11] = fake
    (tmp_path / "a.xtc").write_bytes(b"".join(xtc.pack(x, CELL, k) for k in range(20)))
    for size in (40, 64, 164, 300):
        assert xtc.index(spark, str(tmp_path / "a.xtc"), size).select("frame", "offset").orderBy("frame").collect() == [(k + 1, 164 * k) for k in range(20)]


def test_a_damaged_file_is_refused(spark, frames, tmp_path):
    _, folder = frames
    raw = (folder / "one.xtc").read_bytes()
    for k, bad in enumerate((raw[:-4], raw[:50], b"none" * 30, b"", raw + b"\0" * 8)):
        (tmp_path / f"{k}.xtc").write_bytes(bad)
        with pytest.raises(Exception, match="frame|XTC|trajectory|partition|files"):
            xtc.scan(spark, str(tmp_path / f"{k}.xtc")).coords().count() or pytest.fail("no frames, but no error")


def test_written_frames_are_read(spark, frames, tmp_path):
    xs, _ = frames
    rows = [(k + 1, a + 1, *(10 * p for p in map(float, xs[k][a]))) for k in range(40) for a in range(30)]
    coords = spark.createDataFrame(rows, "frame int, atom_index int, x double, y double, z double").repartition(5)
    cells = spark.createDataFrame([(k + 1, [10.0 * v for v in CELL]) for k in range(40)], "frame int, m array<double>")
    xtc.write(coords, cells, str(tmp_path / "out"), frames_per_file=7)
    own = xtc.scan(spark, str(tmp_path / "out"))
    far = own.coords().join(coords.toDF("frame", "atom_index", "u", "v", "w"), ["frame", "atom_index"])
    assert far.count() == 1200 and far.where("abs(x - u) > 0.0051 or abs(y - v) > 0.0051 or abs(z - w) > 0.0051").count() == 0


def test_a_calculation_reads_an_xtc_file(spark, tmp_path):
    """The same counts from XTC as from the tables it was written from, with a stride."""
    xs = [np.round(waters(30, k, 3.0), 3) for k in range(6)]
    cell = [3.0, 0, 0, 0, 3.0, 0, 0, 0, 3.0]
    (tmp_path / "a.xtc").write_bytes(b"".join(xtc.pack(x, cell, k) for k, x in enumerate(xs)))
    rows = [(k + 1, a + 1, *(float(v) for v in 10 * xs[k][a])) for k in range(6) for a in range(30)]
    coords = spark.createDataFrame(rows, "frame int, atom_index int, x double, y double, z double")
    cells = spark.createDataFrame([(k + 1, [10.0 * v for v in cell], 27000.0) for k in range(6)], "frame int, m array<double>, volume double")
    write_parquet(coords, cells, str(tmp_path / "tables"), 2)
    solute, solvent = AtomSelection.make(list(range(1, 7)), nmols=2), AtomSelection.make(list(range(7, 31)), nmols=8)
    out = []
    for path, kind in ((tmp_path / "a.xtc", "xtc"), (tmp_path / "tables", "parquet")):
        t = Trajectory.open(spark, str(path), solute, solvent, kind)
        md = engine.minimum_distances(t.system(Options(firstframe=2, lastframe=6, stride=2, bulk_range=(5.0, 10.0))))
        out.append({(r.frame, r.sidx, r.vidx): (r.i, r.j, round(r.d, 4)) for r in md.collect()})
        assert {k[0] for k in out[-1]} == {2, 4, 6}
    assert out[0] == out[1]


@pytest.fixture
def dcd_file(tmp_path):
    rng = np.random.default_rng(1)
    frames = [([30.0, 90.0, 31.0, 90.0, 90.0, 32.0], rng.random((500, 3)) * 30) for _ in range(200)]
    path = str(tmp_path / "a.dcd")
    dcd.write(path, frames)
    return path, frames


def test_choices_are_read_by_the_dcd_source_alone(spark, dcd_file):
    path, frames = dcd_file
    own = dcd.scan(spark, path)
    rows = own.coords(10, 50, 4, lastatom=3)
    assert {r.frame for r in rows.collect()} == set(range(10, 51, 4)) and rows.count() == 33
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan), plan
    # One table in several queries, also within one plan, with filters and without.
    r = rows.where("frame = 14 and atom_index = 2").first()
    assert (r.x, r.y, r.z) == pytest.approx(tuple(frames[13][1][1]), rel=1e-6) and rows.count() == 33
    assert rows.where("frame = 14").union(rows.where("frame = 18")).select("frame").distinct().count() == 2 and rows.count() == 33
    assert own.coords().where("frame in (3, 7) and x >= 0").select("frame").distinct().count() == 2


class Counting:
    """A file that counts the bytes read from it."""

    total = 0

    def __init__(self, f):
        self.f = f

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def read(self, n):
        data = self.f.read(n)
        Counting.total += len(data)
        return data

    def __getattr__(self, name):
        return getattr(self.f, name)


def test_bytes_that_are_read(dcd_file, monkeypatch):
    path, _ = dcd_file
    plain = files.opened
    monkeypatch.setattr(dcd.files, "opened", lambda uri: Counting(plain(uri)))

    def read(**options):
        reader = dcd.Reader({"path": path, **options})
        Counting.total = 0
        rows = sum(len(batch) for part in reader.partitions() for batch in reader.read(part))
        return rows, Counting.total

    whole = 200 * 3 * 4 * 500
    assert read() == (200 * 500, whole)
    assert read(what="cells") == (200, 200 * 56)
    assert read(first="191") == (10 * 500, whole // 20) == read(first="191", last="900")
    assert read(first="7", stride="50", lastatom="10") == (4 * 10, 4 * 120)
    assert read(first="201") == read(first="9", last="8") == (0, 0)


def test_a_dcd_file_that_ends_within_a_frame(spark, dcd_file, tmp_path):
    raw = open(dcd_file[0], "rb").read()
    (tmp_path / "cut.dcd").write_bytes(raw[:-5])
    with pytest.raises(ValueError, match="within frame 200"):
        dcd.layout(str(tmp_path / "cut.dcd"))


def test_folders_of_pdb_and_spans_of_parquet(spark, tmp_path):
    line = "ATOM  {:5d}  O   WAT X{:4d}    {:8.3f}{:8.3f}{:8.3f}  0.00  0.00\n"
    for k in range(4):
        text = "".join(line.format(i + 1, i // 3 + 1, k + i / 10, i, -k) for i in range(6))
        (tmp_path / "pdb").mkdir(exist_ok=True)
        (tmp_path / "pdb" / f"f{k}.pdb").write_text(f"CRYST1   {30 + k}.000   30.000   30.000  90.00  90.00  90.00 P 1           1\n{text}END\n")
    coords, cells = pdb.trajectory(spark, str(tmp_path / "pdb"))
    assert {(r.frame, r.atom_index): r.x for r in coords.collect()} == {(k + 1, i + 1): pytest.approx(k + i / 10) for k in range(4) for i in range(6)}
    assert [r.volume for r in cells.orderBy("frame").collect()] == pytest.approx([900.0 * (30 + k) for k in range(4)])
    atoms = pdb.read_pdb(spark, str(tmp_path / "pdb")).orderBy("atom_index").collect()
    assert [r.atom_index for r in atoms] == list(range(1, 25)) and [r.residue for r in atoms] == [k // 3 + 1 for k in range(24)]
    many = spark.range(1, 41).select(F.col("id").cast("int").alias("frame"), F.lit(1).alias("atom_index"), *(F.lit(1.0).alias(c) for c in "xyz"))
    write_parquet(many, cells.limit(1), str(tmp_path / "t"), 4)
    t = Trajectory.open(spark, str(tmp_path / "t"), AtomSelection.make([1], nmols=1), format="parquet")
    chosen = t.scan.coords(9, 16)
    assert chosen.count() == 8 and {f.split("span=")[1].split("/")[0] for f in chosen.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {"2", "3"}
    assert "PartitionFilters: [isnotnull(span" in chosen._jdf.queryExecution().executedPlan().toString()


def test_a_trajectory_tells_what_it_is(spark, frames):
    _, folder = frames
    t = Trajectory.open(spark, str(folder / "one.xtc"), AtomSelection.make([1, 2], nmols=1), AtomSelection.make([3, 4, 5, 6], nmols=2))
    text = str(t)
    assert all(x in text for x in ("one.xtc", "format: xtc, 40 frames", "volume 60000", "2 atoms of 1 molecule", "4 atoms of 2 molecules"))


def test_bins_without_random_counts_are_told(spark, tmp_path):
    line = "ATOM  {:5d}  O   WAT X{:4d}    {:8.3f}{:8.3f}{:8.3f}  0.00  0.00\n"
    cell = "CRYST1   30.000   30.000   30.000  90.00  90.00  90.00 P 1           1\n"
    (tmp_path / "a.pdb").write_text(cell + "".join(line.format(k + 1, k + 1, 3.0 * k, 0, 0) for k in range(4)) + "END\n")
    t = Trajectory.open(spark, str(tmp_path / "a.pdb"), AtomSelection.make([1], nmols=1), AtomSelection.make([2, 3, 4], nmols=3))
    with pytest.warns(UserWarning, match="random"):
        engine.mddf(t.system(Options(n_random_samples=1)))
