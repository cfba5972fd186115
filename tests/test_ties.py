"""Distances that are equal bit by bit with the SQL's, and numbers with the digits of C."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from shellspark.functions import scalars as sc
from shellspark.operators import pairs as pr


def test_equal_distances_are_those_of_plain_differences(spark):
    """On a lattice many distances of a pair of molecules are equal but for rounding; the SQL's arithmetic decides which atoms are closest."""
    rng = np.random.default_rng(5)
    spot = lambda: [float(rng.integers(0, 6000)) / 100 + float(rng.integers(-n, n + 1)) / n for n in (20, 18, 21)]
    near = lambda x: [e + float(rng.choice([-1, 0, 1])) * float(rng.integers(0, n + 1)) / n for e, n in zip(x, (20, 18, 21), strict=True)]
    a, b = [], []
    for k in range(300):
        x = spot()
        y = near(x)
        move = [60.0 * float(rng.integers(-1, 2)) for _ in range(3)]
        a += [(1, k, k, t + 1, 3 * k + t, *(e + (0.0 if t < 1 else d) for e, d in zip(x, (0.3, -0.3, 0.3 * t), strict=True))) for t in range(3)]
        b += [(1, k, k, t + 1, 3 * k + t, *(e + w + (0.0 if t < 1 else d) for e, w, d in zip(y, move, (-0.3, 0.3 * t, 0.3), strict=True))) for t in range(3)]
    columns = lambda s: f"frame int, {s}mol long, {s}idx long, {s}atype long, {s}atom long, {s}x double, {s}y double, {s}z double"
    frames = spark.createDataFrame([(1, [60.0, 0.0, 0.0, 0.0, 60.0, 0.0, 0.0, 0.0, 60.0])], "frame int, m array<double>")
    s, v = spark.createDataFrame(a, columns("s")), spark.createDataFrame(b, columns("v"))
    found = {(r.smol, r.vmol): (r.d, r.i, r.j) for r in pr.min_distance(pr.range_join(s, v, frames, 10.0), 1).collect()}
    p, q = np.array([r[5:] for r in a]), np.array([r[5:] for r in b])
    d = q[None] - p[:, None]
    d = d - 60.0 * np.floor(d / 60.0 + 0.5)
    d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
    expected = {}
    for i, j in zip(*np.nonzero(d2 <= 100.0), strict=True):
        own = (float(np.sqrt(d2[i, j])), a[i][4], b[j][4])
        key = (a[i][1], b[j][1])
        expected[key] = min(expected.get(key, own), own)
    assert found == expected


def test_numbers_are_rounded_from_their_binary_values(spark):
    """Each is a tie in its shortest decimal, and most are not in binary."""
    values = [0.00000005, 0.00390625, 1.00000005, 123.45678905, 123.45678915, 997.99999995, 1234.565, 10000.05, -2.00000015, 0.0, -998.0, float("nan"), float("inf")]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([*values, None])], "k int, x double")
    got = {r.k: r.text for r in rows.select("k", sc.formatted(F.col("x")).alias("text")).collect()}
    con = duckdb.connect()
    sql = "SELECT CASE WHEN abs(x) < 998 THEN printf('%12.7f', x) ELSE printf('%12.5e', x) END FROM (SELECT ?::DOUBLE AS x)"
    assert got == {k: con.execute(sql, [x]).fetchone()[0] for k, x in enumerate([*values, None])}
