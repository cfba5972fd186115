"""Unit cells and periodic distances.  A cell is an array of nine doubles: the vectors a, b and c."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_matrix(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Cell vectors from lengths and angles in degrees, a along x and b in the xy plane."""
    cosine = lambda x: F.when(x == 90, F.lit(0.0)).otherwise(F.cos(F.radians(x)))
    ca, cb, cg = cosine(alpha), cosine(beta), cosine(gamma)
    sg = F.when(gamma == 90, F.lit(1.0)).otherwise(F.sin(F.radians(gamma)))
    cy = (ca - cb * cg) / sg
    zero = F.lit(0.0)
    return F.array(a, zero, zero, b * cg, b * sg, zero, c * cb, c * cy, c * F.sqrt(1 - cb * cb - cy * cy))


def dcd_angles(alpha: Column, beta: Column, gamma: Column) -> tuple[Column, Column, Column]:
    """The angles, or right ones where any is zero."""
    none = (alpha == 0) | (beta == 0) | (gamma == 0)
    return tuple(F.when(none, F.lit(90.0)).otherwise(x) for x in (alpha, beta, gamma))


def volume(m: Column) -> Column:
    """(a x b) . c"""
    a, b, c = ([m[3 * k + i] for i in range(3)] for k in range(3))
    return (a[1] * b[2] - a[2] * b[1]) * c[0] + (a[2] * b[0] - a[0] * b[2]) * c[1] + (a[0] * b[1] - a[1] * b[0]) * c[2]


def is_orthorhombic(m: Column) -> Column:
    """No off-diagonal element beyond 1e-10 of the least diagonal one."""
    tol = F.lit(1e-10) * F.least(*(F.abs(m[k]) for k in (0, 4, 8)))
    return reduce(lambda x, y: x & y, (F.abs(m[k]) <= tol for k in (1, 2, 3, 5, 6, 7)))


def near(e: Column, length: Column) -> Column:
    """A difference moved into the cell around zero."""
    return e - length * F.floor(e / length + F.lit(0.5))


def fractions(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Coordinates along the cell vectors (Cramer's rule)."""
    a, b, c = ([m[3 * k + i] for i in range(3)] for k in range(3))
    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    dot = lambda u: u[0] * x + u[1] * y + u[2] * z
    v = volume(m)
    return dot(cross(b, c)) / v, dot(cross(c, a)) / v, dot(cross(a, b)) / v


def heights(m: Column) -> tuple[Column, Column, Column]:
    """Distances between opposite faces."""
    a, b, c = ([m[3 * k + i] for i in range(3)] for k in range(3))
    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    area = lambda u, v: F.sqrt(sum((t * t for t in cross(u, v)), F.lit(0.0)))
    v = F.abs(volume(m))
    return v / area(b, c), v / area(c, a), v / area(a, b)


def reduced_cell(m: list[float]) -> list[float]:
    """Three short vectors of the same lattice (Minkowski-reduced), longest last, with the handedness of the given ones."""
    v = np.array(m, float).reshape(3, 3)
    sign = np.sign(np.linalg.det(v))
    while True:
        v = v[np.argsort((v * v).sum(axis=1), kind="stable")]
        before = (v * v).sum()
        # The second by the first, then the third by the nearest point of the lattice of the two.
        v[1] -= np.rint(v[1] @ v[0] / (v[0] @ v[0])) * v[0]
        v[:2] = v[np.argsort((v[:2] * v[:2]).sum(axis=1), kind="stable")]
        near = np.rint(np.linalg.lstsq(v[:2].T, v[2], rcond=None)[0])
        options = [v[2] - (near[0] + i) * v[0] - (near[1] + j) * v[1] for i in (-1, 0, 1) for j in (-1, 0, 1)]
        v[2] = min(options, key=lambda x: x @ x)
        if (v * v).sum() >= before * (1 - 1e-12):
            break
    return (v if np.sign(np.linalg.det(v)) == sign else v * [[1], [1], [-1]]).ravel().tolist()


def reduced(cells: DataFrame) -> DataFrame:
    """frame and m with each cell reduced; a row for each frame."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [None if m is None else reduced_cell(m) for m in batch.column("m").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("frame"), pa.array(own, pa.list_(pa.float64()))], ["frame", "m"])

    kind = cells.schema["frame"].dataType.simpleString()
    return cells.select("frame", "m").mapInArrow(of, f"frame {kind}, m array<double>")


def nearest(m: Column, ortho: bool, dx: Column, dy: Column, dz: Column, within: bool = False) -> Column:
    """The shortest periodic image of a difference as a struct (x, y, z, d2).

    In a skewed cell rounding fractions is exact only for images within half of the least height; ``within`` says that no others
    matter.  Else the 27 images around the rounded one are compared, which is exact in a reduced cell.
    """
    if ortho:
        x, y, z = (near(e, m[k]) for e, k in ((dx, 0), (dy, 4), (dz, 8)))
        return F.struct((x * x + y * y + z * z).alias("d2"), x.alias("x"), y.alias("y"), z.alias("z"))

    def image(f, s=(0.0, 0.0, 0.0)):
        x, y, z = ((f[0] + s[0]) * m[t] + (f[1] + s[1]) * m[3 + t] + (f[2] + s[2]) * m[6 + t] for t in range(3))
        return F.struct((x * x + y * y + z * z).alias("d2"), x.alias("x"), y.alias("y"), z.alias("z"))

    if within:
        return image([g - F.floor(g + 0.5) for g in fractions(m, dx, dy, dz)])
    shifts = F.array(*(F.array(*(F.lit(float(t)) for t in (i, j, k))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    # The outer array binds the fractions, so that they are computed once for all images.
    rounded = F.array(F.array(*(g - F.floor(g + 0.5) for g in fractions(m, dx, dy, dz))))
    return F.transform(rounded, lambda f: F.array_min(F.transform(shifts, lambda s: image(f, s))))[0]


def euler(beta: Column, gamma: Column, theta: Column, degrees: bool = False) -> list[list[Column]]:
    """Rotation by beta around x, gamma around y and theta around z, put together as Rx(beta) Ry(gamma) Rz(theta)."""
    if degrees:
        beta, gamma, theta = (x * F.lit(math.pi / 180) for x in (beta, gamma, theta))
    (cx, sx), (cy, sy), (cz, sz) = ((F.cos(t), F.sin(t)) for t in (beta, gamma, theta))
    one, zero = F.lit(1.0), F.lit(0.0)
    rx = [[one, zero, zero], [zero, cx, -sx], [zero, sx, cx]]
    ry = [[cy, zero, sy], [zero, one, zero], [-sy, zero, cy]]
    rz = [[cz, -sz, zero], [sz, cz, zero], [zero, zero, one]]
    times = lambda p, q: [[sum((p[i][t] * q[t][j] for t in range(1, 3)), p[i][0] * q[0][j]) for j in range(3)] for i in range(3)]
    return times(times(rx, ry), rz)
