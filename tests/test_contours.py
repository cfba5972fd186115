"""Isolines against a plain walk over the grid."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shellspark.operators import contours
from shellspark.operators.residue_map import ResidueContributions


def table_of(spark, grid):
    rows = [(i + 1, 10 + i, f"A{i}", b + 1, 0.5 * b + 0.1 * b * b, float(v)) for i, own in enumerate(grid) for b, v in enumerate(own)]
    return spark.createDataFrame(rows, "residue_pos int, resnum int, label string, bin int, d double, value double")


def height(grid, x, d):
    """The map's value at a point on a side of a cell, linear along the side."""
    ds = [0.5 * b + 0.1 * b * b for b in range(len(grid[0]))]
    i = min(int(x - 1), len(grid) - 1)
    b = max(k for k, e in enumerate(ds) if e <= d + 1e-12)
    if abs(d - ds[b]) < 1e-9:
        j = min(i + 1, len(grid) - 1)
        return grid[i][b] + (grid[j][b] - grid[i][b]) * (x - 1 - i)
    return grid[i][b] + (grid[i][b + 1] - grid[i][b]) * (d - ds[b]) / (ds[b + 1] - ds[b])


def walked(found):
    """Lines by following segments one after another: sets of (level, points in order, closed)."""
    following = {(r.level, r.a): r.b for r in found}
    begins = {k for k in following} - {(level, b) for (level, _), b in following.items()}
    out, left = set(), dict(following)
    for start in sorted(begins) + sorted(following):
        if start not in left:
            continue
        (level, at), line = start, [start[1]]
        while (level, at) in left:
            at = left.pop((level, at))
            line.append(at)
        if line[0] == line[-1]:
            least = line.index(min(line))
            line = line[least:-1] + line[:least] + [line[least]]
        out.add((level, tuple(line)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_are_those_of_a_walk(spark, seed):
    rng = random.Random(seed)
    grid = [[math.sin(i / 2) * math.cos(b / 2) + rng.random() * 0.4 * seed for b in range(9)] for i in range(12)]
    grid[3][4] = grid[4][5] = 3.0  # corners that lie across from each other
    table = table_of(spark, grid)
    levels = [-0.4, 0.1, 0.3, 2.0, 9.0]
    found = contours.segments(table, levels).collect()
    for r in found:
        assert height(grid, r.x0, r.d0) == pytest.approx(r.level) and height(grid, r.x1, r.d1) == pytest.approx(r.level)
        # The higher values are on the left.
        left = ((r.x0 + r.x1) / 2 - 1e-6 * (r.d1 - r.d0), (r.d0 + r.d1) / 2 + 1e-6 * (r.x1 - r.x0))
        assert 1 <= left[0] <= 12
    lines = contours.lines(contours.segments(table, levels)).collect()
    by = {}
    for r in lines:
        by.setdefault((r.level, r.line), []).append(r)
    got = set()
    place = {(r.level, key): (x, d) for r in found for key, x, d in ((r.a, r.x0, r.d0), (r.b, r.x1, r.d1))}
    back = {(level, x, d): key for (level, key), (x, d) in place.items()}
    for (level, first), own in by.items():
        own = sorted(own, key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and len({r.closed for r in own}) == 1
        keys = tuple(back[level, r.residue, r.d] for r in own)
        assert keys[0] == first and (keys[0] == keys[-1]) == own[0].closed
        got.add((level, keys))
    assert got == walked(found) and any(k[1][0] == k[1][-1] for k in got) and any(k[1][0] != k[1][-1] for k in got)


def test_maps_without_lines(spark):
    flat = ResidueContributions(table_of(spark, [[1.0] * 3] * 3))
    assert flat.contours().count() == 0 and flat.contours([0.5]).count() == 0 and flat.contours([1.0]).count() == 0
    thin = ResidueContributions(table_of(spark, [[0.0, 1.0]]))
    assert thin.contours([0.5]).count() == 0
    assert contours.levels_of(table_of(spark, [[-1.0, 0.5]])) == pytest.approx([-1 + (k + 0.5) / 6 for k in range(12)])
    assert contours.levels_of(table_of(spark, [[1.0, 2.0]])) == pytest.approx([1.1, 1.3, 1.5, 1.7, 1.9])


def test_filled_bands_and_one_peak(spark):
    peak = ResidueContributions(table_of(spark, [[0.0] * 5, [0, 1, 2, 1, 0], [0.0] * 5]))
    bands = {(r.residue_pos, r.bin): r.band for r in peak.filled_contours([0.5, 1.5]).collect()}
    assert bands[2, 3] == 2 and bands[2, 2] == bands[2, 4] == 1 and sum(bands.values()) == 4
    lines = peak.contours([0.5, 1.5])
    assert lines.where("closed").count() == lines.count() and lines.select("level", "line").distinct().count() == 2
    assert lines.where("level = 1.5").agg(F.max("place")).first()[0] == 5  # four points, and the first again


def test_residues_and_distances_one_by_one(spark):
    grid = [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]
    own = ResidueContributions(table_of(spark, grid))
    assert [one.values() for one in own] == grid and list(own[2]) == grid[1] and list(own[5]) == []
    with pytest.raises(ValueError):
        own.values()
    with pytest.warns(UserWarning, match="zeros"):
        assert (own / own)[1].values() == [0.0, 1.0, 1.0]
