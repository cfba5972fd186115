"""Copies of the random reference that cannot be near their solute molecule are not made, and the system is numbered once."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from shellspark import registry
from shellspark.operators import pairs as pr
from shellspark.operators import random_reference as rr
from shellspark.plans import engine

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["plain", "skewed", "self", "broken"])
def test_near_copies_have_all_random_pairs(spark, kind):
    far = {"autocorrelation": True, "dbulk": 20.0, "cutoff": 25.0} if kind == "self" else {}
    s = registry.tables.system(spark, TABLES, **far).pruned()
    if kind == "skewed":
        cell = F.array(*(F.lit(float(x)) for x in registry.registry_sql.SKEWED))
        s = replace(s, ortho=False, frames=s.frames.withColumn("m", cell))
    if kind == "broken":  # atoms of a solute molecule are in other cells
        s = replace(s, solute=s.solute.withColumn("sx", F.col("sx") + 60 * (F.col("satype") - 2)))
    refs = rr.reference_solutes(s)
    bulk = rr.bulk_molecules(s, engine.reference_distances(s), refs)
    every = rr.slots(s, bulk)
    solute, moved = s.solute.join(refs, ["frame", "sidx"]), rr.random_move(every, rr.unwrapped(s), s.frames)
    expected = pr.min_distance(pr.range_join(solute, moved, s.frames, s.options.radius, s.ortho, ("frame", "k")), s.irefatom, ("frame", "k"), s.autocorrelation)
    own = ("frame", "k", "sidx", "vidx", "i", "j", "d", "d_ref")
    rows = lambda df: sorted(map(tuple, df.select(*own).na.fill(-1.0).collect()))
    got = rows(engine.random_distances(s))
    assert got == rows(expected) != []
    some = rr.slots(s, bulk, rr.surroundings(s, refs, 3.0))
    assert some.count() < every.count()
    assert some.join(every, every.columns, "left_anti").count() == 0


def test_molecules_are_numbered_once(spark):
    s = registry.tables.system(spark, TABLES)
    for side in (s.solute, s.solvent):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
