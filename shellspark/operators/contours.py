"""Isolines of a residue map: marching squares over its grid, and the segments linked into lines.

A cell of the grid is four neighbouring values (two residues, two distances).  Each level that passes through it gives one or two segments between
points on the cell's sides, placed linearly, with the higher values on the left.  So a point is the end of at most one segment and the
beginning of at most one, and lines are chains of points: they are numbered by pointer jumping, in as many joins as the logarithm of
the longest line; closed lines are first opened at their least point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import settled

#: From which side to which a segment goes, by the corners that are at the level or above it: 1 first residue and distance, 2 second
#: residue, 4 both second, 8 second distance.  Sides: B, R, T, L.  The two cases with opposite corners depend on the cell's mean.
SEGMENTS = {1: "BL", 2: "RB", 3: "RL", 4: "TR", 6: "TB", 7: "TL", 8: "LT", 9: "BT", 11: "RT", 12: "LR", 13: "BR", 14: "LB"}
SADDLES = {(5, True): ("BR", "TL"), (5, False): ("BL", "TR"), (10, True): ("LB", "RT"), (10, False): ("RB", "LT")}


def levels_of(table: DataFrame, n: int | None = None) -> list[float]:
    """n levels evenly inside the range of values; of a range with both signs, which is made symmetric, 12, else 5."""
    r = table.agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
    if r.a is None or r.a == r.b:
        return []
    low, high = (-max(-r.a, r.b), max(-r.a, r.b)) if r.a < 0 < r.b else (r.a, r.b)
    n = n or (12 if r.a < 0 < r.b else 5)
    return [low + (high - low) * (k + 0.5) / n for k in range(n)]


def bands(table: DataFrame, levels: list[float]) -> DataFrame:
    """The map with the number of levels that each value reaches: what a filled plot colours."""
    reached = [(F.col("value") >= F.lit(float(x))).cast("int") for x in levels]
    return table.withColumn("band", sum(reached, F.lit(0)))


def segments(table: DataFrame, levels: list[float]) -> DataFrame:
    """level, a and b (keys of the end points), x0, d0, x1, d1: residue position and distance of the ends."""
    spark = table.sparkSession
    if not levels:
        kinds = "level double, a string, b string, x0 double, d0 double, x1 double, d1 double"
        return spark.createDataFrame([], kinds)
    across = Window.partitionBy("bin").orderBy("residue_pos")
    up = Window.partitionBy("residue_pos").orderBy("bin")
    rows = table.select("residue_pos", "bin", "d", F.col("value").alias("v1"))
    rows = rows.withColumns({"x": F.lead("residue_pos").over(across), "v2": F.lead("v1").over(across)})
    rows = rows.withColumns({"e": F.lead("d").over(up), "up": F.lead("bin").over(up), "v8": F.lead("v1").over(up), "v4": F.lead("v2").over(up)})
    rows = rows.where("x is not null and e is not null and v4 is not null")
    rows = rows.withColumn("level", F.explode(F.array(*(F.lit(float(x)) for x in levels))))
    high = {k: F.col(f"v{k}") >= F.col("level") for k in (1, 2, 4, 8)}
    case = sum((h.cast("int") * k for k, h in high.items()), F.lit(0))
    mean = (F.col("v1") + F.col("v2") + F.col("v4") + F.col("v8")) / 4 >= F.col("level")
    rows = rows.withColumns({"case": case, "mean": mean}).where("case not in (0, 15)")
    at = lambda p, q: (F.col("level") - F.col(f"v{p}")) / (F.col(f"v{q}") - F.col(f"v{p}"))
    left, right, low, top = F.col("residue_pos").cast("double"), F.col("x").cast("double"), F.col("d"), F.col("e")
    between = lambda u, v, t: u + (v - u) * t
    name = lambda *parts: F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    point = lambda key, x, d: F.struct(key.alias("key"), x.alias("x"), d.alias("d"))
    sides = {
        "B": point(name("h", F.col("residue_pos"), F.col("bin")), between(left, right, at(1, 2)), low),
        "T": point(name("h", F.col("residue_pos"), F.col("up")), between(left, right, at(8, 4)), top),
        "L": point(name("v", F.col("residue_pos"), F.col("bin")), left, between(low, top, at(1, 8))),
        "R": point(name("v", F.col("x"), F.col("bin")), right, between(low, top, at(2, 4))),
    }
    both = lambda way: F.struct(sides[way[0]].alias("a"), sides[way[1]].alias("b"))
    found = F.lit(None)
    for k, way in SEGMENTS.items():
        found = F.when(F.col("case") == k, F.array(both(way))).otherwise(found)
    for (k, above), ways in SADDLES.items():
        found = F.when((F.col("case") == k) & (F.col("mean") == above), F.array(*map(both, ways))).otherwise(found)
    out = rows.select("level", F.explode(found).alias("s"))
    return out.select("level", F.col("s.a.key").alias("a"), F.col("s.b.key").alias("b"), F.col("s.a.x").alias("x0"), F.col("s.a.d").alias("d0"), F.col("s.b.x").alias("x1"), F.col("s.b.d").alias("d1"))


def lines(found: DataFrame) -> DataFrame:
    """level, line (the key of its first point), place (from 1), residue, d and closed, from segments; a closed line ends where it begins."""
    found = settled(found, "segments")
    points = found.select("level", F.col("a").alias("key"), F.col("x0").alias("x"), F.col("d0").alias("d"))
    points = settled(points.union(found.select("level", "b", "x1", "d1")).groupBy("level", "key").agg(F.first("x").alias("x"), F.first("d").alias("d")), "points")
    following = found.select("level", F.col("a").alias("key"), F.col("b").alias("next"))
    now = settled(points.select("level", "key").join(following, ["level", "key"], "left").withColumn("least", F.col("key")), "chain")
    total = points.count()
    # The least point ahead within 1, 2, 4 ... steps; in a closed line the pointers never end, and in the end all know the line's least.
    for _ in range(max(1, total).bit_length()):
        ahead = now.select("level", F.col("key").alias("next"), F.col("next").alias("far"), F.col("least").alias("other"))
        now = now.join(ahead, ["level", "next"], "left").select("level", "key", F.col("far").alias("next"), F.least("least", F.coalesce("other", "least")).alias("least"))
        now = settled(now, "chain")
        if not now.where("next is not null").limit(1).count():
            break
    closed = now.where("next is not null").select("level", "key", F.lit(True).alias("closed"), "least")
    opened = following.join(closed.select("level", F.col("least").alias("next")).distinct(), ["level", "next"], "left_anti")
    # How many points are ahead of each, and the last one: the same jumps, with distances.
    steps = points.select("level", "key").join(opened, ["level", "key"], "left")
    now = steps.select("level", "key", "next", F.coalesce("next", "key").alias("last"), F.col("next").isNotNull().cast("long").alias("ahead"))
    now = settled(now, "chain")
    while now.where("next is not null").limit(1).count():
        far = now.select("level", F.col("key").alias("next"), F.col("next").alias("far"), F.col("last").alias("end"), F.col("ahead").alias("more"))
        now = now.join(far, ["level", "next"], "left")
        now = now.select("level", "key", F.col("far").alias("next"), F.coalesce("end", "last").alias("last"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead"))
        now = settled(now, "chain")
    sizes = now.groupBy("level", "last").agg(F.max("ahead").alias("most"), F.max_by("key", "ahead").alias("line"))
    rows = now.join(sizes, ["level", "last"]).join(points, ["level", "key"]).join(closed.select("level", "key", "closed"), ["level", "key"], "left")
    rows = rows.select("level", "line", (F.col("most") - F.col("ahead") + 1).alias("place"), F.col("x").alias("residue"), "d", F.coalesce("closed", F.lit(False)).alias("closed"), "most")
    again = rows.where("closed and place = 1").withColumn("place", F.col("most") + 2)
    return rows.union(again).drop("most")
