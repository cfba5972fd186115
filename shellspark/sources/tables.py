"""A trajectory made of relational tables: orders are molecules, their first three lines atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..options import Options
from ..plans.staging import settled
from ..plans.system import System

BOX, FRAMES = 60.0, 20
OPTIONS = {"dbulk": 8.0, "cutoff": 10.0, "usecutoff": True, "binstep": 0.1, "n_random_samples": 2}


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, mol, the order's customer and priority, whether it is a solute, and idx (its number in the frame among its side's); a row for each order of three lines."""
    whole = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    rows = whole.join(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("o_orderkey")
    rows = rows.select((1 + k % FRAMES).cast("int").alias("frame"), k.alias("mol"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), (k % 97 < 3).alias("is_solute"))
    return rows.withColumn("idx", F.dense_rank().over(Window.partitionBy("frame", "is_solute").orderBy("mol")).cast("bigint"))


def _lines(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """An order's lines with their places; lines that are equal in all three columns make the same atoms in any order, so no more of them is shuffled."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(where)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").withColumn("atype", F.row_number().over(order))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, mol, atype, atom, x, y, z, the order's priority, is_solute and idx."""
    lines = _lines(spark, sf_dir).where("atype <= 3").select("l_orderkey", "l_partkey", "l_suppkey", "atype")
    # Numbers are given to molecules, of which there are few rows, before their atoms join them.
    rows = lines.join(settled(molecules(spark, sf_dir), "numbers"), F.col("l_orderkey") == F.col("mol"))
    return _placed(rows)


def _placed(rows: DataFrame) -> DataFrame:
    k, c, p, s, t = (F.col(x) for x in ("mol", "customer", "l_partkey", "l_suppkey", "atype"))
    centre = lambda e: (e % 6000).cast("double") / F.lit(100.0)
    offset = lambda e, n, h: (e % n - h).cast("double") / F.lit(float(h))
    return rows.select("frame", "mol", "atype", (k * 3 + t - 1).alias("atom"), (centre(k * 7919) + offset(p, 41, 20)).alias("x"), (centre(k * 104729) + offset(s, 37, 18)).alias("y"), (centre(c * 15485863 + k * 31) + offset(p + t, 43, 21)).alias("z"), "priority", "is_solute", "idx")


def side_atoms(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """The atoms of a side, "s" or "v", without numbers of molecules in their frame (null), by one shuffle of its lines and one of its orders, and no table."""
    key = lambda c: f"{c} % 97 < 3" if side == "s" else f"{c} % 97 >= 3"
    lines = _lines(spark, sf_dir, key("l_orderkey")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))).where("n >= 3 and atype <= 3")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(key("o_orderkey")).select("o_orderkey", F.col("o_custkey").alias("customer"), F.lit(None).cast("string").alias("priority"))
    rows = lines.select("l_orderkey", "l_partkey", "l_suppkey", "atype").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumns({"mol": F.col("o_orderkey"), "frame": (1 + F.col("o_orderkey") % FRAMES).cast("int"), "is_solute": F.lit(side == "s"), "idx": F.lit(None).cast("bigint")})
    return _side(_placed(rows), side)


def frames(spark: SparkSession, sf_dir: str, weights: str = "1") -> DataFrame:
    """The frames that orders are in."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cell = F.array(*(F.lit(BOX if k % 4 == 0 else 0.0) for k in range(9)))
    own = orders.select((1 + F.col("o_orderkey") % FRAMES).cast("int").alias("frame")).distinct()
    return own.withColumn("w", F.expr(weights).cast("double")).withColumn("m", cell).withColumn("volume", F.lit(BOX**3))


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("frame", *(F.col(c).alias(side + c) for c in ("mol", "idx", "atype", "atom", "x", "y", "z")))


def system(spark: SparkSession, sf_dir: str, *, autocorrelation: bool = False, weights: str = "1", custom_groups: bool = False, every: DataFrame | None = None, **options) -> System:
    """Solutes: orders with key % 97 < 3; solvent: the others (with ``autocorrelation`` the solutes themselves).  ``every``: the atoms, if they have been written."""
    every = settled(atoms(spark, sf_dir), "atoms") if every is None else every
    solute = every.where("is_solute")
    solvent = solute if autocorrelation else every.where("not is_solute")
    n = [df.where("atype = 1").select("mol").distinct().count() / FRAMES for df in (solute, solvent)]
    groups = None
    if custom_groups:
        ids = F.substring("priority", 1, 1).cast("int")
        groups = every.select(F.when(F.col("mol") % 97 < 3, "solute").otherwise("solvent").alias("side"), ids.alias("group_id"), F.col("priority").alias("group_name"), "atom")
    o = Options(**(OPTIONS | options))
    return System(_side(solute, "s"), _side(solvent, "v"), settled(frames(spark, sf_dir, weights), "frames"), n[0], n[1], 3, 3, o, 1, True, autocorrelation, groups, files=(("tables", FRAMES),))
