"""Maintenance of the splat table: each edit is a plan from one table to the next, with one pass and no per-row code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def grad_stats(observations: DataFrame) -> DataFrame:
    return observations.groupBy("gid").agg(F.sum("grad").alias("grad"), F.count("*").alias("n"), F.max("radius").alias("radius"))


def policy(splats: DataFrame, stats: DataFrame, grow: float, small: float, least: float) -> DataFrame:
    """Adds action: prune under the least opacity, else clone (small) or split (large) over the mean gradient ``grow``, else keep."""
    df = splats.join(stats.select("gid", F.round(F.col("grad") / F.col("n"), 9).alias("mean_grad")), "gid", "left")
    size, grows = F.greatest("sx", "sy", "sz"), F.col("mean_grad") > grow
    return df.withColumn("action", F.when(F.col("o") < least, "prune").when(grows & (size <= small), "clone").when(grows, "split").otherwise("keep"))


def grown(acted: DataFrame) -> DataFrame:
    """The next table: clones are copied, splits become two smaller children, pruned rows go. One pass, no union."""
    copies = F.when(F.col("action") == "prune", 0).when(F.col("action").isin("clone", "split"), 2).otherwise(1)
    child = acted.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    return child.withColumns({c: F.when(F.col("action") == "split", F.col(c) / 1.6).otherwise(F.col(c)) for c in ("sx", "sy", "sz")})


def duplicate(df: DataFrame, mask: Column) -> DataFrame:
    """The rows, and copies of the masked ones; adds copy (0 or 1)."""
    return df.withColumn("copy", F.explode(F.when(mask, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


def quantise(df: DataFrame, column: str, bits: int) -> DataFrame:
    """Adds q, low, high: the column on a grid of 2**bits levels between its extremes, half to even."""
    box = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    wide = df.crossJoin(F.broadcast(box))  # one row
    share = F.coalesce(F.try_divide(F.col(column) - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    return wide.withColumn("q", F.rint(share * (2**bits - 1)).cast("int"))


def dequantise(df: DataFrame, bits: int) -> DataFrame:
    return df.withColumn("back", F.col("q") / float(2**bits - 1) * (F.col("high") - F.col("low")) + F.col("low"))


def poses_bounds(cameras: DataFrame, depths: DataFrame, key: str, shares: tuple[float, float] = (0.01, 0.99), else_: tuple[float, float] = (0.1, 100.0)) -> DataFrame:
    """``key``, m0 .. m14, near, far: of each camera (r0 .. r8 its turned axes by rows, tx, ty, tz, height, width, fx) the 3 x 5 matrix by
    rows, and the depths at ``shares`` of those that it sees (``else_`` where it sees none). The depths are counted, not sorted."""
    from pelagia.operators.selection import quantiles

    bounds = quantiles(depths, [key], "depth", list(shares)).select(key, F.get("q", F.lit(0)).alias("near"), F.get("q", F.lit(1)).alias("far"))
    side = [("tx", "height"), ("ty", "width"), ("tz", "fx")]
    matrix = [F.col(c).cast("double").alias(f"m{5 * row + k}") for row in range(3) for k, c in enumerate((*(f"r{3 * row + i}" for i in range(3)), *side[row]))]
    return cameras.join(bounds, key, "left").select(key, *matrix, F.coalesce("near", F.lit(else_[0])).alias("near"), F.coalesce("far", F.lit(else_[1])).alias("far"))
