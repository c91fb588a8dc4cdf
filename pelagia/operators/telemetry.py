"""Run telemetry: weighted sums, and scans over blocks of a run, so that no run is gathered, sorted or summed by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pelagia.operators.scans import BLOCK, by_block, carried, halo, numbered
from pelagia.session import written


def ema(df: DataFrame, a: float) -> DataFrame:
    """Last exponential mean of each run of steps 1, 2, ..., seeded with its first value: the sum of the values by their
    weights in it, so a run is summed map-side and never gathered."""
    ends = written(df.groupBy("run").agg(F.max("step").alias("_n")))
    share = F.when(F.col("step") == 1, 1.0).otherwise(a)
    weight = share * F.pow(F.lit(1 - a), F.col("_n") - F.col("step"))
    return df.join(ends, "run").select("run", (weight * F.col("value")).alias("_w")).groupBy("run").agg(F.sum("_w").alias("ema"))


def rolling_trend(df: DataFrame, size: int = 200, least: int = 10, bound: float = 3.0, block: int = BLOCK) -> DataFrame:
    """(mean of the second half - mean of the first) / (|mean| + 1e-8) of the last ``size`` values, clipped; 0 under ``least``. Means are
    differences of running sums that start anew in each block (with ``size`` rows before it), so long runs lose no digits; the
    first ``size`` rows of a run look up the sum at half their number."""
    if block < size:
        raise ValueError("a block must hold a window")
    rows = halo(numbered(df.select("run", "step", "value"), ["run"], ["step"]), size, 0, block)
    w = by_block(["run"])
    sums = rows.withColumn("s", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lagged = sums.withColumns({"h": F.lag("s", size - size // 2).over(w), "z": F.coalesce(F.lag("s", size).over(w), F.lit(0.0))}).where("_own")
    half = sums.where((F.col("_b") == 0) & (F.col("_g") < size // 2)).select("run", (F.col("_g") + 1).alias("_half"), F.col("s").alias("_h"))
    early = lagged.where(F.col("_g") < size - 1).withColumn("_half", F.floor((F.col("_g") + 1) / 2)).join(half, ["run", "_half"], "left")
    early = early.select("run", "step", "s", F.coalesce("_h", F.lit(0.0)).alias("h"), F.lit(0.0).alias("z"), (F.col("_g") + 1).alias("n"))
    every = lagged.where(F.col("_g") >= size - 1).select("run", "step", "s", "h", "z", F.lit(size).cast("long").alias("n")).unionByName(early)
    k = F.floor(F.col("n") / 2)
    first, second = (F.col("h") - F.col("z")) / F.greatest(k, F.lit(1)), (F.col("s") - F.col("h")) / (F.col("n") - k)
    trend = (second - first) / (F.abs((F.col("s") - F.col("z")) / F.col("n")) + 1e-8)
    return every.select("run", "step", F.when(F.col("n") < least, 0.0).otherwise(F.greatest(F.lit(-bound), F.least(F.lit(bound), trend))).alias("trend"))


def gae(df: DataFrame, gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """Generalised advantage at each run's first step, the sum of (gamma lam)^(step - 1) (value / 100 + gamma next - value): each
    value is weighted as a step's own and as the next of the step before, so a run is summed map-side."""
    fade = F.pow(F.lit(gamma * lam), F.col("step") - 1)
    as_next = F.when(F.col("step") > 1, gamma * fade / (gamma * lam)).otherwise(0.0)
    return df.groupBy("run").agg(F.sum(F.col("value") * ((0.01 - 1) * fade + as_next)).alias("gae"))


def regions(df: DataFrame, mask: Column) -> DataFrame:
    """Maximal runs of steps with the mask: run, start, end (exclusive)."""
    kept = numbered(df.where(mask).select("run", "step"), ["run"], ["step"]).withColumn("island", F.col("step") - F.col("_g"))
    return kept.groupBy("run", "island").agg(F.min("step").alias("start"), (F.max("step") + 1).alias("end")).drop("island")


def gaps(df: DataFrame, key: str, number: str, block: int = BLOCK) -> DataFrame:
    """Consecutive numbers of a key more than one apart: key, at, to."""
    rows = halo(numbered(df.select(key, number), [key], [number]), 0, 1, block)
    found = rows.select(key, "_own", F.col(number).alias("at"), F.lead(number).over(by_block([key])).alias("to"))
    return found.where("_own and to - at > 1").drop("_own")


def best_checkpoints(df: DataFrame, score: str, valid: Column, block: int = BLOCK) -> DataFrame:
    """Rows whose score is over that of every earlier valid row of the run."""
    kept = carried(numbered(df.where(valid), ["run"], ["step"]), ["run"], {"_top": F.max(score)}, {"_top": "max"}, block)
    top = F.greatest(F.col("_top"), F.max(score).over(by_block(["run"]).rowsBetween(Window.unboundedPreceding, -1)))  # skips nulls
    return kept.withColumn("_top", top).where(F.col("_top").isNull() | (F.col(score) > F.col("_top"))).drop("_top", "_g", "_b")


def running(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds peak (running maximum) and energy (running sum of value / 3600)."""
    joule = F.col("value") / 3600
    rows = carried(numbered(df, ["run"], ["step"]), ["run"], {"_peak": F.max("value"), "_energy": F.sum(joule)}, {"_peak": "max", "_energy": "sum"}, block)
    w = by_block(["run"]).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({"peak": F.greatest(F.col("_peak"), F.max("value").over(w)), "energy": F.coalesce("_energy", F.lit(0.0)) + F.sum(joule).over(w)})
    return found.drop("_peak", "_energy", "_g", "_b")


def settled(df: DataFrame, within: float = 1.0) -> DataFrame:
    """run, at: the first step whose value is near the run's mean; the step after the last where none is."""
    level = written(df.groupBy("run").agg(F.avg("value").alias("level"), F.max("step").alias("last")))
    near = F.when(F.abs(F.col("value") - F.col("level")) < within, F.col("step")).otherwise(F.col("last") + 1)
    return df.join(level, "run").select("run", near.alias("at")).groupBy("run").agg(F.min("at").alias("at"))
