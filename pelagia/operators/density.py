"""Growing and thinning of splat tables: splits, clones, relocation, sampled additions, culling.

Every edit is a projection of the table, an explode to children, or a join with drawn ids; random numbers are hashes, so a retried
task makes the same splats. ``child`` tells the copies of one splat apart: 0 is the splat itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pelagia.functions import geometry as G
from pelagia.operators.extended import normal, weighted_sample
from pelagia.operators.pixels import indexed
from pelagia.session import written

SCALES = ("sx", "sy", "sz")
#: Splats that share one place count as this many at most.
MOST_SHARED = 51


def largest() -> Column:
    return F.greatest(*SCALES)


def scattered(child: str = "child", seed: str = "split") -> dict[str, Column]:
    """x, y, z moved by a normal step within the splat's own ellipsoid."""
    step = [F.col(s) * normal(f"{seed}:{s}", "gid", child) for s in SCALES]
    moved = G.matvec(G.quat_to_rotmat(*(F.col(c) for c in ("qw", "qx", "qy", "qz"))), step)
    return {c: F.col(c) + m for c, m in zip("xyz", moved, strict=True)}


def split(splats: DataFrame, mask: Column, shrink: float = 1.6) -> DataFrame:
    """Masked splats are replaced by children 1 and 2 with shrunk scales, scattered within them."""
    df = splats.withColumn("child", F.explode(F.when(mask, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))
    new = F.col("child") > 0
    at = {c: F.when(new, m).otherwise(F.col(c)) for c, m in scattered().items()}
    return df.withColumns({**at, **{s: F.when(new, F.col(s) / shrink).otherwise(F.col(s)) for s in SCALES}})


def shared(o: Column, n: Column) -> tuple[Column, Column]:
    """Opacity of each of n splats in the place of one of opacity o, and the factor of their scales, which together keep the
    place's rendering: p = 1 - (1 - o)^(1/n), and o over the sum of (-1)^(j-1) C(n, j) p^j / sqrt(j) for j from 1 to n."""
    p = 1 - F.pow(1 - o, 1 / n)
    first = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("s"))

    def term(acc: Column, j: Column) -> Column:
        c = acc["c"] * (n - j + 1) / j
        return F.struct(c.alias("c"), (acc["s"] + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * c * F.pow(p, j) / F.sqrt(j)).alias("s"))

    return p, o / F.aggregate(F.sequence(F.lit(1), n.cast("int")), first, term, lambda acc: acc["s"])


def _thinned(splats: DataFrame, draws: DataFrame, least: float) -> DataFrame:
    """Splats drawn k times take the opacity and scales of one of k + 1 that share their place."""
    counts = draws.groupBy("gid").agg(F.count("*").alias("_k"))
    df = splats.join(counts, "gid", "left")
    n = F.least(F.coalesce("_k", F.lit(0)) + 1, F.lit(MOST_SHARED)).cast("double")
    p, factor = shared(F.col("o"), n)
    drawn = F.col("_k").isNotNull()
    p = F.greatest(F.least(p, F.lit(1 - 2.0**-23)), F.lit(least))
    return df.withColumns({"_f": F.when(drawn, factor).otherwise(1.0), "_p": F.when(drawn, p).otherwise(F.col("o"))}).withColumns({"o": F.col("_p"), **{s: F.col(s) * F.col("_f") for s in SCALES}}).drop("_k", "_f", "_p")


def relocated(splats: DataFrame, dead: float, least: float = 0.005) -> DataFrame:
    """Splats of opacity up to ``dead`` move to live ones drawn by opacity; all at one place share its opacity and scales."""
    gone = splats.where(F.col("o") <= dead)
    n = gone.count()
    if not n:
        return splats
    live = splats.where(F.col("o") > dead)
    draws = written(weighted_sample(live, "gid", "o", n, "relocate"))
    kept = written(_thinned(live, draws, least))
    slots = indexed(gone.select(F.col("gid").alias("slot")), "slot").withColumnRenamed("i", "draw")
    filled = slots.join(draws, "draw").join(kept, "gid").drop("gid", "draw").withColumnRenamed("slot", "gid")
    return kept.unionByName(filled)


def sample_added(splats: DataFrame, growth: float, cap: int, least: float = 0.005) -> DataFrame:
    """Append min(cap, growth * N) - N splats drawn by opacity, which share the place of their source; new ids follow the largest."""
    n, top = splats.agg(F.count("*"), F.max("gid")).first()
    more = min(cap, int(growth * n)) - n
    if more <= 0:
        return splats
    draws = written(weighted_sample(splats, "gid", "o", more, "add"))
    kept = written(_thinned(splats, draws, least))
    return kept.unionByName(draws.join(kept, "gid").withColumn("gid", F.col("draw") + int(top) + 1).drop("draw"))


def densified(splats: DataFrame, stats: DataFrame, extent: float, grow: float = 2e-4, dense: float = 0.01, least: float = 0.005, widest: float = 0.1) -> DataFrame:
    """Splats of a mean gradient (stats: gid, grad, n) of ``grow`` or more are cloned, or, where they are larger than ``dense`` of the
    scene, split; then those that are faint or larger than ``widest`` of the scene go."""
    df = splats.join(stats.select("gid", F.round(F.col("grad") / F.col("n"), 9).alias("_g")), "gid", "left")
    high, big = F.coalesce("_g", F.lit(0.0)) >= grow, largest() > dense * extent
    cloned = df.withColumns({"_split": high & big, "_n": F.explode(F.when(high & ~big, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))})
    grown = split(cloned, F.col("_split")).withColumn("child", F.col("child") + F.col("_n"))
    return grown.where((F.col("o") >= least) & (largest() <= widest * extent)).drop("_g", "_split", "_n")


def water_refined(
    splats: DataFrame, stats: DataFrame, step: int, side: int, *, grow: float, size: float, split_screen: float = 0.05, cull_screen: float = 0.15,
    cull_scale: float = 0.5, faint: float = 0.1, faint_after: float = 0.1, every: int = 100, reset_every: int = 30, views: int = 0,
    stop_split: int = 15_000, stop_screen: int = 4000, reset_to: float = 0.5,
) -> DataFrame:
    """One refinement step of an underwater scene. ``stats``: gid, grad, n, radius (largest share of the screen). Where the step is
    past a reset by more than ``views`` + ``every``, splats of a high gradient are split (two children; the parent is culled) or, where
    small, duplicated. Then the faint and, once opacities were reset, the too large go. Just after a reset opacities are
    bounded by ``reset_to``. Children and duplicates have no screen size yet."""
    cycle = reset_every * every
    grows, culls = step < stop_split and step % cycle > views + every, step >= stop_split
    df = splats.join(stats.select("gid", F.round(F.col("grad") / F.col("n") * 0.5 * side, 9).alias("_g"), F.col("radius").alias("_r")), "gid", "left")
    high, radius = F.coalesce("_g", F.lit(0.0)) > grow, F.coalesce("_r", F.lit(0.0))
    if grows:
        big = largest() > size
        wide = big | (radius > split_screen) if step < stop_screen else big
        # a split parent is shrunk before the small are sought: it is duplicated too where it is small by then
        df = df.withColumns({"_split": high & wide, "_r": radius}).withColumn("_s", F.when(F.col("_split"), 1.6).otherwise(1.0))
        df = df.withColumn("_n", F.explode(F.when(high & (largest() / F.col("_s") <= size), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        df = split(df, F.col("_split") & (F.col("_n") == 0)).withColumns({s: F.when(F.col("_n") > 0, F.col(s) / F.col("_s")).otherwise(F.col(s)) for s in SCALES}).withColumn("_r", F.when((F.col("child") > 0) | (F.col("_n") > 0), 0.0).otherwise(F.col("_r")))
        df = df.withColumn("child", F.col("child") + 3 * F.col("_n")).drop("_split", "_n", "_s")
    else:
        df = df.withColumns({"child": F.lit(0), "_r": radius})
    if grows or culls:
        gone = F.col("o") < (faint if step < stop_split else faint_after)
        if step > cycle:
            gone = gone | (largest() > cull_scale)
            gone = gone | (F.col("_r") > cull_screen) if step < stop_screen else gone
        df = df.where(~gone)
    if step < stop_split and step % cycle == every:
        df = df.withColumn("o", F.least("o", F.lit(reset_to)))
    return df.drop("_g", "_r")
