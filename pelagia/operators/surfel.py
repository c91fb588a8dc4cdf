"""Flat splats (surfels): the ray transform, its bound, and the sigma of the ray's intersection with the splat's plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pelagia.functions import geometry as G


def project(pairs: DataFrame, near: float = 0.01, far: float = 1e10) -> DataFrame:
    """Adds t00 .. t22 (the rows map plane coordinates and 1 to image coordinates times depth), u, v, radius (0: culled), depth
    and the normal nx, ny, nz that faces the camera."""
    m = G.quat_to_rotmat(*(F.col(c) for c in ("qw", "qx", "qy", "qz")))
    df = pairs.withColumns({f"m{i}": c for i, c in enumerate(m)})
    ca, sa = F.col("ca"), F.col("sa")
    turn = lambda x, y, z: (ca * x + sa * z, y, -sa * x + ca * z)
    axes = [turn(*(F.col(f"m{i}") * F.col("sx") for i in (0, 3, 6))), turn(*(F.col(f"m{i}") * F.col("sy") for i in (1, 4, 7)))]
    p = [c + t for c, t in zip(turn(F.col("x"), F.col("y"), F.col("z")), (F.col("tx"), F.col("ty"), F.col("tz")), strict=True)]
    n = turn(*(F.col(f"m{i}") for i in (2, 5, 8)))
    image = lambda a: (F.col("fx") * a[0] + F.col("cx") * a[2], F.col("fy") * a[1] + F.col("cy") * a[2], a[2])
    faces = n[0] * p[0] + n[1] * p[1] + n[2] * p[2]
    df = df.withColumns({**{f"t{k}{i}": c for i, a in enumerate((*axes, p)) for k, c in enumerate(image(a))}, **{f"n{a}": F.when(faces < 0, c).otherwise(-c) for a, c in zip("xyz", n, strict=True)}, "depth": F.round(p[2], 9)})
    # the conic of the unit circle on the plane
    dot = lambda r, s: F.col(f"t{r}0") * F.col(f"t{s}0") + F.col(f"t{r}1") * F.col(f"t{s}1") - F.col(f"t{r}2") * F.col(f"t{s}2")
    df = df.withColumn("_d", dot(2, 2)).withColumn("_ok", F.abs("_d") > 1e-6).withColumn("_d", F.when(F.col("_ok"), F.col("_d")).otherwise(1.0))
    df = df.withColumns({"u": F.round(dot(0, 2) / F.col("_d"), 9), "v": F.round(dot(1, 2) / F.col("_d"), 9), "_e0": dot(0, 0) / F.col("_d"), "_e1": dot(1, 1) / F.col("_d")})
    half = lambda c, e: F.sqrt(F.greatest(F.lit(1e-4), F.col(c) * F.col(c) - F.col(e)))
    radius = F.ceil(F.round(3 * F.greatest(half("u", "_e0"), half("v", "_e1")), 6)).cast("int")
    seen = F.col("_ok") & (F.col("depth") > near) & (F.col("depth") < far)
    inside = (F.col("u") + radius > 0) & (F.col("u") - radius < F.col("width")) & (F.col("v") + radius > 0) & (F.col("v") - radius < F.col("height"))
    return df.withColumn("radius", F.when(seen & inside, radius).otherwise(0)).drop("_d", "_ok", "_e0", "_e1", *(f"m{i}" for i in range(9)))


def pixel_pairs(tiled: DataFrame, least_alpha: float = 1 / 255) -> DataFrame:
    """(splat, pixel) pairs: sigma from the point where the pixel's ray meets the splat's plane, or from the distance on the screen
    where that is less; alpha."""
    t = F.col("tile")
    df = tiled.withColumn("py", F.explode(F.sequence(F.col("tile_y") * t, F.least((F.col("tile_y") + 1) * t, F.col("height")) - 1)))
    df = df.withColumn("px", F.explode(F.sequence(F.col("tile_x") * t, F.least((F.col("tile_x") + 1) * t, F.col("width")) - 1)))
    at = {"a": F.col("px") + 0.5, "b": F.col("py") + 0.5}
    plane = lambda row, k: [k * F.col(f"t2{i}") - F.col(f"t{row}{i}") for i in range(3)]
    a, b = plane(0, at["a"]), plane(1, at["b"])
    df = df.withColumns({f"_x{i}": a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)})
    w = F.col("_x2")
    ray: Column = F.when(w != 0, (F.col("_x0") * F.col("_x0") + F.col("_x1") * F.col("_x1")) / F.when(w != 0, w * w).otherwise(1.0))
    dx, dy = at["a"] - F.col("u"), at["b"] - F.col("v")
    df = df.withColumn("sigma", F.round(0.5 * F.least(ray, 2 * (dx * dx + dy * dy)), 9)).drop("_x0", "_x1", "_x2")
    df = df.withColumn("alpha", F.round(F.least(F.lit(0.999), F.col("o") * F.exp(-F.col("sigma"))), 9))
    return df.where(F.col("alpha") >= round(least_alpha, 9))


def composite(weighted: DataFrame) -> DataFrame:
    """cam, px, py with colour, alpha, depth sums, the normal, the median depth and the distortion (twice the sum of
    w_i w_j (depth_i - depth_j) over pairs in order of depth)."""
    before = Window.partitionBy("cam", "px", "py").orderBy("depth", "gid").rowsBetween(Window.unboundedPreceding, -1)
    df = weighted.withColumn("w", F.col("alpha") * F.col("t"))
    df = df.withColumns({"_a": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "_d": F.coalesce(F.sum(F.col("w") * F.col("depth")).over(before), F.lit(0.0))})
    w = F.col("w")
    sums = {"r": w * F.col("r"), "a": w, "d": w * F.col("depth"), **{f"n{c}": w * F.col(f"n{c}") for c in "xyz"}, "distortion": 2 * w * (F.col("depth") * F.col("_a") - F.col("_d"))}
    return df.groupBy("cam", "px", "py").agg(*(F.sum(c).alias(n) for n, c in sums.items()), F.max(F.when(F.round("t", 9) > 0.5, F.col("depth"))).alias("median"))
