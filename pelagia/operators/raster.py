"""Splat rasterisation as relational algebra: project, cull, tile join, ordered compositing.

Cameras are a dimension table (a scene's poses; the caller checks that it is small, see ``project``), splats and pixels
are not: a projected splat meets only the tiles its box covers (``explode``), tiles meet their own pixels, and the
transmittance is a running product in a window by (camera, pixel), which Spark spills. The projected table is
materialised before it is exploded, so its expressions are evaluated once for a splat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pelagia.functions import geometry as G

#: Cameras beyond this number are joined without a broadcast.
BROADCAST_CAMERAS = 100_000


def cameras_by_splats(cams: DataFrame, splats: DataFrame) -> DataFrame:
    """Every camera with every splat: the model's own cross product; cameras are broadcast while they are few."""
    side = F.broadcast(cams) if cams.limit(BROADCAST_CAMERAS + 1).count() <= BROADCAST_CAMERAS else cams
    return splats.crossJoin(side)


def rotation_y() -> list[Column]:
    ca, sa, zero, one = F.col("ca"), F.col("sa"), F.lit(0.0), F.lit(1.0)
    return [ca, zero, sa, zero, one, zero, -sa, zero, ca]


def world_covariance() -> list[Column]:
    q = [F.col(c) for c in ("qw", "qx", "qy", "qz")]
    return G.covariance(G.quat_to_rotmat(*q), [F.col(c) for c in ("sx", "sy", "sz")])


COV = ("xx", "xy", "xz", "yy", "yz", "zz")


def to_camera(pairs: DataFrame) -> DataFrame:
    """Adds mx, my, mz (mean) and k_xx .. k_zz (covariance) in camera coordinates."""
    df = pairs.withColumns({f"w_{n}": c for n, c in zip(COV, world_covariance(), strict=True)})
    t = [F.col("tx"), F.col("ty"), F.col("tz")]
    mean = [a + b for a, b in zip(G.matvec(rotation_y(), [F.col("x"), F.col("y"), F.col("z")]), t, strict=True)]
    cov = G.rotated_covariance(rotation_y(), [F.col(f"w_{n}") for n in COV])
    return df.withColumns({**dict(zip(("mx", "my", "mz"), mean, strict=True)), **{f"k_{n}": c for n, c in zip(COV, cov, strict=True)}})


def project(pairs: DataFrame, near: float = 0.01, far: float = 1e10) -> DataFrame:
    """Adds u, v (image mean), ca_, cb_, cc_ (conic), depth and radius (0: culled)."""
    df = to_camera(pairs)
    mean, cov = [F.col(c) for c in ("mx", "my", "mz")], [F.col(f"k_{n}") for n in COV]
    fx, fy, cx, cy, w, h = (F.col(c) for c in ("fx", "fy", "cx", "cy", "width", "height"))
    safe = [mean[0], mean[1], F.when(F.abs(mean[2]) < 1e-6, 1e-6).otherwise(mean[2])]
    (u, v), cov2 = G.pinhole(safe, cov, fx, fy, cx, cy, w, h)
    df = df.withColumns({"u": F.round(u, 9), "v": F.round(v, 9), "c0": cov2[0], "c1": cov2[1], "c2": cov2[2], "depth": F.round("mz", 9)})
    conic, radius, comp = G.conic_radius([F.col("c0"), F.col("c1"), F.col("c2")])
    seen = (F.col("depth") > near) & (F.col("depth") < far)
    df = df.withColumns({"ca_": conic[0], "cb_": conic[1], "cc_": conic[2], "comp": comp, "radius": F.when(seen, radius).otherwise(0)})
    rad = F.col("radius")
    inside = (F.col("u") + rad > 0) & (F.col("u") - rad < w) & (F.col("v") + rad > 0) & (F.col("v") - rad < h)
    return df.withColumn("radius", F.when(inside, rad).otherwise(0))


def tiles(projected: DataFrame) -> DataFrame:
    """One row for each tile that a visible splat's box covers: tile_x, tile_y."""
    t = F.col("tile")

    def span(at: str, side: str) -> tuple[Column, Column]:
        last = F.ceil(F.col(side) / t)
        low = F.least(F.greatest(F.floor((F.col(at) - F.col("radius")) / t), F.lit(0)), last)
        high = F.least(F.greatest(F.ceil((F.col(at) + F.col("radius")) / t), F.lit(0)), last)
        return low.cast("int"), high.cast("int")

    (x0, x1), (y0, y1) = span("u", "width"), span("v", "height")
    df = projected.where("radius > 0").withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1}).where("x1 > x0 and y1 > y0")
    df = df.withColumn("tile_y", F.explode(F.sequence("y0", F.col("y1") - 1)))
    return df.withColumn("tile_x", F.explode(F.sequence("x0", F.col("x1") - 1))).drop("x0", "x1", "y0", "y1")


def pixel_pairs(tiled: DataFrame, least_alpha: float = 1 / 255) -> DataFrame:
    """One row for each (splat, pixel) with alpha of at least ``least_alpha``: px, py, sigma, alpha. An alpha of a or more
    means a sigma of ln(o / a) at most: only the pixels of that ellipse's box in the tile are made."""
    t, det = F.col("tile"), F.col("ca_") * F.col("cc_") - F.col("cb_") * F.col("cb_")
    most = F.greatest(F.ln(F.col("o") / round(least_alpha, 9)), F.lit(0.0)) + 1e-6

    def pixels(at: str, tile: str, side: str, other: str) -> Column:
        # half the box, and a pixel more against rounding; all of the tile where the conic is no ellipse
        half = F.when(det > 0, F.sqrt(2 * most * F.col(other) / F.when(det > 0, det).otherwise(1.0)) + 1).otherwise(F.lit(1e9))
        low = F.greatest(F.col(tile) * t, F.floor(F.greatest(F.col(at) - half - 0.5, F.lit(-1e9))).cast("int"))
        high = F.least((F.col(tile) + 1) * t, F.col(side), F.ceil(F.least(F.col(at) + half - 0.5, F.lit(1e9))).cast("int") + 1) - 1
        return F.when(low <= high, F.sequence(low, high))

    df = tiled.withColumn("py", F.explode(pixels("v", "tile_y", "height", "ca_"))).withColumn("px", F.explode(pixels("u", "tile_x", "width", "cc_")))
    dx, dy = F.col("px") + 0.5 - F.col("u"), F.col("py") + 0.5 - F.col("v")
    df = df.withColumn("sigma", F.round(0.5 * (F.col("ca_") * dx * dx + F.col("cc_") * dy * dy) + F.col("cb_") * dx * dy, 9))
    df = df.withColumn("alpha", F.round(F.least(F.lit(0.999), F.col("o") * F.exp(-F.col("sigma"))), 9))
    return df.where((F.col("sigma") >= 0) & (F.col("alpha") >= round(least_alpha, 9)))


def transmittance(pairs: DataFrame, stop: float = 1e-4) -> DataFrame:
    """Adds t, the transmittance before each splat of a pixel in depth order; a splat after which it is ``stop`` or less is dropped.
    The product includes the splat itself and only falls, so a filter on it stops at the same place."""
    order = Window.partitionBy("cam", "px", "py").orderBy("depth", "gid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = pairs.withColumn("after", F.exp(F.sum(F.ln(1 - F.col("alpha"))).over(order)))
    return df.where(F.round("after", 9) > stop).withColumn("t", F.col("after") / (1 - F.col("alpha")))


def composite(weighted: DataFrame) -> DataFrame:
    """cam, px, py, r, g, b, alpha, depth sum and number of splats of each pixel."""
    w = F.col("alpha") * F.col("t")
    return weighted.groupBy("cam", "px", "py").agg(*(F.sum(w * F.col(c)).alias(c) for c in "rgb"), F.sum(w).alias("a"), F.sum(w * F.col("depth")).alias("d"), F.count("*").alias("n"))


def sonar_sums(weighted: DataFrame, cap: float = 0.999) -> DataFrame:
    """Reflected and plain sums of each pixel, each term capped, the sums clamped to [0, 1]."""
    e = F.exp(-F.col("sigma")) * F.col("o") * F.col("t")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.least(c, F.lit(cap)))))
    return weighted.groupBy("cam", "px", "py").agg(clamp(F.col("refl") * e).alias("reflected"), clamp(e).alias("plain"), clamp(F.col("sat") * e).alias("saturated"))


def column_gain(image: DataFrame, k: float = 1.0) -> DataFrame:
    """Gain of each range column: p * s * (e^(k s) - 1) / (e^k - 1) + 1 - p, with p the clamped sum of saturations in the column."""
    import math

    p = F.least(F.greatest(F.sum("saturated").over(Window.partitionBy("cam", "py")), F.lit(0.0)), F.lit(1.0))
    s = F.col("plain")
    return image.withColumn("p", p).withColumn("gain", F.col("p") * s * (F.exp(k * s) - 1) / (math.exp(k) - 1) + 1 - F.col("p"))
