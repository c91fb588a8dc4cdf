"""Operators of the extended queries: masks and joins by name, water, windows of pixels, sampling and random edits.

Random numbers are hashes of (seed, id), so results do not depend on partitioning, retries or lost executors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pelagia.operators.pixels import indexed
from pelagia.operators.selection import of_columns
from pelagia.session import written

Columns = list[Column]


def uniform(seed: str, *keys: str) -> Column:
    """A number in (0, 1) hashed from the seed and the keys, equal on every engine: twelve hexadecimal digits of an md5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)


def normal(seed: str, *keys: str) -> Column:
    """A standard normal number by Box-Muller."""
    return F.sqrt(-2 * F.ln(uniform(seed + ":r", *keys))) * F.cos(2 * math.pi * uniform(seed + ":a", *keys))


def masked(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """Values outside the label mask become 0; files are matched by stem without leading zeros."""
    mask = labels.select(F.ltrim("file", F.lit("0")).alias("stem"), "rng", "az", F.lit(1).alias("hit"))
    joined = pixels.withColumn("stem", F.ltrim("file", F.lit("0"))).join(mask, ["stem", "rng", "az"], "left")
    return joined.withColumn("v", F.when(F.col("hit").isNotNull(), F.col("v")).otherwise(0.0)).drop("hit")


def finite(values: Column) -> Column:
    return F.forall(values, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))


def quat_of(m: Columns) -> Columns:
    """Quaternion of a rotation whose trace is not near -1."""
    w = 0.5 * F.sqrt(1 + m[0] + m[4] + m[8])
    return [w, (m[7] - m[5]) / (4 * w), (m[2] - m[6]) / (4 * w), (m[3] - m[1]) / (4 * w)]


def medium(weighted: DataFrame, attenuation: float, backscatter: float) -> DataFrame:
    """Adds object (attenuated) and medium (backscatter between consecutive depths) terms of each splat of a pixel."""
    order = Window.partitionBy("cam", "px", "py").orderBy("depth", "gid")
    before = F.coalesce(F.lag("depth").over(order), F.lit(0.0))
    fade = lambda d: F.exp(-attenuation * d)
    df = weighted.withColumn("d0", before)
    return df.withColumns({"object": F.col("alpha") * F.col("t") * F.col("r") * fade(F.col("depth")), "medium": F.col("t") * backscatter * (fade(F.col("d0")) - fade(F.col("depth")))})


def zipped(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of equal place in either order, up to the shorter."""
    return indexed(a, order_a).join(indexed(b, order_b), "i")


def peak_near(profile: DataFrame, reach: int, bins: int) -> DataFrame:
    """For each bin of a profile (frame, rng, s) the place of the highest sum within reach, the first on ties; edges are clamped."""
    at = profile.select("frame", F.col("rng").alias("bin"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("o"))
    at = at.withColumn("rng", F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.col("bin") + F.col("o"))))
    return at.join(profile, ["frame", "rng"]).groupBy("frame", "bin").agg(F.max_by("rng", F.struct(F.round("s", 9), -F.col("o"))).alias("peak"))


def grid_density(splats: DataFrame, low: int, high: int) -> DataFrame:
    """Summed density at grid points, from the splats within three sigmas: each splat is exploded to its own grid points."""
    span = lambda c: F.sequence(F.greatest(F.ceil(F.col(c) - 3 * F.col("sx")), F.lit(low)), F.least(F.floor(F.col(c) + 3 * F.col("sx")), F.lit(high)))
    ok = lambda c: F.ceil(F.col(c) - 3 * F.col("sx")) <= F.least(F.floor(F.col(c) + 3 * F.col("sx")), F.lit(high))
    inside = splats.where(ok("x") & ok("y")).where(f"x + 3 * sx >= {low} and y + 3 * sx >= {low}")
    near = inside.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y")))
    d2 = (F.col("gx") - F.col("x")) ** 2 + (F.col("gy") - F.col("y")) ** 2
    density = F.sum(F.col("o") * F.exp(-0.5 * d2 / (F.col("sx") * F.col("sx"))))
    return near.groupBy(F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy")).agg(density.alias("density"))


def icv(images: DataFrame, side: int) -> DataFrame:
    """Mean over windows of mean / deviation, where there is any deviation."""
    v = F.col("v").cast("long")
    w = images.groupBy("img", F.floor(F.col("py") / side).alias("wy"), F.floor(F.col("px") / side).alias("wx")).agg(F.count("*").alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"))
    var = (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double") / (F.col("n") * F.col("n"))
    s = w.select("img", (F.col("s1").cast("double") / F.col("n")).alias("m"), F.sqrt(var).alias("s")).where("s > 0")
    return s.groupBy("img").agg(F.avg(F.col("m") / F.col("s")).alias("icv"))


def gaussian_weights(reach: int, sigma: float) -> list[float]:
    """Weights of -reach .. reach that sum to 1."""
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    return [x / sum(raw) for x in raw]


def blurred(images: DataFrame, names: tuple[str, ...], reach: int, sigma: float) -> DataFrame:
    """Columns ``names`` smoothed along rows, then along columns, with zeros beyond the image; rows and columns have no gaps."""
    weights = gaussian_weights(reach, sigma)

    def along(c: str, w) -> Column:
        at = lambda k: F.col(c) if not k else (F.lag(c, -k, 0.0) if k < 0 else F.lead(c, k, 0.0)).over(w)
        return sum((weights[k + reach] * at(k) for k in range(-reach + 1, reach + 1)), weights[0] * at(-reach))

    rows, columns = Window.partitionBy("img", "py").orderBy("px"), Window.partitionBy("img", "px").orderBy("py")
    df = images.repartition("img").select("img", "py", "px", *(along(c, rows).alias(c) for c in names))
    return df.select("img", "py", "px", *(along(c, columns).alias(c) for c in names))


def ssim(pairs: DataFrame, reach: int = 5, sigma: float = 1.5, c1: float = 0.01**2, c2: float = 0.03**2) -> DataFrame:
    """Mean structural similarity of (a, b) by image, under a Gaussian window of 2 reach + 1 pixels."""
    a, b = F.col("a"), F.col("b")
    w = blurred(pairs.select("img", "py", "px", "a", "b", (a * a).alias("aa"), (b * b).alias("bb"), (a * b).alias("ab")), ("a", "b", "aa", "bb", "ab"), reach, sigma)
    s = (2 * a * b + c1) * (2 * (F.col("ab") - a * b) + c2) / ((a * a + b * b + c1) * (F.col("aa") - a * a + F.col("bb") - b * b + c2))
    return w.groupBy("img").agg(F.avg(s).alias("ssim"))


def information(weights: DataFrame, *keys: str) -> DataFrame:
    """Mutual information, in bits, of each member (p) of a distribution by ``keys`` with the whole: H(X) less p_i times the entropy
    of p / p_i. The sums over pairs cancel and leave -log2(p_i) times the sum of p; a member of no weight has H(X)."""
    by = Window.partitionBy(*keys)
    logs = F.when(F.col("p") > 0, F.log2("p"))
    return weights.withColumn("h", F.coalesce(-F.sum("p").over(by) * logs, -F.sum(F.col("p") * logs).over(by)))


def kernel_histogram_2d(points: DataFrame, bins: int, sigma: float) -> DataFrame:
    """Two-dimensional histogram of (a, b) in [0, 1] by frame: each point spreads a unit over the bins, by Gaussian kernels that are
    normalised along either axis, so a frame's histogram sums to its number of points."""
    centres = F.sequence(F.lit(0), F.lit(bins - 1))
    kernel = lambda c: F.transform(centres, lambda k: F.exp(-0.5 * ((F.col(c) - (k + 0.5) / bins) / sigma) ** 2))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    df = points.select("frame", kernel("a").alias("ka"), kernel("b").alias("kb"))
    df = df.select("frame", "kb", total("kb").alias("tb"), total("ka").alias("ta"), F.posexplode("ka").alias("i", "wa")).select("frame", "i", (F.col("wa") / F.col("ta") / F.col("tb")).alias("w"), F.posexplode("kb").alias("j", "wb"))
    return df.groupBy("frame", "i", "j").agg(F.sum(F.col("w") * F.col("wb")).alias("w"))


def grid_variation(grid: DataFrame, axes: tuple[str, ...], value: str) -> DataFrame:
    """Squared differences of neighbours along each axis of a grid, each axis over its number of neighbours, summed."""
    sides = []
    for a in axes:
        w = Window.partitionBy(*(x for x in axes if x != a)).orderBy(a)
        near = F.lead(a).over(w) == F.col(a) + 1
        sides.append(F.when(near, (F.lead(value).over(w) - F.col(value)) ** 2).alias(f"_{a}"))
    df = grid
    for a, side in zip(axes, sides, strict=True):
        df = df.withColumn(f"_{a}", side)
    return df.agg(sum((F.avg(f"_{a}") for a in axes[1:]), F.avg(f"_{axes[0]}")).alias("tv"))


def band_component(images: DataFrame, low: int, high: int, least_area: int, width: int, reach: int, share: float) -> DataFrame:
    """The largest 8-connected component of each image's pixels with low <= v <= high: img, n (components), area, row_ (its top row, null
    where the area, the distance of that row's last pixel from the right edge or the share of the band's pixels fails). The
    first component in reading order of those of the largest area. One image, an input row, is in a task at a time."""
    from pelagia.operators.kernels import AROUND, parts_of

    def run(rows: pa.Table) -> pa.Table:
        img, py, px = (rows.column(c).to_numpy().astype(np.int64) for c in ("img", "py", "px"))
        mask = np.zeros((int(np.ptp(py)) + 1, int(np.ptp(px)) + 1), bool)
        mask[py - py.min(), px - px.min()] = True
        label = parts_of(mask, AROUND)
        areas = np.bincount(label.ravel())[1:]
        best = int(np.argmax(areas))
        y, x = np.nonzero(label == best + 1)
        top, last = int(y[0] + py.min()), int(x[y == y[0]].max() + px.min())
        fits = areas[best] >= least_area and width - last <= reach and areas[best] >= share * areas.sum()
        return pa.table({"img": pa.array([int(img[0])]), "n": pa.array([len(areas)]), "area": pa.array([int(areas[best])]), "row_": pa.array([top if fits else None], pa.int64())})

    band = images.where(F.col("v").between(low, high)).select("img", "py", "px")
    return band.groupBy("img").applyInArrow(run, "img long, n long, area long, row_ long")


def sonar_config(df: DataFrame) -> DataFrame:
    """Bins and range of the first agent's last sensor, or of a flat configuration; column json."""
    one = ("RangeBins", "int"), ("AzimuthBins", "int"), ("RangeMax", "double"), ("Azimuth", "double")
    inner = ",".join(f"{n}:{t}" for n, t in one)
    nested = F.from_json("json", f"agents array<struct<sensors:array<struct<configuration:struct<{inner}>>>>>, " + ", ".join(f"{n} {t}" for n, t in one))
    df = df.withColumn("c", nested)
    sensor = F.try_element_at(F.get(F.col("c.agents"), F.lit(0))["sensors"], F.lit(-1))["configuration"]
    return df.select("*", F.coalesce(sensor["RangeBins"], F.col("c.RangeBins")).alias("bins"), F.coalesce(sensor["RangeMax"], F.col("c.RangeMax")).alias("range_max")).drop("c")


def lattice(splats: DataFrame, half: float, side: int) -> DataFrame:
    """The splats in a box, repeated on a side x side lattice."""
    box = splats.where(" and ".join(f"abs({c}) <= {half}" for c in "xyz"))
    steps = F.sequence(F.lit(0), F.lit(side - 1))
    wide = box.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    return wide.withColumns({"x": F.col("x") + 2 * half * F.col("i"), "y": F.col("y") + 2 * half * F.col("j")})


def coded(df: DataFrame, bits: dict[str, int]) -> DataFrame:
    """Every column of ``bits`` on its grid between its extremes; one pass for all extremes."""
    box = df.agg(*(f(c).alias(f"_{n}_{c}") for c in bits for f, n in ((F.min, "l"), (F.max, "h"))))
    wide = df.crossJoin(F.broadcast(box))  # one row
    share = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_l_{c}"), F.col(f"_h_{c}") - F.col(f"_l_{c}")), F.lit(0.0))
    return wide.select(*(F.rint(share(c) * (2 ** bits[c] - 1)).cast("int").alias(c) if c in bits else F.col(c) for c in df.columns))


def random_cap(df: DataFrame, key: str, n: int, seed: str = "cap") -> DataFrame:
    """At most n random rows of each key. The window keeps n rows of a key in each task before the shuffle."""
    order = Window.partitionBy(key).orderBy(uniform(seed, "gid"), "gid")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: str = "draw") -> DataFrame:
    """n draws with replacement in proportion to the weight: draw, key. A draw falls in an interval of the running sum; the
    running sum is kept by ranges of the key (their sums give the offsets), and draws are merged with a range's intervals."""
    spark = df.sparkSession
    parts = df.select(key, F.col(weight).cast("double").alias("w")).where("w > 0").repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    order = Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    placed = written(parts.withColumn("_s", F.sum("w").over(order)))
    sums = sorted((r._p, r.s) for r in placed.groupBy("_p").agg(F.max("_s").alias("s")).collect())  # a row a partition
    first, rows = 0.0, []
    for p, s in sums:
        rows.append((p, first, first + s))
        first += s
    if not rows:
        return spark.createDataFrame([], f"draw long, {key} long")
    edges = F.broadcast(spark.createDataFrame(rows, "_p int, _a double, _b double"))
    draws = spark.range(n).select(F.col("id").alias("draw"), (uniform(seed, "id") * first).alias("u"))
    draws = draws.join(edges, (F.col("u") > F.col("_a")) & (F.col("u") <= F.col("_b"))).select("draw", "_p", (F.col("u") - F.col("_a")).alias("u"))

    def merge(drawn: pa.Table, own: pa.Table) -> pa.Table:
        """Each draw's interval of a range's running sum, by binary search: work in proportion to draws and rows."""
        u, sums = drawn.column("u").to_numpy(), own.column("_s").to_numpy()
        order = np.argsort(sums, kind="stable")
        if not len(u) or not len(order):
            return pa.table({"draw": pa.array([], pa.int64()), key: pa.array([], own.schema.field(key).type)})
        at = np.minimum(np.searchsorted(sums[order], u), len(order) - 1)
        return pa.table({"draw": drawn.column("draw"), key: own.column(key).take(pa.array(order[at]))})

    kind = df.schema[key].dataType.simpleString()
    return draws.groupBy("_p").cogroup(placed.select("_p", key, "_s").groupBy("_p")).applyInArrow(merge, f"draw long, {key} {kind}")


def uniform_box(points: DataFrame, n: int) -> DataFrame:
    box = points.agg(*(f(c).alias(m + c) for c in "xyz" for f, m in ((F.min, "l"), (F.max, "h"))))
    ids = points.sparkSession.range(n).crossJoin(F.broadcast(box))  # one row
    return ids.select("id", *((F.col(f"l{c}") + uniform(f"box:{c}", "id") * (F.col(f"h{c}") - F.col(f"l{c}"))).alias(c) for c in "xyz"))


def gaussian_sample(splats: DataFrame, n: int) -> DataFrame:
    """n points of each splat: mean + R (scale * normal)."""
    from pelagia.functions import geometry as G

    df = splats.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    noise = [F.col(s) * normal(f"g:{s}", "gid", "k") for s in ("sx", "sy", "sz")]
    moved = G.matvec(G.quat_to_rotmat(*(F.col(c) for c in ("qw", "qx", "qy", "qz"))), noise)
    return df.select("gid", "k", *((F.col(c) + m).alias(c) for c, m in zip("xyz", moved, strict=True)))


def morton_grid(splats: DataFrame, key: str, weight: str, bits: int = 8) -> DataFrame:
    """The heaviest n^2 splats in Z-order of their quantised positions: key, place."""
    n = math.isqrt(splats.count())
    # ranks by ranges: nearly all rows stay, so no one task takes them
    ranked = indexed(splats.select(key, "x", "y", "z", F.struct((-F.col(weight)).alias("w"), key).alias("_o")), "_o")
    kept = ranked.where(F.col("i") < n * n)
    q = coded(kept.select(key, "x", "y", "z"), {c: bits for c in "xyz"})
    code = F.lit(0).cast("long")
    for b in range(bits):
        for i, c in enumerate("xyz"):
            code = code + F.shiftleft(F.shiftright(F.col(c), b).bitwiseAND(1).cast("long"), 3 * b + i)
    return indexed(q.select(key, F.concat_ws("-", F.lpad(code.cast("string"), 12, "0"), F.lpad(F.col(key).cast("string"), 20, "0")).alias("z")), "z").select(key, F.col("i").alias("place"))


def elevation_samples(frames: DataFrame, n: int, spread: float = 0.2) -> DataFrame:
    df = frames.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return df.withColumn("elevation", spread * (uniform("el", "frame", "rng", "az", "k") - 0.5))


def noised(splats: DataFrame, scale: float = 0.01, seed: str = "noise") -> DataFrame:
    """Positions moved by the covariance times normal noise, gated to faint splats by sigmoid(100 (1 - o - 0.995))."""
    from pelagia.functions import geometry as G
    from pelagia.operators.raster import world_covariance

    gate = scale / (1 + F.exp(-100 * (1 - F.col("o") - 0.995)))
    cov = G.symmetric(world_covariance())
    moved = G.matvec(cov, [normal(f"{seed}:{c}", "gid") * gate for c in "xyz"])
    return splats.withColumns({c: F.col(c) + m for c, m in zip("xyz", moved, strict=True)})


def normalised(points: DataFrame) -> DataFrame:
    """Points centred at their medians and scaled by the median distance; medians by counting."""
    mid = of_columns(points, {c: F.col(c) for c in "xyz"}, [0.5])
    moved = points.select("pid", *((F.col(c) - F.lit(mid[c][0])).alias(c) for c in "xyz"))
    scale = of_columns(moved, {"d": F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)}, [0.5])["d"][0]
    return moved.select("pid", *((F.col(c) / F.lit(scale)).alias(c) for c in "xyz"))


def aligned(points: DataFrame) -> DataFrame:
    """pid, x, y, z along the principal axes of the points around their medians, the widest first; the 3 x 3 eigenproblem is the
    driver's. An axis' sign is its largest component's, the first axis turns where that would mirror."""
    mid = {c: q[0] for c, q in of_columns(points, {c: F.col(c) for c in "xyz"}, [0.5]).items()}
    cov = points.agg(*(F.covar_samp(a, b).alias(a + b) for i, a in enumerate("xyz") for b in "xyz"[i:])).first()
    matrix = np.array([[cov["".join(sorted(a + b))] for b in "xyz"] for a in "xyz"])
    axes = np.linalg.eigh(matrix)[1][:, ::-1].T
    axes = axes * np.sign(axes[np.arange(3), np.abs(axes).argmax(1)])[:, None]
    axes[0] *= np.sign(np.linalg.det(axes))
    moved = [F.col(c) - mid[c] for c in "xyz"]
    return points.select("pid", *((float(r[0]) * moved[0] + float(r[1]) * moved[1] + float(r[2]) * moved[2]).alias(c) for c, r in zip("xyz", axes, strict=True)))
