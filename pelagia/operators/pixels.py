"""Operators on long pixel tables: sonar frames (frame, rng, az, v) and gray images (img, py, px, v).

A frame or an image is a key, not a task: statistics are two-level aggregations with map-side partial sums, and
neighbourhoods are windows by one line of one image. Variances of integers come from exact sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def thresholded(v: Column, threshold: float) -> Column:
    """0 under the threshold and for NaN, else clipped to [0, 1]."""
    v = F.nanvl(v, F.lit(0.0))
    return F.when(v < threshold, 0.0).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def edge_blanked(v: Column, a: Column, b: Column, n_a: int, n_b: int, edge: int = 10) -> Column:
    return F.when((a < edge) | (a >= n_a - edge) | (b < edge) | (b >= n_b - edge), 0.0).otherwise(v)


def range_cleared(frames: DataFrame, start: int, end: int, bins: int, max_range: float, new_range: float) -> DataFrame:
    """Zero from ``start`` on and before ``end``; crop to the bins of ``new_range`` (truncated)."""
    kept = frames.where(F.col("rng") < int(new_range / max_range * bins))
    return kept.withColumn("v", F.when((F.col("rng") >= start) | (F.col("rng") < end), 0.0).otherwise(F.col("v")))


def nonempty_frames(frames: DataFrame, threshold: float) -> DataFrame:
    full = frames.groupBy("frame").agg(F.sum(F.when(F.col("v") > threshold, F.col("v")).otherwise(0.0)).alias("s")).where("s > 0")
    return frames.join(full, "frame", "left_semi")


def indexed(names: DataFrame, key: str) -> DataFrame:
    """``names`` with i, the place in order of ``key`` from 0: ranges are sorted apart, and their sizes give the offsets."""
    spark = names.sparkSession
    parts = names.repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    from pelagia.session import written

    placed = written(parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key))))
    # as many rows as partitions
    sizes = sorted((r._p, r["count"]) for r in placed.groupBy("_p").count().collect())
    first, rows = 0, []
    for p, n in sizes:
        rows.append((p, first))
        first += n
    offsets = F.broadcast(spark.createDataFrame(rows, "_p int, _first long"))
    return placed.join(offsets, "_p").withColumn("i", F.col("_first") + F.col("_r") - 1).drop("_p", "_r", "_first")


def selected_frames(frames: DataFrame, skip: int, start: int, end: int) -> DataFrame:
    every = indexed(frames.select("frame").distinct(), "frame")
    return every.where((F.col("i") % max(skip, 1) == 0) & F.col("i").between(start, end)).select("frame")


def first_return(frames: DataFrame, threshold: float) -> DataFrame:
    """First range bin above the threshold in each column; 0 where none is."""
    return frames.groupBy("frame", "az").agg(F.coalesce(F.min(F.when(F.col("v") > threshold, F.col("rng"))), F.lit(0)).alias("first"))


def dark_pixels(frames: DataFrame, p: float) -> DataFrame:
    limits = frames.groupBy("frame", "rng").agg(F.round(F.percentile("v", F.lit(p)), 9).alias("q"))
    return frames.join(limits, ["frame", "rng"]).where("v < q").select("frame", "rng", "az")


def _sums(images: DataFrame, *keys: str) -> DataFrame:
    v = F.col("v").cast("long")
    return images.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"))


def _variance() -> Column:
    return (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double") / (F.col("n") * F.col("n"))


def blank(images: DataFrame, least_std: float, least_range: int) -> DataFrame:
    return _sums(images, "img").select("img", (F.col("lo") == F.col("hi")).alias("strict"), ((F.sqrt(_variance()) < least_std) | (F.col("hi") - F.col("lo") < least_range)).alias("near"))


def side_of_line(images: DataFrame, axis: str, line: int) -> DataFrame:
    return images.where(F.col(axis) >= line).withColumn(axis, F.col(axis) - line)


def histogram(df: DataFrame, key: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """key, bin, n, share (of the key's highest) over equal bins; the last is closed, values outside are dropped, empty bins are 0."""
    v = F.col(value)
    at = F.when(v == high, bins - 1).otherwise(F.floor((v - low) * (bins / (high - low)))).cast("int")
    counts = df.where(v.between(low, high)).groupBy(key, at.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.select(key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts, [key, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    top = F.max("n").over(Window.partitionBy(key))
    return full.withColumn("share", F.when(top > 0, F.col("n") / top).otherwise(0.0))


def soft_histogram(df: DataFrame, key: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """A value's weight is split between its bin and the next by its place in the bin."""
    at = (F.col(value) - low) * (bins / (high - low))
    split = df.select(key, F.floor(at).cast("int").alias("lo"), (at - F.floor(at)).alias("a"))
    parts = split.select(key, F.inline(F.array(F.struct(F.col("lo").alias("bin"), (1 - F.col("a")).alias("w")), F.struct((F.col("lo") + 1).alias("bin"), F.col("a").alias("w")))))
    sums = parts.where(F.col("bin").between(0, bins - 1)).groupBy(key, "bin").agg(F.sum("w").alias("w"))
    return sums.withColumn("w", F.try_divide(F.col("w"), F.max("w").over(Window.partitionBy(key))))


def gamma_nll(seen: Column, predicted: Column) -> Column:
    p = F.greatest(predicted, F.lit(0.01))
    return F.avg(seen / p + F.ln(p))


def energy(seen: Column, predicted: Column) -> tuple[Column, Column]:
    """Squared relative error of the sums, and their ratio."""
    s, p = F.sum(seen), F.sum(predicted)
    share = (p - s) / (s + 1e-8)
    return share * share, p / (s + 1e-8)


def psnr(difference: Column) -> Column:
    return -10 * F.log10(F.avg(difference * difference))


def _by_row(images: DataFrame, kernel, schema: str) -> DataFrame:
    """img and sums of each image of rows (img, w, v: the pixels by lines of w). An image is its own row, so nothing is exchanged and no
    pixel is a row; ``kernel(v, i, px, n, w)`` gives per-pixel numbers of a batch (value, place in the image, column, the
    image's pixels and width), which are summed by image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes = part.column("v").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.cumsum(sizes) - sizes
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n, w = np.repeat(sizes, sizes), np.repeat(part.column("w").to_numpy(zero_copy_only=False).astype(np.int64), sizes)
                i = np.arange(len(v)) - np.repeat(first, sizes)
                ends = np.append(first, len(v))
                found = {k: np.diff(np.append(0, np.cumsum(x))[ends]) if x.dtype != float else np.bincount(np.repeat(np.arange(len(sizes)), sizes), x, len(sizes)) for k, x in kernel(v, i, i % w, n, w).items()}
                some = pa.array(sizes > 0)
                yield pa.RecordBatch.from_arrays([part.column("img"), pa.array(sizes), *(pa.array(x) for x in found.values())], ["img", "n", *found]).filter(some)

    kind = images.schema["img"].dataType.simpleString()
    return images.select("img", "w", "v").mapInArrow(run, f"img {kind}, n long, {schema}")


def _beside(v: np.ndarray, there: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The value ``step`` places on where a pixel is there, else the pixel's own."""
    at = np.arange(len(v))
    return v[np.where(there, at + step, at)]


def total_variation(images: DataFrame) -> DataFrame:
    """img, aniso, iso of image rows (img, w, v): sums of the steps to the right and below, and of their lengths."""

    def kernel(v, i, px, n, w):
        dx, dy = (np.abs(_beside(v, there, step) - v) for there, step in (((px + 1 < w) & (i + 1 < n), 1), (i + w < n, w)))
        return {"aniso": dx + dy, "iso": np.sqrt((dx * dx + dy * dy).astype(float))}

    return _by_row(images, kernel, "aniso long, iso double").drop("n")


def entropy(images: DataFrame) -> DataFrame:
    """Shannon entropy of the levels over 8 bits, 1 at most."""
    counts = images.groupBy("img", "v").agg(F.count("*").alias("n"))
    p = F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("img"))
    return counts.select("img", p.alias("p")).groupBy("img").agg(F.least(F.lit(1.0), -F.sum(F.col("p") * F.log2("p")) / 8).alias("entropy"))


def laplacian_variance(images: DataFrame) -> DataFrame:
    """img, var of image rows (img, w, v): the variance of the 4-neighbour Laplacian, from exact sums; a border pixel's missing neighbour
    is the pixel itself."""

    def kernel(v, i, px, n, w):
        sides = (((px + 1 < w) & (i + 1 < n), 1), (px > 0, -1), (i + w < n, w), (i >= w, -w))
        d = sum(_beside(v, there, step) for there, step in sides) - 4 * v
        return {"s1": d, "s2": d * d}

    return _by_row(images, kernel, "s1 long, s2 long").select("img", _variance().alias("var"))


def edge_density(images: DataFrame, least: int) -> DataFrame:
    """img, density of image rows (img, w, v): ten times the share of pixels whose step to the right and below is longer than ``least``, 1
    at most."""

    def kernel(v, i, px, n, w):
        dx, dy = (_beside(v, there, step) - v for there, step in (((px + 1 < w) & (i + 1 < n), 1), (i + w < n, w)))
        return {"hard": (dx * dx + dy * dy > least * least).astype(np.int64)}

    return _by_row(images, kernel, "hard long").select("img", F.least(F.lit(1.0), 10 * (F.col("hard") / F.col("n"))).alias("density"))


def image_stats(images: DataFrame) -> DataFrame:
    top = images.where("py < 4").groupBy("img").agg((F.sum("v").cast("double") / F.count("*")).alias("top"))
    return _sums(images, "img").select("img", "lo", "hi", "n", (F.col("s1").cast("double") / F.col("n")).alias("mean"), F.sqrt(_variance()).alias("std")).join(top, "img", "left")


def pixel_moments(images: DataFrame, busy: float) -> DataFrame:
    return _sums(images, "py", "px").select("py", "px", (F.col("s1").cast("double") / F.col("n")).alias("mean"), _variance().alias("var"), (_variance() > busy).alias("busy"))


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return 16 + 65.481 * r + 128.553 * g + 24.966 * b, 128 - 37.797 * r - 74.203 * g + 112.0 * b, 128 + 112.0 * r - 93.786 * g - 18.214 * b


def value_saturation(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return top, F.when(top == 0, 0.0).otherwise((top - low) / F.when(top == 0, 1.0).otherwise(top))


def color_class(r: Column, g: Column, b: Column) -> Column:
    rules = (("dark", F.greatest(r, g, b) < 0.25), ("bright", F.least(r, g, b) > 0.75), ("blue", b > 1.2 * F.greatest(r, g)), ("green", g > 1.2 * F.greatest(r, b)), ("red", r > 1.2 * F.greatest(g, b)))
    out = F.lit("neutral")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def blur_class(sharpness: Column) -> Column:
    return F.when(sharpness < 0.3, "blurry").when(sharpness < 0.7, "soft").otherwise("sharp")


def quality(sharpness: Column, contrast: Column, spread: Column) -> Column:
    capped = [F.least(c / 0.8, F.lit(1.0)) for c in (sharpness, contrast, spread)]
    return 100 * (0.4 * capped[0] + 0.3 * capped[1] + 0.3 * capped[2])
