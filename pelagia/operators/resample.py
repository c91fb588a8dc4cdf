"""Whole images resampled: lens distortion, fisheye lenses with their masks, sonar sectors, random patches.

An image is a bounded grid and in one task at a time, dense in numpy; images run in parallel, and any size is taken from the
image itself. Pixels that an image lacks add nothing to a result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pelagia.operators.extended import uniform
from pelagia.operators.image_rows import by_image, repeated, rounded
from pelagia.session import written


def _bilinear(image: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values at columns u and rows w, and whether any pixel of the image had a part in them."""
    h, wide = image.shape
    total, hit = np.zeros(u.shape), np.zeros(u.shape, bool)
    for a in (0, 1):
        for b in (0, 1):
            px, py = np.floor(u).astype(np.int64) + a, np.floor(w).astype(np.int64) + b
            share = (1 - np.abs(u - px)) * (1 - np.abs(w - py))
            inside = (px >= 0) & (px < wide) & (py >= 0) & (py < h) & (share > 0)
            v = np.where(inside, image[np.clip(py, 0, h - 1), np.clip(px, 0, wide - 1)], np.nan)
            there = ~np.isnan(v)
            total += np.where(there, v * share, 0.0)
            hit |= there
    return total, hit


def undistorted(images: DataFrame, k: float, margins: tuple[int, int, int, int], digits: int) -> DataFrame:
    """img, y, x, v: images resampled through x' = x (1 + k r^2), r in shares of the sides from the middle, by bilinear taps, zero beyond
    the image, without the margins (left, top, right, bottom); y and x count from the region's corner."""
    left, top, right, bottom = margins

    def kernel(image: np.ndarray) -> dict[str, np.ndarray]:
        h, w = image.shape
        y, x = (g.ravel() for g in np.mgrid[top : max(top, h - bottom), left : max(left, w - right)])
        cx, cy = (x + 0.5) / w - 0.5, (y + 0.5) / h - 0.5
        bend = 1 + k * (cx * cx + cy * cy)
        v, hit = _bilinear(image, np.round((cx * bend + 0.5) * w - 0.5, 9), np.round((cy * bend + 0.5) * h - 0.5, 9))
        return {"y": (y - top)[hit], "x": (x - left)[hit], "v": rounded(v[hit], digits)}

    return by_image(images, kernel, "y int, x int, v double")


def fisheye_undistorted(images: DataFrame, params: tuple[float, float, float, float], digits: int) -> DataFrame:
    """img, y, x, v, seen: images of a fisheye lens (a focal length of the sides, centred) resampled through r' = r (1 + p0 t^2 + p1 t^4 +
    p2 t^6 + p3 t^8), t the angle. The region is the box of the places that fall inside the image (seen); y and x count from its
    corner."""
    p0, p1, p2, p3 = params

    def kernel(image: np.ndarray) -> dict[str, np.ndarray]:
        h, w = image.shape
        y, x = (g.ravel() for g in np.mgrid[0:h, 0:w])
        x1, y1 = (x - w / 2) / w, (y - h / 2) / h
        t = x1 * x1 + y1 * y1
        bend = 1 + t * (p0 + t * (p1 + t * (p2 + t * p3)))
        u, v = np.round(w * x1 * bend + w // 2, 9), np.round(h * y1 * bend + h // 2, 9)
        seen = (u > 0) & (v > 0) & (u < w - 1) & (v < h - 1)
        if not seen.any():
            return {"y": y[:0], "x": x[:0], "v": u[:0], "seen": seen[:0]}
        (y0, y1_), (x0, x1_) = ((c[seen].min(), c[seen].max()) for c in (y, x))
        value, hit = _bilinear(image, u, v)
        own = hit & (y >= y0) & (y <= y1_) & (x >= x0) & (x <= x1_)
        return {"y": (y - y0)[own], "x": (x - x0)[own], "v": rounded(value[own], digits), "seen": seen[own]}

    return by_image(images, kernel, "y int, x int, v double, seen boolean")


def sector_to_polar(images: DataFrame, opening: float) -> DataFrame:
    """img, r, a, v: polar samples of images of a sector whose apex is the middle of the first row: as many ranges as rows and as many
    beams as columns over ``opening`` radians, by the nearest pixel, truncated and clipped."""

    def kernel(image: np.ndarray) -> dict[str, np.ndarray]:
        h, w = image.shape
        r, a = (g.ravel() for g in np.mgrid[0:h, 0:w])
        far, angle = (r + 0.5) / h, (a - w // 2) * opening / w
        px = np.minimum(w - 1, np.trunc(np.round(w // 2 + far * (w // 2) * np.sin(angle), 9)).astype(np.int64))
        py = np.minimum(h - 1, np.trunc(np.round(far * h * np.cos(angle), 9)).astype(np.int64))
        v = image[py, px]
        there = ~np.isnan(v)
        return {"r": r[there], "a": a[there], "v": v[there]}

    return by_image(images, kernel, "r int, a int, v double")


def random_patch(images: DataFrame, side: int, cx: float, cy: float, rows: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A random side x side patch of each image row (img, w, v), drawn from the image's own size (the whole side where an image is smaller); coordinates
    and the principal point count from its corner. Rows of one id are one image as large as the largest of them, and all their pixels in
    the patch are its own; rows without an id have none. ``rows`` makes w and v of other columns, after the joins."""

    def sized(df: DataFrame) -> DataFrame:
        n, w = F.size("v"), F.least(F.size("v"), F.col("w"))
        return rows(df).where("size(v) > 0").withColumns({"w": w, "n": n})

    df = images.where("img is not null")
    size = {"y": F.ceil(F.col("n") / F.col("w")), "x": F.col("w")}
    ids = repeated(df)
    if ids is not None:  # the sizes are written: a join of two tables splits a hot id
        sizes = written(sized(df.join(ids, "img", "left_semi")).groupBy("img").agg(*(F.max(c).alias(f"_{a}") for a, c in size.items())))
        df = df.join(sizes, "img", "left")
        size = {a: F.coalesce(f"_{a}", c) for a, c in size.items()}
    df = sized(df)
    oy, ox = (F.floor(uniform(f"patch:{a}", "img") * F.greatest(c - side + 1, F.lit(1))).cast("int") for a, c in size.items())
    df = df.select("img", "v", "w", "n", oy.alias("oy"), ox.alias("ox"))
    y, x = (lambda k: F.floor(k / side).cast("int")), (lambda k: k % side)
    place = lambda k: (F.col("oy") + y(k)) * F.col("w") + F.col("ox") + x(k)
    inside = F.filter(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: (F.col("ox") + x(k) < F.col("w")) & (place(k) < F.col("n")))
    patch = F.transform(inside, lambda k: F.struct(y(k).alias("py"), x(k).alias("px"), F.get("v", place(k)).alias("v")))
    return df.select("img", (cx - F.col("ox")).cast("double").alias("cx"), (cy - F.col("oy")).cast("double").alias("cy"), F.inline(patch)).select("img", "py", "px", "v", "cx", "cy")
