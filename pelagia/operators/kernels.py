"""Operators that need a whole image at once: colour match, spline resampling, sliding templates, outlines of masks.

An image or a sonar frame is one input row of the engine, so a group is bounded by the largest image, whatever the number of
images; each runs as a numpy kernel over Arrow.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pelagia.operators.image_rows import Found, by_image, colour_fit


def _columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in names]


def _dense(rows: pa.Table, y: str, x: str, v: str, fill: float, shape: tuple[int, int] | None = None) -> np.ndarray:
    """The image of a pixel table; pixels without a row are ``fill``, pixels beyond ``shape`` are left out."""
    a, b, value = _columns(rows, y, x, v)
    h, w = shape or (int(a.max()) + 1, int(b.max()) + 1)
    out, inside = np.full((h, w), float(fill)), (a < h) & (b < w)
    out[a[inside], b[inside]] = value[inside]
    return out


def color_matched(pairs: DataFrame, channels: int, rounds: int = 5, margin: float = 0.5 / 255) -> DataFrame:
    """img, py, px, v0 ..: channels a0 .. of each image warped to b0 .. by least squares on all products of two channels, the channels
    and 1. The warp is fitted again ``rounds`` times on its own result, each channel without the pixels that are within ``margin`` of
    0 or 1 in the original, in the reference or in the present estimate; a channel without pixels left becomes 0."""

    def run(rows: pa.Table) -> pa.Table:
        first = np.stack(_columns(rows, *(f"a{c}" for c in range(channels))), 1).astype(float)
        wanted = np.stack(_columns(rows, *(f"b{c}" for c in range(channels))), 1).astype(float)
        now = colour_fit(first, wanted, rounds, margin)
        kept = rows.select(["img", "py", "px"])
        for c in range(channels):
            kept = kept.append_column(f"v{c}", pa.array(now[:, c]))
        return kept

    schema = pairs.select("img", "py", "px").schema
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return pairs.groupBy("img").applyInArrow(run, types + "".join(f", v{c} double" for c in range(channels)))


def spline_taps(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four coefficients that a cubic B-spline needs at each place, and their weights."""
    low = np.floor(at).astype(np.int64)
    f = at - low
    weights = np.stack(((1 - f) ** 3, 3 * f**3 - 6 * f**2 + 4, -3 * f**3 + 3 * f**2 + 3 * f + 1, f**3), -1) / 6
    return low[..., None] + np.arange(-1, 3), weights


def spline_coefficients(n: int) -> np.ndarray:
    """[k + 2, j]: the share of sample j in coefficient k of -2 .. n + 1, for samples that are zero outside 0 .. n - 1. The inverse of
    the sampled B-spline (1, 4, 1) / 6 decays by its pole, sqrt(3) - 2."""
    apart = np.abs(np.arange(-2, n + 2)[:, None] - np.arange(n)[None])
    return math.sqrt(3) * (math.sqrt(3) - 2) ** apart


def sector_image(frames: DataFrame, ranges: int, columns: int, view: float) -> DataFrame:
    """frame, i, j, v: Cartesian image of each polar frame (rng, az, v) by cubic splines. i runs over 2 x ranges places across, from
    -1 to 1, j over ``ranges`` places ahead, from 0 to 1; the columns span ``view`` radians. Places beyond the last range take the
    last range, places outside the view are 0, and so are missing pixels and all beyond the frame's edges."""
    across, ahead = np.meshgrid(np.linspace(-1, 1, 2 * ranges), np.linspace(0, 1, ranges), indexing="ij")
    angle = np.arctan2(across, ahead)
    r, r_weight = spline_taps(np.clip(np.hypot(across, ahead) * (ranges - 1), 0, ranges - 1))
    a, a_weight = spline_taps(np.clip((angle / view + 0.5) * (columns - 1), 0, columns - 1))
    seen = np.abs(angle) <= view / 2
    by_range, by_column = spline_coefficients(ranges), spline_coefficients(columns)
    at = np.arange(2 * ranges * ranges)

    def run(rows: pa.Table) -> pa.Table:
        c = by_range @ _dense(rows, "rng", "az", "v", 0.0, (ranges, columns)) @ by_column.T
        taps = c[(r + 2)[..., :, None], (a + 2)[..., None, :]]
        v = np.where(seen, np.einsum("ijkl,ijk,ijl->ij", taps, r_weight, a_weight), 0.0).ravel()
        frame = pa.array(np.full(len(at), rows.column("frame")[0].as_py()), rows.schema.field("frame").type)
        return pa.table({"frame": frame, "i": pa.array((at // ranges).astype(np.int32)), "j": pa.array((at % ranges).astype(np.int32)), "v": pa.array(v)})

    kind = frames.schema["frame"].dataType.simpleString()
    return frames.select("frame", "rng", "az", F.col("v").cast("double").alias("v")).groupBy("frame").applyInArrow(run, f"frame {kind}, i int, j int, v double")


def corner_match(images: DataFrame, template: DataFrame, side: int, bottom: float, right: float, least: float, reach: int) -> DataFrame:
    """img, row_, col_, score, reject: where a side x side template (ty, tx, t) correlates best with each image, at every offset in the
    image's lowest ``bottom`` and rightmost ``right`` share; ties go to the first offset in reading order. reject says what speaks
    against the match: ``small`` (no offset), ``flat`` (the template, or every window, has one value), ``score`` (under ``least``) or
    ``edge`` (it ends more than ``reach`` rows above the bottom); otherwise null. Windows with missing pixels are left out."""
    pattern = np.full((side, side), np.nan)
    for row in template.where((F.col("ty") < side) & (F.col("tx") < side)).collect():  # side x side rows
        pattern[row.ty, row.tx] = row.t
    centred = pattern - pattern.mean()
    size = math.sqrt((centred**2).sum())

    def kernel(whole: np.ndarray) -> Found:
        h, w = whole.shape
        y, x = int(h * (1 - bottom)), int(w * (1 - right))
        place, score, reject = (None, None), None, "small"
        if h - y >= side and w - x >= side:
            windows = np.lib.stride_tricks.sliding_window_view(whole[y:, x:], (side, side))
            mean = windows.mean((2, 3))
            spread = (windows**2).mean((2, 3)) - mean**2
            low, high = windows.min((2, 3)), windows.max((2, 3))
            with np.errstate(invalid="ignore", divide="ignore"):
                c = np.einsum("ijkl,kl->ij", windows, centred) / (np.sqrt(spread) * side * size)
            c = np.where((low < high) & np.isfinite(c), np.round(c, 6), -np.inf)  # NaN compares as not less
            best = int(np.argmax(c))
            reject = "flat"
            if np.isfinite(c.flat[best]):
                place, score = (y + best // c.shape[1], x + best % c.shape[1]), float(c.flat[best])
                reject = "score" if score < least else "edge" if h - place[0] - side > reach else None
        return {"row_": np.nan if place[0] is None else place[0], "col_": np.nan if place[1] is None else place[1], "score": np.nan if score is None else score, "reject": np.array([reject], object)}

    return by_image(images, kernel, "row_ long, col_ long, score double, reject string")


#: The eight and the four neighbours of a pixel.
AROUND = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)
BESIDE = ((-1, 0), (1, 0), (0, -1), (0, 1))


def parts_of(mask: np.ndarray, near: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Labels from 1, in reading order, of the set pixels that meet by the steps ``near``; 0 elsewhere. All links are taken at once:
    each round hangs roots on their least linked root, until no link joins two roots."""
    (h, w), n = mask.shape, int(mask.sum())
    place = np.zeros(mask.shape, np.int64)
    place[mask] = np.arange(n)
    ends = [np.zeros((0, 2), np.int64)]
    for d, e in near:
        here = (slice(max(0, -d), h - max(0, d)), slice(max(0, -e), w - max(0, e)))
        there = (slice(max(0, d), h - max(0, -d)), slice(max(0, e), w - max(0, -e)))
        both = mask[here] & mask[there]
        ends.append(np.stack((place[here][both], place[there][both]), 1))
    link = np.concatenate(ends)
    link = link[link[:, 0] < link[:, 1]]  # ``near`` holds each step's opposite too
    root = np.arange(n)
    while len(link):
        np.minimum.at(root, link[:, 1], link[:, 0])
        while (root[root] != root).any():
            root = root[root]
        link = np.sort(root[link], axis=1)
        link = link[link[:, 0] < link[:, 1]]
    label = np.zeros(mask.shape, np.int64)
    label[mask] = np.unique(root, return_inverse=True)[1] + 1
    return label


def _outline_area(shape: np.ndarray) -> float:
    """Area inside the outline through the centres of a filled shape's border pixels: a square of four set pixels is 1, of three a half."""
    four = shape[:-1, :-1].astype(int) + shape[1:, :-1] + shape[:-1, 1:] + shape[1:, 1:]
    return float((four == 4).sum() + 0.5 * (four == 3).sum())


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull of (x, y) points: that of each x's least and greatest y."""
    order = points[np.lexsort((points[:, 1], points[:, 0]))]
    fresh = order[1:, 0] != order[:-1, 0]
    order = order[np.append(True, fresh) | np.append(fresh, True)]

    def chain(side: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(chain(order) + chain(order[::-1]) or [order[0]], float)
    x, y = ring.T
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def solidity(images: DataFrame, threshold: int) -> DataFrame:
    """img, outline, hull, solidity of the bright mask's largest part: the area in its outer outline (holes count as filled), that of
    the outline's convex hull, and their quotient, the hull's area being 1 at least. Parts hang together by eight neighbours; the
    largest is the first in reading order of those with the largest outline."""
    def kernel(image: np.ndarray) -> Found:
        py, px = np.nonzero(image > threshold)
        if not len(py):
            return None
        mask = np.zeros((int(py.max() - py.min()) + 3, int(px.max() - px.min()) + 3), bool)
        mask[py - py.min() + 1, px - px.min() + 1] = True
        label = parts_of(mask, AROUND)
        y, x = np.nonzero(label)
        order = np.argsort(label[y, x], kind="stable")
        parts = np.split(np.stack((y, x), 1)[order], np.flatnonzero(np.diff(label[y, x][order])) + 1)
        # the pixels of a square of four meet, so a square belongs to one part; squares of one, three and two opposite pixels tell
        # whether a part has holes (its Euler number is under 1)
        square = np.stack((label[:-1, :-1], label[:-1, 1:], label[1:, 1:], label[1:, :-1]))
        of, size = square.max(0), (square > 0).sum(0)
        opposite = (size == 2) & ((square[0] > 0) == (square[2] > 0))
        count = lambda which: np.bincount(of[which], minlength=len(parts) + 1)[1:]
        areas = count(size == 4) + 0.5 * count(size == 3)
        holes = count(size == 1) - count(size == 3) - 2 * count(opposite) < 4
        # no outline is larger than its part's box; the rest of the parts with holes, by descending box, cannot win
        best = max([float(a) for a in areas[~holes]], default=-1.0)
        for i, most in sorted(((i, float(np.prod(np.ptp(parts[i], axis=0)))) for i in np.flatnonzero(holes)), key=lambda r: -r[1]):
            if most < best:
                break
            box = np.zeros(np.ptp(parts[i], axis=0) + 3, bool)  # a border around the part belongs to the outside
            box[tuple((parts[i] - parts[i].min(0) + 1).T)] = True
            areas[i] = _outline_area(parts_of(~box, BESIDE) != 1)
            best = max(best, float(areas[i]))
        first = int(np.flatnonzero(areas == best)[0])
        hull = hull_area(parts[first])
        return {"outline": best, "hull": hull, "solidity": best / max(hull, 1.0)}

    return by_image(images, kernel, "outline double, hull double, solidity double")


def health(images: DataFrame, pixels: DataFrame) -> DataFrame:
    """w, h, n, blank, place for each size of the images with pixels (img, py, px, v): how many there are, how many have one value only,
    and the place by (n descending, w, h); and a row without size and place for the images without pixels."""
    size = pixels.groupBy("img").agg((F.max("px") + 1).alias("w"), (F.max("py") + 1).alias("h"), (F.min("v") == F.max("v")).alias("one"))
    counts = images.select("img").join(size, "img", "left").groupBy("w", "h").agg(F.count("*").alias("n"), F.count_if("one").alias("blank"))
    # a row for each size of image, not for each image
    order = Window.orderBy(F.col("w").isNull(), F.desc("n"), "w", "h")
    return counts.withColumn("place", F.when(F.col("w").isNotNull(), F.row_number().over(order)))
