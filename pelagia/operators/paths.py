"""Camera paths from a table of poses: pid, x, y, z (the centre) and r0 .. r8 (camera to world, by rows; the third column looks back).

What a path needs of the poses is a row of sums and percentiles, so any number of poses gives a path by expressions over its
frames. A path's rows are i, x, y, z and the axes r0 .. r8.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Row, functions as F

from pelagia.operators.selection import of_columns

Vector = list[Column]
R9 = [f"r{k}" for k in range(9)]
#: Key poses of a spline at most: its equations are solved on the driver.
KEY_POSES = 2000


def _cross(a: Vector, b: Vector) -> Vector:
    return [a[(k + 1) % 3] * b[(k + 2) % 3] - a[(k + 2) % 3] * b[(k + 1) % 3] for k in range(3)]


def _unit(a: Vector) -> Vector:
    n = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    return [c / n for c in a]


def _frames(poses: DataFrame, n: int) -> DataFrame:
    return poses.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))


def _placed(frames: DataFrame, at: Vector, axes: Vector) -> DataFrame:
    return frames.select("i", *(c.alias(n) for c, n in zip([*at, *axes], [*"xyz", *R9], strict=True)))


def _looking(frames: DataFrame, at: Vector, target: Vector, up: Vector, sign: int = 1) -> DataFrame:
    """Frames at ``at`` whose third axis points away from the target (towards it for sign -1) and whose second is near ``up``. Each
    step is a projection of its own, so that no expression repeats the ones before."""
    v = lambda n: [F.col(f"{n}{k}") for k in range(3)]
    put = lambda n, cs: {f"{n}{k}": c for k, c in enumerate(cs)}
    df = frames.withColumns(put("at", at) | put("to", target) | put("up", up))
    df = df.withColumns(put("back", [sign * (a - b) for a, b in zip(v("at"), v("to"), strict=True)]))
    df = df.withColumns(put("c", _unit(v("back"))))
    df = df.withColumns(put("side", _cross(v("up"), v("c"))))
    df = df.withColumns(put("a", _unit(v("side"))))
    df = df.withColumns(put("b", _cross(v("c"), v("a"))))
    return _placed(df, v("at"), [F.col(f"{n}{k}") for k in range(3) for n in "abc"])


def centre_of_view(poses: DataFrame) -> np.ndarray:
    """The point nearest to all viewing axes: the projections onto the planes across them, summed, give three equations."""
    d, p = ["r2", "r5", "r8"], list("xyz")
    along = sum((F.col(a) * F.col(b) for a, b in zip(d[1:], p[1:], strict=True)), F.col(d[0]) * F.col(p[0]))
    squares = [F.sum(F.col(d[a]) * F.col(d[b])) for a in range(3) for b in range(3)]
    row = poses.agg(F.count("*").alias("n"), *(c.alias(f"s{k}") for k, c in enumerate(squares)), *(F.sum(F.col(c) - F.col(e) * along).alias(f"t{k}") for k, (c, e) in enumerate(zip(p, d, strict=True)))).first()
    return np.linalg.solve(row.n * np.eye(3) - np.array([row[f"s{k}"] for k in range(9)]).reshape(3, 3), [row[f"t{k}"] for k in range(3)])


def _lits(values) -> Vector:
    return [F.lit(float(v)) for v in values]


def spiral(poses: DataFrame, n: int, near: float, far: float, turns: float = 2.0, rise: float = 0.5, focus: float = 0.75) -> DataFrame:
    """n frames on a spiral before the mean pose, whose radii are the 90th percentiles of the centres' coordinates; all look at the point
    ahead whose inverse distance lies by the share ``focus`` between those of the near and the far bound."""
    row = poses.agg(*(F.avg(c).alias(c) for c in [*"xyz", *R9])).first()
    radius = of_columns(poses, {c: F.abs(c) for c in "xyz"}, [0.9])
    back, up = np.array([row.r2, row.r5, row.r8]), np.array([row.r1, row.r4, row.r7])
    side = np.cross(up, back)
    mean = np.stack([c / np.linalg.norm(c) for c in (side, np.cross(back, side), back)], 1)
    centre = np.array([row.x, row.y, row.z])
    t = F.col("i") * (2 * math.pi * turns / n)
    local = [radius["x"][0] * F.cos(t), -radius["y"][0] * F.sin(t), -radius["z"][0] * F.sin(rise * t)]
    at = [float(m[0]) * local[0] + float(m[1]) * local[1] + float(m[2]) * local[2] + float(c) for m, c in zip(mean, centre, strict=True)]
    aim = centre - mean[:, 2] / ((1 - focus) / near + focus / far)
    return _looking(_frames(poses, n), at, _lits(aim), _lits(up))


def ellipse(poses: DataFrame, n: int, axis: str = "z", height: float = 0.0, variation: float = 0.0, phase: float = 0.0) -> DataFrame:
    """n frames on an ellipse across ``axis`` (z or y) around the centre of view, whose half axes are the 90th percentiles of the centres'
    distances from it. Along the axis they are at ``height``, plus ``variation`` times a wave between the 10th and the 90th percentile.
    The up vector is the coordinate axis that the mean one is nearest to. Around z the third axis looks away from the path to the
    centre, around y from the centre to the path."""
    centre, k = centre_of_view(poses), "xyz".index(axis)
    plane = [c for c in range(3) if c != k]
    row = poses.agg(*(F.avg(c).alias(c) for c in ("r1", "r4", "r7"))).first()
    found = of_columns(poses, {f"p{c}": F.abs(F.col("xyz"[c]) - float(centre[c])) for c in plane} | {"along": F.col(axis)}, [0.1, 0.9])
    t, (low, high) = F.col("i") * (2 * math.pi / n), found["along"]
    at = [F.lit(0.0)] * 3
    at[plane[0]] = float(centre[plane[0]]) + found[f"p{plane[0]}"][1] * F.cos(t)
    at[plane[1]] = float(centre[plane[1]]) + found[f"p{plane[1]}"][1] * F.sin(t)
    at[k] = height + variation * (low + (high - low) * (0.5 * F.cos(t + 2 * math.pi * phase) + 0.5))
    mean = np.array([row.r1, row.r4, row.r7])
    up = np.zeros(3)
    up[np.abs(mean).argmax()] = np.sign(mean[np.abs(mean).argmax()])
    return _looking(_frames(poses, n), at, _lits(centre), _lits(up), 1 if axis == "y" else -1)


def shifted(poses: DataFrame, shift: tuple[float, float, float]) -> DataFrame:
    """The poses whose world-to-camera translations are moved by ``shift``: a centre moves by the rotated shift, backwards."""
    moved = [F.col(c) - (F.col(R9[3 * k]) * shift[0] + F.col(R9[3 * k + 1]) * shift[1] + F.col(R9[3 * k + 2]) * shift[2]) for k, c in enumerate("xyz")]
    return poses.select("pid", *(m.alias(c) for m, c in zip(moved, "xyz", strict=True)), *R9)


def straight(poses: DataFrame, n: int, like: int, amplitude: float = 0.0, waves: float = 1.0) -> DataFrame:
    """n frames from the first pose to the last but one, turned as the pose ``like``, on a sine along y if there is an amplitude."""
    first, last = poses.orderBy("pid").first(), poses.orderBy(F.desc("pid")).take(2)[-1]
    turn = poses.where(F.col("pid") == like).first()
    t = F.col("i") / float(max(n - 1, 1))
    at = [first[c] * (1 - t) + last[c] * t for c in "xyz"]
    at[1] = at[1] + amplitude * F.sin(2 * math.pi * waves * t)
    return _placed(_frames(poses, n), at, _lits(turn[c] for c in R9))


def _basis(knots: np.ndarray, degree: int, u: np.ndarray) -> np.ndarray:
    """[place, k]: the B-splines of the knots at places u of [0, 1]; the last interval is closed."""
    n = len(knots) - degree - 1
    at = np.clip(np.searchsorted(knots, u, "right") - 1, degree, n - 1)
    out = np.zeros((len(u), len(knots) - 1))
    out[np.arange(len(u)), at] = 1.0
    for d in range(1, degree + 1):
        width = knots[d:] - knots[:-d]
        share = np.divide(u[:, None] - knots[None, : len(width)], width, out=np.zeros((len(u), len(width))), where=width > 0)
        out = share[:, :-1] * out[:, : len(width) - 1] + np.where(width[1:] > 0, 1 - share[:, 1:], 0.0) * out[:, 1 : len(width)]
    return out


def interpolated(poses: DataFrame, each: int, degree: int = 5, reach: float = 0.1) -> DataFrame:
    """each x (poses - 1) frames on the B-spline through the poses in order of pid: centres and points ``reach`` ahead and above are
    interpolated by the length of the way, and give the axes. Without smoothing; ``KEY_POSES`` poses at most."""
    keys = poses.orderBy("pid").limit(KEY_POSES + 1).collect()
    if len(keys) > KEY_POSES or len(keys) < 2:
        raise ValueError(f"a spline takes 2 to {KEY_POSES} poses")
    p = np.array([[k[c] for c in "xyz"] for k in keys])
    turn = np.array([[k[c] for c in R9] for k in keys]).reshape(-1, 3, 3)
    points = np.concatenate((p, p - reach * turn[:, :, 2], p + reach * turn[:, :, 1]), 1)
    step = np.sqrt(((points[1:] - points[:-1]) ** 2).sum(1))
    u = np.append(0.0, np.cumsum(step) / step.sum())
    degree = min(degree, len(u) - 1)
    # as many B-splines as poses: knots at inner poses, or halfway between them where the degree is even
    half = degree // 2
    inner = u[half + 1 : len(u) - half - 1] if degree % 2 else (u[half : len(u) - half - 1] + u[half + 1 : len(u) - half]) / 2
    knots = np.concatenate((np.zeros(degree + 1), inner, np.ones(degree + 1)))
    weights = np.linalg.solve(_basis(knots, degree, u), points)
    n = each * (len(u) - 1)
    found = (_basis(knots, degree, np.arange(n) / n) @ weights).tolist()
    rows = poses.sparkSession.createDataFrame([(i, *row) for i, row in enumerate(found)], "i int, " + ", ".join(f"{k}{c} double" for k in "plu" for c in "xyz"))
    return _looking(rows, *([F.col(f"{k}{c}") for c in "xyz"] for k in "pl"), [F.col(f"u{c}") - F.col(f"p{c}") for c in "xyz"])
