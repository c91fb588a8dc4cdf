"""Codebooks of vectors of any length by k-means in the Manhattan metric, with bounded assignment and parallel seeding.

Centres are grouped around pivots. By the triangle inequality no centre of a group is nearer to a point than its distance to the pivot
less the group's radius, so a point looks into groups in order of that bound and stops where it exceeds the best so far. The
result is that of all distances; only few are computed. A pass over the points labels them and sums them by centre in the same
batches, so a round exchanges a row for each centre and coordinate that a task met. Centres are broadcast; ``NUMBERS`` bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pelagia.operators.extended import uniform
from pelagia.session import written

#: Coordinates of all centres at most (64 MB).
NUMBERS = 1 << 23
CHUNK = 1 << 20


def _l1(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All Manhattan distances, a coordinate at a time."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        out += np.abs(x[:, j, None] - y[None, :, j])
    return out


class Groups:
    """Centres (names, vectors) around the square root of their number of pivots."""

    def __init__(self, names: np.ndarray, at: np.ndarray):
        order = np.argsort(names)
        names, at = names[order], at[order]
        pivots = at[:: max(1, int(np.ceil(np.sqrt(len(at)))))].copy()
        for _ in range(3):
            own = np.concatenate([_l1(at[k : k + 4096], pivots).argmin(1) for k in range(0, len(at), 4096)]) if len(at) else np.zeros(0, int)
            pivots = np.stack([at[own == g].mean(0) if (own == g).any() else pivots[g] for g in range(len(pivots))]) if len(at) else pivots
        own = np.concatenate([_l1(at[k : k + 4096], pivots).argmin(1) for k in range(0, len(at), 4096)]) if len(at) else np.zeros(0, int)
        used = np.unique(own)
        self.members = [(names[own == g], at[own == g]) for g in used]  # each in order of its names
        self.pivots = pivots[used]
        self.radius = np.array([_l1(self.pivots[k : k + 1], c).max() for k, (_, c) in enumerate(self.members)])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(name, distance to nine digits) of each point's nearest centre, ties to the least name, and how many distances it took."""
        best, name, took = np.full(len(x), np.inf), np.full(len(x), np.iinfo(np.int64).max), 0
        step = max(1, CHUNK // max(1, len(self.pivots)))
        for k in range(0, len(x), step):
            own = x[k : k + step]
            bound = _l1(own, self.pivots) - self.radius
            took += bound.size
            order = np.argsort(bound, axis=1)
            b, n = best[k : k + step], name[k : k + step]
            live = np.arange(len(own))
            for r in range(len(self.pivots)):
                g = order[live, r]
                near = bound[live, g] <= b[live] + 1e-8
                live, g = live[near], g[near]  # bounds rise, so who stops has done
                if not len(live):
                    break
                for h in np.unique(g):
                    rows, (names, at) = live[g == h], self.members[h]
                    for a in range(0, len(rows), max(1, CHUNK // len(names))):
                        part = rows[a : a + max(1, CHUNK // len(names))]
                        d = _l1(own[part], at).round(9)
                        took += d.size
                        j = d.argmin(1)
                        d, c = d[np.arange(len(part)), j], names[j]
                        better = (d < b[part]) | ((d == b[part]) & (c < n[part]))
                        b[part[better]], n[part[better]] = d[better], c[better]
        return name, best, took


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if n and len(values) % n:
        raise ValueError("all vectors have one length")
    return values.reshape(n, -1) if n else np.zeros((0, 0))


def _shared(points: DataFrame, centres: DataFrame):
    rows = centres.select("c", "v").orderBy("c").collect()  # bounded below
    if rows and len(rows) * len(rows[0].v) > NUMBERS:
        raise ValueError(f"a codebook has at most {NUMBERS} numbers")
    if not rows:
        raise ValueError("a codebook needs a centre")
    return points.sparkSession.sparkContext.broadcast(Groups(np.array([r.c for r in rows], np.int64), np.array([list(r.v) for r in rows], float)))


def assign(points: DataFrame, centres: DataFrame) -> DataFrame:
    """gid, c, d, took: each point's (gid, v) nearest centre (c, v), its distance to nine digits, and, in the first row of a batch, the distances
    that were computed for the batch."""
    shared = _shared(points, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                name, d, took = shared.value.nearest(_matrix(batch.column("v")))
                first = np.zeros(batch.num_rows, np.int64)
                first[0] = took
                yield pa.RecordBatch.from_arrays([batch.column("gid"), pa.array(name), pa.array(d), pa.array(first)], ["gid", "c", "d", "took"])

    return points.select(F.col("gid").cast("long").alias("gid"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "gid long, c long, d double, took long")


def means(points: DataFrame, centres: DataFrame) -> DataFrame:
    """c, v: the mean (to nine digits) of the points nearest to each centre; a centre without points goes."""
    shared = _shared(points, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            names, own, n = np.unique(shared.value.nearest(x)[0], return_inverse=True, return_counts=True)
            sums = np.stack([np.bincount(own, x[:, j], len(names)) for j in range(x.shape[1])], axis=1)
            width = x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, width)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(names))), pa.array(sums.ravel()), pa.array(np.repeat(n, width))], ["c", "j", "s", "n"])

    parts = points.select(F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "c long, j int, s double, n long")
    each = parts.groupBy("c", "j").agg(F.round(F.sum("s") / F.sum("n"), 9).alias("m"))
    return each.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda x: x["m"]).alias("v"))


def seeds(points: DataFrame, k: int, rounds: int = 4, seed: str = "seed") -> DataFrame:
    """c, v: k of the points as first centres. Each round takes about 2 k points by chances in proportion to their distance from those
    taken so far (hashed draws); of all taken, the k that most points are nearest to stay."""
    rows = points.select(F.col("gid").cast("long").alias("gid"), F.col("v").cast("array<double>").alias("v"))
    taken = written(rows.orderBy(uniform(seed, "gid"), "gid").limit(1).select(F.col("gid").alias("c"), "v"))
    for r in range(rounds):
        far = written(assign(rows, taken).select("gid", "d"))
        total = far.agg(F.sum("d")).first()[0] or 0.0
        if not total:
            break
        drawn = far.where((F.col("d") > 0) & (uniform(f"{seed}:{r}", "gid") < 2.0 * k * F.col("d") / total)).select("gid")
        taken = written(taken.unionByName(rows.join(drawn, "gid").select(F.col("gid").alias("c"), "v")))
    weight = assign(rows, taken).groupBy("c").agg(F.count("*").alias("n"))
    return written(taken.join(weight, "c").orderBy(F.desc("n"), "c").limit(k).select("c", "v"))


def fit(points: DataFrame, centres: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(gid, c; c, v) after ``rounds`` of assignment and means."""
    for _ in range(rounds):
        centres = written(means(points, centres))
    return assign(points, centres).select("gid", "c"), centres


def quantised(centres: DataFrame, bits: int) -> DataFrame:
    """c, q, low, high: the centres' coordinates on one grid of 2**bits levels between the extremes of all, half to even."""
    box = centres.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"))  # one row
    share = lambda x: F.coalesce(F.try_divide(x - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    return centres.crossJoin(F.broadcast(box)).select("c", F.transform("v", lambda x: F.rint(share(x) * (2**bits - 1)).cast("int")).alias("q"), "low", "high")
