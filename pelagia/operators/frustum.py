"""Cameras meet only the splats that they may see: a tree of boxes, tested against each camera's frustum.

Splats fall into the leaves of a k-d tree (cut by a bounded sample, see ``kdtree``). A leaf's box and largest scale come from its
splats, a node's from its children. A camera goes down the tree and leaves out a node whose box lies behind the near plane, or whose
projection, widened by the largest radius that its splats can have there, misses the image. The test never leaves out a splat that is
seen: depths are bounded from below, slopes by the clamp of the projection, and the radius by the trace of its Jacobian.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pelagia.operators.kdtree import MOST, SAMPLE, Tree
from pelagia.session import written

LEAF = 4096


class Boxes:
    """A tree whose nodes have the boxes and largest scales of what lies in them."""

    def __init__(self, tree: Tree, rows: list):
        n = len(tree.axis)
        self.tree, self.low, self.high, self.scale = tree, np.full((n, 3), np.inf), np.full((n, 3), -np.inf), np.zeros(n)
        for r in rows:
            self.low[r.leaf], self.high[r.leaf], self.scale[r.leaf] = (r.lx, r.ly, r.lz), (r.hx, r.hy, r.hz), r.s
        for k in range(n - 1, -1, -1):  # children come after their parents
            if tree.axis[k] >= 0:
                a, b = tree.child[k]
                self.low[k], self.high[k] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])
                self.scale[k] = max(self.scale[a], self.scale[b])

    def seen(self, cam: dict, near: float) -> list[int]:
        """The leaves that a camera may see into."""
        turn = np.array([[cam["ca"], 0, cam["sa"]], [0, 1, 0], [-cam["sa"], 0, cam["ca"]]])
        shift, size = np.array([cam["tx"], cam["ty"], cam["tz"]]), np.array([cam["width"], cam["height"]], float)
        focal, middle = np.array([cam["fx"], cam["fy"]]), np.array([cam["cx"], cam["cy"]])
        spread = (focal**2 * (1 + (2 * size / focal) ** 2)).sum()  # of the Jacobian at depth 1
        found, todo = [], [0]
        while todo:
            k = todo.pop()
            if self.low[k, 0] > self.high[k, 0]:
                continue
            half = (self.high[k] - self.low[k]) / 2
            at, reach = turn @ ((self.high[k] + self.low[k]) / 2) + shift, np.abs(turn) @ half + 1e-6
            deep = at[2] + reach[2]
            if deep <= near:
                continue
            close = max(at[2] - reach[2], near)
            low, high = at[:2] - reach[:2], at[:2] + reach[:2]
            low, high = low / np.where(low >= 0, deep, close), high / np.where(high >= 0, close, deep)
            radius = 3 * np.sqrt(spread * (self.scale[k] / close) ** 2 + 1.0) + 2
            if (focal * high + middle + radius <= 0).any() or (focal * low + middle - radius >= size).any():
                continue
            if self.tree.axis[k] < 0:
                found.append(k)
            else:
                todo += self.tree.child[k].tolist()
        return found


def pairs(cams: DataFrame, splats: DataFrame, near: float = 0.01, leaf: int = LEAF) -> DataFrame:
    """Camera columns and splat columns of all pairs that may be seen: a part of the product, with every pair of it whose radius is not 0."""
    spark = splats.sparkSession
    n = splats.count()
    leaves = max(1, min(-(-n // leaf), MOST // SAMPLE))
    share = min(1.0, SAMPLE * leaves / max(n, 1))
    drawn = splats.where(F.pmod(F.xxhash64("gid"), F.lit(1 << 30)) < int(share * (1 << 30))).select("x", "y", "z").collect() if leaves > 1 else []  # MOST rows and some
    tree = Tree(np.array([tuple(r) for r in drawn], float).reshape(-1, 3), max(1, len(drawn) // leaves), np.full(3, -np.inf), np.full(3, np.inf))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.stack([batch.column(a).to_numpy(zero_copy_only=False).astype(float) for a in "xyz"], axis=1).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.leaf(at))], [*batch.schema.names, "leaf"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in splats.schema)
    placed = written(splats.mapInArrow(place, schema + ", leaf long"))
    sides = [f(a).alias(m + a) for a in "xyz" for f, m in ((F.min, "l"), (F.max, "h"))]
    boxes = Boxes(tree, placed.groupBy("leaf").agg(*sides, F.max(F.greatest("sx", "sy", "sz")).alias("s")).collect())  # a row a leaf
    known = spark.sparkContext.broadcast(boxes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seen = known.value.seen(row, near)
                yield pa.RecordBatch.from_arrays([pa.array([row["cam"]] * len(seen), batch.schema.field("cam").type), pa.array(seen, pa.int64())], ["cam", "leaf"])

    met = written(cams.mapInArrow(look, f"cam {cams.schema['cam'].dataType.simpleString()}, leaf long"))
    return placed.join(met, "leaf").drop("leaf").join(cams, "cam")
