"""Exact nearest neighbours by a k-d split of the space that follows the points, so that no task has a dense spot.

Points of one position are one: it keeps its ``k`` least ids, which is all that any query can ask for. A tree is cut at the medians of a
sample (``SAMPLE`` positions a leaf, at most ``MOST`` in all, by hashes of the position), for about ``LEAF`` positions a leaf; it has no
more than 2 MOST / SAMPLE nodes, which bounds its broadcast. A query first finds its k nearest in its own leaf. That gives a ball, and where the ball
crosses the leaf's box, the query goes to the other leaves that the ball meets, as the proof asks. A leaf with many queries has
several tasks. Inside a task, points lie in boxes of ``BOX`` by the same splits, and a box of queries looks into those within its reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pelagia.session import written

LEAF, SAMPLE, MOST, BOX = 50_000, 64, 1 << 20, 64
AXES = ["x", "y", "z"]
#: Distances are compared to nine digits; a ball is wider by as much.
SLACK = 2e-9


class Tree:
    """Median splits of ``at`` [n, 3] down to ``size`` points: axis (-1 for a leaf), cut, and the children's places; boxes of all nodes."""

    def __init__(self, at: np.ndarray, size: int, low: np.ndarray, high: np.ndarray):
        self.axis, self.cut, self.child, self.low, self.high = [], [], [], [], []
        self._split(at, max(1, size), low.copy(), high.copy())
        self.axis, self.cut, self.child = np.array(self.axis), np.array(self.cut), np.array(self.child).reshape(-1, 2)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.leaves = np.flatnonzero(self.axis < 0)

    def _split(self, at: np.ndarray, size: int, low: np.ndarray, high: np.ndarray) -> int:
        me = len(self.axis)
        self.axis.append(-1)
        self.cut.append(0.0)
        self.child.append((0, 0))
        self.low.append(low)
        self.high.append(high)
        if len(at) > size:
            axis = int(np.argmax(at.max(0) - at.min(0)))
            cut = float(np.median(at[:, axis]))
            left = at[:, axis] < cut
            if left.any() and not left.all():
                below, above = high.copy(), low.copy()
                below[axis] = above[axis] = cut
                self.axis[me], self.cut[me] = axis, cut
                a = self._split(at[left], size, low, below)
                self.child[me] = (a, self._split(at[~left], size, above, high))
        return me

    def leaf(self, at: np.ndarray) -> np.ndarray:
        """The leaf that each point falls into."""
        node = np.zeros(len(at), np.int64)
        live = np.flatnonzero(self.axis[node] >= 0)
        while len(live):
            own = node[live]
            node[live] = self.child[own, (at[live, self.axis[own]] >= self.cut[own]).astype(int)]
            live = live[self.axis[node[live]] >= 0]
        return node

    def meeting(self, at: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves whose box a query's ball meets."""
        query, node, found = np.arange(len(at)), np.zeros(len(at), np.int64), []
        while len(query):
            gap = np.maximum(0, np.maximum(self.low[node] - at[query], at[query] - self.high[node]))
            near = (gap**2).sum(1) <= d2[query] + SLACK
            query, node = query[near], node[near]
            end = self.axis[node] < 0
            found.append((query[end], node[end]))
            query, node = np.repeat(query[~end], 2), self.child[node[~end]].ravel()
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def k_nearest(queries: np.ndarray, points: np.ndarray, first: np.ndarray, k: int, d2: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query the places of its k nearest points by (distance to nine digits, first), within d2 if given. Exact: a box of queries
    looks into every box of points within the reach of its furthest k-th neighbour."""
    low, high = points.min(0), points.max(0)
    tree = Tree(points, BOX, low, high)
    own = tree.leaf(points)
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.append(tree.leaves, tree.leaves[-1] + 1))
    # tight boxes of what lies in each leaf
    members = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    lows = np.stack([points[m].min(0) for m in members])
    highs = np.stack([points[m].max(0) for m in members])
    counts = np.array([len(m) for m in members])
    out: list = [None] * len(queries)
    at = tree.leaf(queries)
    ask = np.argsort(at, kind="stable")
    for a in range(0, len(ask), 2 * BOX):
        q = ask[a : a + 2 * BOX]
        mine = queries[q]
        box_low, box_high = mine.min(0), mine.max(0)
        gap = (np.maximum(0, np.maximum(lows - box_high, box_low - highs)) ** 2).sum(1)
        near = np.argsort(gap, kind="stable")
        # enough boxes for k points, then those within the reach that they prove
        take = int(np.searchsorted(np.cumsum(counts[near]), min(k, len(points)))) + 1
        some = np.concatenate([members[i] for i in near[:take]])
        d = ((mine[:, None] - points[some][None]) ** 2).sum(2)
        kth = np.partition(d, min(k, len(some)) - 1, axis=1)[:, min(k, len(some)) - 1]
        reach = kth if d2 is None else np.minimum(kth, d2[q])
        more = near[take:][gap[near[take:]] <= reach.max() + SLACK]
        if len(more):
            rest = np.concatenate([members[i] for i in more])
            some = np.append(some, rest)
            d = np.concatenate((d, ((mine[:, None] - points[rest][None]) ** 2).sum(2)), axis=1)
        d = d.round(9)
        names = first[some]
        for row, i in enumerate(q):
            good = np.flatnonzero(d[row] <= reach[row] + SLACK)
            best = good[np.lexsort((names[good], d[row, good]))[:k]]
            out[i] = some[best]
    return out


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(a).to_numpy(zero_copy_only=False).astype(float) for a in AXES], axis=1).reshape(-1, 3)


def _placed(df: DataFrame, tree, keep: str) -> DataFrame:
    """``df`` with leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.value.leaf(_flat(batch)))], [*batch.schema.names, "leaf"])

    return df.mapInArrow(run, f"x double, y double, z double, {keep}, leaf long")


def _searched(queries: DataFrame, points: DataFrame, k: int, loads: dict[int, int]) -> DataFrame:
    """qk, d2, pids: up to k nearest positions of each query (qk, x, y, z, leaf, r2) among its leaf's points (pids, leaf). ``loads`` are the
    tasks of each leaf that has more than one."""
    spark = queries.sparkSession
    several = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in loads.items() for v in kv)), F.col("leaf")), F.lit(1)) if loads else F.lit(1)
    q = queries.withColumn("z_", F.pmod(F.xxhash64("qk"), several).cast("int"))
    p = points.withColumn("z_", F.explode(F.sequence(F.lit(0), several - 1)))

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return pa.table({"qk": pa.array([], pa.int64()), "d2": pa.array([], pa.float64()), "pids": pa.array([], pa.list_(pa.int64()))})
        at, to = (np.stack([t.column(a).to_numpy() for a in AXES], axis=1) for t in (asked, there))
        first = np.array([x[0] for x in there.column("pids").to_pylist()], np.int64)
        found = k_nearest(at, to, first, k, asked.column("r2").to_numpy())
        sizes = [len(f) for f in found]
        row, place = np.repeat(np.arange(len(at)), sizes), np.concatenate(found).astype(np.int64)
        d = ((at[row] - to[place]) ** 2).sum(1).round(9)
        return pa.table({"qk": asked.column("qk").take(pa.array(row)), "d2": pa.array(d), "pids": there.column("pids").take(pa.array(place))})

    return q.groupBy("leaf", "z_").cogroup(p.groupBy("leaf", "z_")).applyInArrow(run, "qk long, d2 double, pids array<long>")


def nearest(queries: DataFrame, points: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """qid, pid, d2, rank: the k nearest points (pid, x, y, z) of each query (pid, x, y, z) by (distance to nine digits, id). Rows with a null
    coordinate take no part."""
    spark = points.sparkSession
    place = [F.col(a).cast("double").alias(a) for a in AXES]
    rows = points.select(F.col("pid").cast("long").alias("pid"), *place).dropna()
    # the k least ids of each position: those of a task first
    least = Window.partitionBy(*AXES).orderBy("pid")
    few = rows.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k)
    spots = written(few.groupBy(*AXES).agg(F.array_sort(F.collect_list("pid")).alias("pids")))
    asked = queries.select(F.col("pid").cast("long").alias("qid"), *place).dropna()
    keyed = written(asked.select(*AXES).distinct().withColumn("qk", F.monotonically_increasing_id()))
    box = spots.agg(F.count("*").alias("n"), *(F.min(a).alias(f"l{a}") for a in AXES), *(F.max(a).alias(f"h{a}") for a in AXES)).first()
    if not box.n:
        return spark.createDataFrame([], "qid long, pid long, d2 double, rank int")
    leaves = max(1, min(-(-box.n // leaf), MOST // SAMPLE))
    share = min(1.0, SAMPLE * leaves / box.n)
    drawn = spots.where(F.pmod(F.xxhash64(*AXES), F.lit(1 << 30)) < int(share * (1 << 30))).select(*AXES) if leaves > 1 else spots.limit(0).select(*AXES)
    sample = np.array([tuple(r) for r in drawn.collect()], float).reshape(-1, 3)  # MOST rows and some
    tree = spark.sparkContext.broadcast(Tree(sample, max(1, len(sample) // leaves), np.full(3, -np.inf), np.full(3, np.inf)))
    at = written(_placed(spots.select(*AXES, "pids"), tree, "pids array<long>"))
    own = _placed(keyed.select(*AXES, "qk"), tree, "qk long").withColumn("r2", F.lit(float("inf")))

    def loads(df: DataFrame) -> dict[int, int]:
        counts = df.groupBy("leaf").count().where(F.col("count") > leaf).collect()  # a row a leaf
        return {r.leaf: -(-r["count"] // leaf) for r in counts}

    own = written(own)
    found = written(_searched(own, at, k, loads(own)))
    # the ball of each query, and the other leaves that it meets
    size = F.sum(F.size("pids"))
    balls = found.groupBy("qk").agg(F.max("d2").alias("far"), F.count("*").alias("spots"), size.alias("n"))
    balls = own.drop("r2").join(balls, "qk", "left").withColumn("r2", F.when(F.col("spots") >= k, F.col("far")).otherwise(float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xyz, mine = _flat(batch), batch.column("leaf").to_numpy(zero_copy_only=False)
            query, to = tree.value.meeting(xyz, batch.column("r2").to_numpy(zero_copy_only=False))
            other = to != mine[query]
            query, to = pa.array(query[other]), pa.array(to[other])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(query) for c in (*AXES, "qk")), to, batch.column("r2").take(query)], [*AXES, "qk", "leaf", "r2"])

    crossing = written(balls.select(*AXES, "qk", "leaf", "r2").mapInArrow(run, "x double, y double, z double, qk long, leaf long, r2 double"))
    every = found.unionByName(_searched(crossing, at, k, loads(crossing)))
    ranked = every.select("qk", "d2", F.explode("pids").alias("pid")).withColumn("rank", F.row_number().over(Window.partitionBy("qk").orderBy("d2", "pid"))).where(F.col("rank") <= k)
    best = written(ranked.groupBy("qk").agg(F.array_sort(F.collect_list(F.struct("rank", "pid", "d2"))).alias("near")))
    spot = written(keyed.join(best, "qk").select(*AXES, "near"))
    return asked.join(spot, AXES).select("qid", F.inline("near")).select("qid", "pid", "d2", "rank")
