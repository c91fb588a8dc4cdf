"""Nearest neighbours by k-d splits are exact: one spot with a third of all points, several leaves, far and empty clouds."""

import numpy as np
import pytest

from pelagia.operators import kdtree as K


def cloud(n: int, seed: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 5, (n, 3)).round(2)
    at[::3] = [1.0, 2.0, 3.0]
    at[1::9] = at[1::9] * 0.01
    return [(i, *map(float, p)) for i, p in enumerate(at)]


def plain(queries, points, k):
    ids, at = np.array([p[0] for p in points]), np.array([p[1:] for p in points])
    out = {}
    for q, *xyz in queries:
        d = ((at - np.array(xyz)) ** 2).sum(1).round(9)
        for rank, i in enumerate(np.lexsort((ids, d))[:k]):
            out[q, rank + 1] = (int(ids[i]), float(d[i]))
    return out


def got(df):
    return {(r.qid, r["rank"]): (r.pid, r.d2) for r in df.collect()}


SCHEMA = "pid long, x double, y double, z double"


@pytest.mark.parametrize(("k", "leaf"), [(4, 50_000), (4, 40), (1, 7), (12, 60)])
def test_own_cloud(spark, k, leaf):
    rows = cloud(500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(K.nearest(df, df, k, leaf)) == plain(rows, rows, k)


def test_other_cloud_few_points_and_nulls(spark):
    points, queries = cloud(90, 2), [(i, 100.0 + i, -50.0, 3.0) for i in range(5)] + [(9, 0.0, 0.0, 0.0), (10, 0.0, 0.0, 0.0)]
    p, q = spark.createDataFrame(points, SCHEMA), spark.createDataFrame([*queries, (11, None, 0.0, 0.0)], SCHEMA)
    assert got(K.nearest(q, p, 5, 10)) == plain(queries, points, 5)
    assert got(K.nearest(q, p.limit(2), 5, 10)).keys() == {(i, r) for i, *_ in queries for r in (1, 2)}
    assert K.nearest(q, p.limit(0), 3).collect() == [] and K.nearest(q.limit(0), p, 3).collect() == []


def test_no_leaf_is_dense():
    at = np.array([p[1:] for p in cloud(9000)])
    at = np.unique(at, axis=0)
    tree = K.Tree(at[::3], len(at) // 3 // 32, np.full(3, -np.inf), np.full(3, np.inf))
    sizes = np.bincount(tree.leaf(at))
    sizes = sizes[sizes > 0]
    assert len(sizes) >= 32 and sizes.max() <= 2.5 * sizes.mean()


def test_leaves_that_balls_meet():
    rng = np.random.default_rng(5)
    at = rng.uniform(0, 1, (400, 3))
    tree = K.Tree(at, 10, np.full(3, -np.inf), np.full(3, np.inf))
    d2 = rng.uniform(0, 0.05, 400)
    query, leaf = tree.meeting(at, d2)
    own = tree.leaf(at)
    met = set(zip(query.tolist(), leaf.tolist(), strict=True))
    for i in range(400):
        near = np.flatnonzero(((at - at[i]) ** 2).sum(1) <= d2[i])
        assert all((i, int(own[j])) in met for j in near)
