"""Bounded assignment equals all distances and needs few of them; seeding and fitting of vectors of any length."""

import numpy as np
import pytest

from pelagia.operators import codebook as C


def clusters(n: int, k: int, width: int, seed: int = 1):
    rng = np.random.default_rng(seed)
    middle = rng.uniform(-50, 50, (k, width))
    return (middle[rng.integers(0, k, n)] + rng.normal(0, 0.3, (n, width))).round(4)


@pytest.mark.parametrize("width", [1, 3, 45])
def test_bounded_assignment_is_exact(width):
    x, at = clusters(600, 40, width), clusters(300, 40, width)
    at[5] = at[9]  # a tie
    names = np.random.default_rng(3).permutation(1000)[:300]
    name, d, took = C.Groups(names, at).nearest(x)
    every = np.abs(x[:, None] - at[None]).sum(2).round(9)
    want = [min(zip(row, names, strict=True)) for row in every.tolist()]
    assert [(a, b) for a, b in zip(d.tolist(), name.tolist(), strict=True)] == [(a, int(b)) for a, b in want]
    assert took < every.size / (1 if width == 1 else 4)


def frame(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "gid long, v array<double>").repartition(4)


def test_fit_equals_plain_rounds(spark):
    x = clusters(400, 8, 9)
    df, at = frame(spark, x), {i: x[i] for i in range(0, 80, 10)}
    found, centres = C.fit(df, spark.createDataFrame([(c, v.tolist()) for c, v in at.items()], "c long, v array<double>"), 3)
    for _ in range(3):
        own = [min((round(float(np.abs(p - v).sum()), 9), c) for c, v in at.items())[1] for p in x]
        at = {c: x[[o == c for o in own]].mean(0).round(9) for c in set(own)}
    own = [min((round(float(np.abs(p - v).sum()), 9), c) for c, v in at.items())[1] for p in x]
    assert {r.gid: r.c for r in found.collect()} == dict(enumerate(own))
    got = {r.c: np.array(r.v) for r in centres.collect()}
    assert set(got) == set(at) and all(np.allclose(got[c], at[c], atol=2e-9) for c in at)
    codes = {r.c: r for r in C.quantised(centres, 6).collect()}
    low, high = min(v.min() for v in at.values()), max(v.max() for v in at.values())
    assert all(codes[c].q == np.rint((v - low) / (high - low) * 63).astype(int).tolist() for c, v in at.items())


def test_seeds_find_the_clusters(spark):
    x = clusters(500, 6, 4, 7)
    df = frame(spark, x)
    first = C.seeds(df, 6)
    again = C.seeds(df.repartition(1), 6)
    assert first.count() == 6 and sorted(r.c for r in first.collect()) == sorted(r.c for r in again.collect())
    _, centres = C.fit(df, C.seeds(df, 12), 2)
    assert C.assign(df, centres).agg({"d": "avg"}).first()[0] < 4.0  # of 150 between clusters


def test_refusals(spark, monkeypatch):
    df = frame(spark, clusters(5, 2, 3))
    with pytest.raises(ValueError):
        C.assign(df, spark.createDataFrame([], "c long, v array<double>"))
    monkeypatch.setattr(C, "NUMBERS", 2)
    with pytest.raises(ValueError):
        C.assign(df, spark.createDataFrame([(1, [0.0] * 3)], "c long, v array<double>"))
