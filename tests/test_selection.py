"""Exact quantiles by counting equal those of sorted values."""

import math
import random

import numpy as np
import pytest

from pelagia.operators import selection as S


def test_bits_keep_the_order():
    values = np.array([-math.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, math.inf])
    bits = S.ordered_bits(values).view(np.uint64)
    assert (bits[1:] >= bits[:-1]).all() and bits[4] == bits[5] and len(set(bits.tolist())) == 10
    assert np.array_equal(S.doubles(S.ordered_bits(values)), values)


@pytest.mark.parametrize("broadcast", [True, False])
def test_quantiles_of_skewed_keys(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(S, "STATE", 0)
    rng = random.Random(4)
    rows = [("hot" if i % 3 else None if i % 60 == 0 else f"k{i % 7}", None if i % 31 == 0 else rng.choice([0.0, -3.5, rng.gauss(0, 1e-3), rng.gauss(0, 1e9)])) for i in range(900)]
    shares = [0.0, 0.01, 0.5, 0.9, 1.0]
    found = {r.k: (r.n, list(r.q)) for r in S.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", shares).collect()}
    keys = {k for k, v in rows if k is not None and v is not None}
    assert set(found) == keys
    for k in keys:
        own = [v for q, v in rows if q == k and v is not None]
        assert found[k][0] == len(own) and np.allclose(found[k][1], np.quantile(own, shares), rtol=1e-12, atol=0)


def test_columns_and_empty_tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (4.0, 7.0)], "a double, b double")
    assert S.of_columns(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("a") - F.col("a")}, [0.5]) == {"a": [2.0], "b": [6.0], "c": [0.0]}
    assert S.of_columns(df.limit(0), {"a": F.col("a")}, [0.1, 0.9]) == {"a": [None, None]}
    assert [tuple(r.q) for r in S.quantiles(df, [], "a", [0.25]).collect()] == [(1.5,)]
