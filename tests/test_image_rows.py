"""Operators on images as input rows: what they return, and that no pixel is exchanged."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia import catalog_of_queries as base
from pelagia.operators import image_rows as I

SCHEMA = "img long, w int, v array<smallint>"


def images(spark, n=60, seed=1):
    """Images of 16 columns and of many sizes, some of one value or with a line that is not full, and one without pixels."""
    rng = np.random.default_rng(seed)
    rows = [(k, 16, [int(v) for v in (rng.integers(0, 256, rng.integers(1, 900)) if k % 9 else np.full(40 + k, 7))]) for k in range(n)]
    return rows, spark.createDataFrame([*rows, (n, 16, []), (n + 1, 16, None)], SCHEMA).repartition(4)


def exchanged(df) -> list[str]:
    """The columns of each shuffle in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hash" in line or "Exchange range" in line]


def test_rounding_is_that_of_spark(spark):
    x = np.concatenate((np.arange(-40, 40) / 128, np.arange(-9, 9) * 5e-7, np.random.default_rng(1).normal(size=300), [0.0, -0.0, -1e-9]))
    want = [r.y for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").coalesce(1).orderBy("i").select(F.round("x", 6).alias("y")).collect()]
    assert I.rounded(x, 6).tolist() == want and not np.signbit(I.rounded(np.array([-0.0, -1e-9]), 6)).any()
    assert I.rounded(np.array([0.0000005]), 6)[0] == float(Decimal("0.000001"))


def test_static_likeness_against_plain_medians(spark, monkeypatch):
    rows, df = images(spark)
    at = {}
    for _, _, v in rows:
        for i, x in enumerate(v):
            at.setdefault(i, []).append(x)
    middle = {i: float(np.median(x)) for i, x in at.items()}
    medians = {(r.py, r.px): (r.m, r.n) for r in I.pixel_medians(df).collect()}
    assert medians == {(i // 16, i % 16): (middle[i], len(x)) for i, x in at.items()}
    want = {}
    for k, _, v in rows:
        m = np.array([middle[i] for i in range(len(v))])
        if len(set(v)) > 1 and len(set(m)) > 1:
            want[k] = (round(float(np.corrcoef(v, m)[0, 1]), 9), round(float(np.std(v)), 9))
    for places in (I.PLACES, 10):  # medians broadcast, and joined
        monkeypatch.setattr(I, "PLACES", places)
        found = I.static_likeness(df)
        assert {r.img: (round(r.c, 9), round(r.s, 9)) for r in found.collect()} == want
        assert bool(exchanged(found)) == (places == 10)
    assert I.static_likeness(df.where("size(v) = 0")).count() == 0


#: Queries of images by themselves.
NAMES = ["ag_static_corr", "sc_color_correct", "ag_ssim", "flt_undistort_fisheye", "flt_undistort", "sc_cart_sector_to_polar", "flt_random_patch", "sc_depth_to_normal", "wn_median_filter", "ag_template_match", "sc_depth_to_points", "ag_mask_props", "ag_edge_profile", "ag_mount_row", "ag_mask_solidity", "wn_edge_peaks", "wn_edge_scan"]


@pytest.mark.parametrize("name", NAMES)
def test_no_pixel_is_a_row_of_an_exchange(spark, name):
    plan = base.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and not [line for line in plan.splitlines() if "Exchange hash" in line and "img" in line]
