"""Cells of splats: a camera meets every splat that the product shows it, and few others."""

import random

from pelagia.operators import frustum, raster
from pelagia.session import written


def test_the_same_splats_and_fewer_pairs(spark):
    rng = random.Random(4)
    n = 1500
    splats = spark.createDataFrame([(i, *(rng.gauss(0, 12) for _ in range(3)), 1.0, 0.1, 0.2, -0.1, *(0.02 if i % 50 else 4.0 for _ in range(3))) for i in range(n)], "gid long, x double, y double, z double, qw double, qx double, qy double, qz double, sx double, sy double, sz double")
    turns = [(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.6, 0.8)]
    cams = spark.createDataFrame([(k, ca, sa, 0.5, -1.0, 4.0, 60.0, 50.0, 30.0, 26.0, 64, 48) for k, (ca, sa) in enumerate(turns)], "cam int, ca double, sa double, tx double, ty double, tz double, fx double, fy double, cx double, cy double, width int, height int")
    seen = lambda df: {(r.cam, r.gid, r.radius) for r in written(raster.project(df)).where("radius > 0").select("cam", "gid", "radius").collect()}
    want = seen(raster.cameras_by_splats(cams, splats))
    for leaf in (8, 10_000):
        assert seen(frustum.pairs(cams, splats, leaf=leaf)) == want
    met = frustum.pairs(cams, splats.where("sx < 1"), leaf=8).count()
    assert len(want) > 50 and met < 0.5 * 4 * n
    assert frustum.pairs(cams, splats.limit(0)).count() == 0
