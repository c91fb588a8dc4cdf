"""Properties that the operators keep, against numpy."""

import numpy as np
from pyspark.sql import functions as F

from pelagia.functions import geometry as G
from pelagia.operators import cloud, density, extended, kernels, model, paths, pixels, surfel, telemetry
from pelagia.plans import scene
from pelagia.plans.views import spark_view

SF = "/root/testdata/sf0.001"


def test_rotations_are_orthonormal(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(map(float, q)) for q in rng.normal(size=(20, 4))]
    df = spark.createDataFrame(rows, "w double, x double, y double, z double")
    for r in df.select(*(c.alias(f"m{i}") for i, c in enumerate(G.quat_to_rotmat(*(F.col(c) for c in "wxyz"))))).collect():
        m = np.array(r).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3)) and np.isclose(np.linalg.det(m), 1)


def test_spherical_covariance_is_the_jacobian_product(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3, 3))
    c, p = a @ a.T, np.array([1.0, -2.0, 0.5])
    df = spark.range(1).select(*(F.lit(float(v)).alias(n) for v, n in zip(p, "xyz")), *(F.lit(float(c[i, j])).alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)))
    got = df.select(*G.spherical_covariance([F.col(n) for n in "xyz"], [F.col(f"c{i}{j}") for i in range(3) for j in range(i, 3)])).first()
    f = lambda v: np.array([np.linalg.norm(v), np.arctan2(v[1], v[0]), np.arctan2(v[2], np.hypot(v[0], v[1]))])
    jac = np.stack([(f(p + e) - f(p - e)) / 2e-6 for e in 1e-6 * np.eye(3)], 1)
    want = jac @ c @ jac.T
    assert np.allclose(got, want[np.triu_indices(3)], atol=1e-6)


def test_weights_and_transmittance_sum_to_one(spark):
    w = scene.weighted(lambda name: spark_view(spark, SF, name))
    sums = w.groupBy("cam", "px", "py").agg(F.sum(F.col("alpha") * F.col("t")).alias("a"), F.min("after").alias("left"))
    worst = sums.agg(F.max(F.abs(F.col("a") + F.col("left") - 1)), F.max("a")).first()
    assert worst[0] < 1e-6 and worst[1] <= 1


def test_neighbours_are_exact_at_any_density(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate((rng.random((150, 3)), 40 + 20 * rng.random((30, 3))))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "pid long, x double, y double, z double")
    got = {(r.qid, r["rank"]): r.d2 for r in cloud.nearest(df, df, 3).collect()}
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    want = np.sort(d, 1)[:, :3]
    assert len(got) == 3 * len(p) and all(np.isclose(got[i, k + 1], want[i, k]) for i in range(len(p)) for k in range(3))


def test_histograms_keep_their_mass(spark):
    df = spark.createDataFrame([(k % 3, k / 100) for k in range(101)] + [(0, 5.0)], "frame int, v double")
    hist = pixels.histogram(df, "frame", "v", 0.0, 1.0, 7)
    assert hist.agg(F.sum("n")).first()[0] == 101 and hist.count() == 21


def test_codec_error_is_bounded(spark):
    df = spark.createDataFrame([(i, float(np.sin(i))) for i in range(50)], "gid int, x double")
    back = model.dequantise(model.quantise(df, "x", 8), 8)
    assert back.agg(F.max(F.abs(F.col("back") - F.col("x")) / (F.col("high") - F.col("low")))).first()[0] <= 1 / (2 * 255) + 1e-12


def test_growth_replaces_splits_and_drops_pruned(spark):
    df = spark.createDataFrame([(1, "prune", 1.0), (2, "clone", 1.0), (3, "split", 1.6), (4, "keep", 1.0)], "gid int, action string, sx double").withColumns({"sy": F.col("sx"), "sz": F.col("sx")})
    out = sorted((r.gid, r.sx) for r in model.grown(df).collect())
    assert out == [(2, 1.0), (2, 1.0), (3, 1.0), (3, 1.0), (4, 1.0)]


def test_fisheye_jacobian_against_differences(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(3, 3))
    c = a @ a.T

    def image(v):
        r = np.hypot(v[0], v[1])
        return np.array([50 * np.arctan2(r, v[2]) / r * v[0] + 7, 60 * np.arctan2(r, v[2]) / r * v[1] + 9])

    for p in (np.array([0.3, -0.8, 1.5]), np.array([1e-3, 2e-3, 1.0]), np.array([2.0, 1.0, 0.2])):
        got = spark.range(1).select(*(x for part in G.fisheye([F.lit(float(v)) for v in p], [F.lit(float(c[i, j])) for i in range(3) for j in range(i, 3)], 50, 60, 7, 9) for x in part)).first()
        jac = np.stack([(image(p + e) - image(p - e)) / 2e-6 for e in 1e-6 * np.eye(3)], 1)
        want = jac @ c @ jac.T
        assert np.allclose(got[:2], image(p)) and np.allclose(got[2:], [want[0, 0], want[0, 1], want[1, 1]], rtol=1e-4)
    axis = spark.range(1).select(*G.fisheye([F.lit(0.0), F.lit(0.0), F.lit(2.0)], [F.lit(float(c[i, j])) for i in range(3) for j in range(i, 3)], 50, 60, 7, 9)[1]).first()
    assert np.allclose(axis, [25 * 25 * c[0, 0], 25 * 30 * c[0, 1], 30 * 30 * c[1, 1]])


def test_shared_places_keep_their_rendering(spark):
    """The published sum over i and k of C(i - 1, k) (-1)^k p^(k + 1) / sqrt(k + 1), and opacities that compose to the source's."""
    from math import comb

    rows = [(o, float(n)) for o in (0.01, 0.3, 0.9) for n in (1, 2, 5, 12)]
    for r, (o, n) in zip(spark.createDataFrame(rows, "o double, n double").select(*density.shared(F.col("o"), F.col("n"))).collect(), rows, strict=True):
        p = 1 - (1 - o) ** (1 / n)
        total = sum(comb(i - 1, k) * (-1) ** k * p ** (k + 1) / (k + 1) ** 0.5 for i in range(1, int(n) + 1) for k in range(i))
        assert np.isclose(r[0], p) and np.isclose(1 - (1 - r[0]) ** n, o) and np.isclose(r[1], o / total)


def test_pixels_of_the_ellipse_box_are_all_pixels(spark):
    """Every pixel of a tile with enough alpha is made, also for thin and turned conics."""
    from pelagia.operators import raster

    rng, rows = np.random.default_rng(7), []
    for i in range(60):
        m = rng.normal(size=(2, 2)) * rng.choice([0.5, 4.0], 2)
        k = np.linalg.inv(m @ m.T + 0.3 * np.eye(2))
        rows.append((i, *map(float, rng.uniform(-8, 40, 2)), k[0, 0], k[0, 1], k[1, 1], float(rng.uniform(0.001, 1)), 0, 0, 32, 30, 28))
    df = spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in rows], "gid int, u double, v double, ca_ double, cb_ double, cc_ double, o double, tile_x int, tile_y int, tile int, width int, height int")
    got = {(r.gid, r.px, r.py) for r in raster.pixel_pairs(df).collect()}
    want = set()
    for g, u, v, a, b, c, o, *_ in rows:
        for py in range(28):
            for px in range(30):
                dx, dy = px + 0.5 - u, py + 0.5 - v
                sigma = round(0.5 * (a * dx * dx + c * dy * dy) + b * dx * dy, 9)
                if sigma >= 0 and round(min(0.999, o * np.exp(-sigma)), 9) >= round(1 / 255, 9):
                    want.add((g, px, py))
    assert got == want and len(want) > 1000


def test_surfels_meet_rays_in_their_plane(spark):
    row = dict(cam=0, gid=0, x=0.2, y=-0.1, z=0.3, qw=0.9, qx=0.2, qy=0.3, qz=-0.1, sx=0.4, sy=0.2, sz=0.01, o=0.8, ca=1.0, sa=0.0, tx=0.0, ty=0.0, tz=4.0, fx=40.0, fy=42.0, cx=30.0, cy=25.0, width=64, height=48, tile=64, tile_x=0, tile_y=0)
    df = surfel.project(spark.createDataFrame([row])).cache()
    q = np.array([row[c] for c in ("qw", "qx", "qy", "qz")])
    w, x, y, z = q / np.linalg.norm(q)
    m = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    centre, normal = np.array([0.2, -0.1, 4.3]), m[:, 2]
    got = df.first()
    facing = -np.sign(normal @ centre) * normal
    assert np.allclose([got.nx, got.ny, got.nz], facing) and got.radius > 0
    for r in surfel.pixel_pairs(df).collect():
        ray = np.array([(r.px + 0.5 - 30) / 40, (r.py + 0.5 - 25) / 42, 1.0])
        hit = ray * (normal @ centre) / (normal @ ray) - centre
        plane = (m[:, 0] @ hit / 0.4) ** 2 + (m[:, 1] @ hit / 0.2) ** 2
        screen = 2 * ((r.px + 0.5 - got.u) ** 2 + (r.py + 0.5 - got.v) ** 2)
        assert np.isclose(r.sigma, 0.5 * min(plane, screen), atol=1e-6)


def test_folds_as_sums(spark):
    rng = np.random.default_rng(8)
    values = {r: rng.normal(50, 20, n) for r, n in (("a", 1), ("b", 9), ("c", 450))}
    df = spark.createDataFrame([(r, i + 1, float(v)) for r, vs in values.items() for i, v in enumerate(vs)], "run string, step int, value double").repartition(5)
    means, gains = ({r[0]: r[1] for r in f.collect()} for f in (telemetry.ema(df, 0.1), telemetry.gae(df)))
    trends = {(r.run, r.step): r.trend for r in telemetry.rolling_trend(df).collect()}
    for r, vs in values.items():
        s, g = vs[0], 0.0
        for v in vs[1:]:
            s = 0.1 * v + 0.9 * s
        for i in range(len(vs) - 1, -1, -1):
            g = vs[i] / 100 + 0.99 * (vs[i + 1] if i + 1 < len(vs) else 0) - vs[i] + 0.99 * 0.95 * g
        assert np.isclose(means[r], s) and np.isclose(gains[r], g)
        for i in range(len(vs)):
            last = vs[max(0, i - 199) : i + 1]
            half = len(last) // 2
            want = 0.0 if len(last) < 10 else np.clip((last[half:].mean() - last[:half].mean()) / (abs(last.mean()) + 1e-8), -3, 3)
            assert np.isclose(trends[r, i + 1], want, atol=1e-9)


def test_largest_components(spark):
    picture = ["#..##", "#...#", "..#..", "##...", "....#"]
    rows = [(1, y, x, 5 if c == "#" else 0) for y, line in enumerate(picture) for x, c in enumerate(line)] + [(2, 0, 0, 9)]
    df = spark.createDataFrame(rows, "img long, py int, px int, v int")
    assert [tuple(r) for r in extended.band_component(df, 5, 5, 1, 5, 5, 0.1).collect()] == [(1, 4, 3, 0)]
    assert extended.band_component(df, 5, 5, 4, 5, 5, 0.1).first().row_ is None


def test_gaussian_similarity_is_one_for_equal_images(spark):
    rng = np.random.default_rng(9)
    rows = [(1, y, x, float(v), float(v)) for (y, x), v in np.ndenumerate(rng.random((13, 16)))] + [(2, y, x, float(v), 1 - float(v)) for (y, x), v in np.ndenumerate(rng.random((13, 16)))]
    found = {r.img: r.ssim for r in extended.ssim(spark.createDataFrame(rows, "img int, py int, px int, a double, b double")).collect()}
    assert np.isclose(found[1], 1) and found[2] < 0


def test_colour_match_finds_a_quadratic_warp_of_three_channels(spark):
    rng = np.random.default_rng(5)
    a = rng.uniform(0.2, 0.8, (200, 3))
    b = np.stack((0.5 * a[:, 0] ** 2 + 0.2 * a[:, 1] + 0.1, 0.3 * a[:, 0] * a[:, 2] + 0.4, 0.9 * a[:, 2]), 1)
    b[7] = 1.0  # clipped: takes no part
    rows = [(1, i // 20, i % 20, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "img long, py int, px int, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    got = {(r.py, r.px): (r.v0, r.v1, r.v2) for r in kernels.color_matched(df, 3).collect()}
    assert all(np.allclose(got[i // 20, i % 20], b[i], atol=1e-9) for i in range(200) if i != 7)
    dark = df.withColumn("b0", F.lit(0.0))  # nothing left to fit in this channel
    assert {r.v0 for r in kernels.color_matched(dark, 3).collect()} == {0.0}


def test_splines_pass_through_their_samples():
    v = np.random.default_rng(6).normal(size=9)
    at, weights = kernels.spline_taps(np.arange(9.0))
    assert np.allclose(((kernels.spline_coefficients(9) @ v)[at + 2] * weights).sum(1), v)
    for degree in (1, 2, 3, 4, 5):
        u = np.sort(np.append(np.random.default_rng(degree).uniform(0, 1, 10), (0, 1)))
        half = degree // 2
        inner = u[half + 1 : len(u) - half - 1] if degree % 2 else (u[half : len(u) - half - 1] + u[half + 1 : len(u) - half]) / 2
        knots = np.concatenate((np.zeros(degree + 1), inner, np.ones(degree + 1)))
        weights = np.linalg.solve(paths._basis(knots, degree, u), u**degree)
        t = np.linspace(0, 1, 50)
        assert np.allclose(paths._basis(knots, degree, t) @ weights, t**degree) and np.allclose(paths._basis(knots, degree, t).sum(1), 1)


def test_sector_image_of_a_linear_ramp(spark):
    df = spark.createDataFrame([(0, r, a, float(r)) for r in range(40) for a in range(30)], "frame int, rng int, az int, v double")
    got = kernels.sector_image(df, 40, 30, np.pi / 2).collect()
    assert len(got) == 80 * 40
    for r in got:
        y, x = 2 * r.i / 79 - 1, r.j / 39
        place, column = np.hypot(x, y) * 39, (np.arctan2(y, x) / (np.pi / 2) + 0.5) * 29
        if not 0 <= column <= 29:
            assert r.v == 0 or abs(abs(np.arctan2(y, x)) - np.pi / 4) < 1e-9
        elif 8 < place < 31 and 8 < column < 21:  # away from the edges, where zeros begin
            assert abs(r.v - place) < 2e-3


def test_template_is_found_at_any_offset_or_rejected(spark):
    rng = np.random.default_rng(8)
    t = rng.integers(0, 255, (3, 3))
    whole = rng.integers(0, 255, (5, 20, 20))
    whole[0, 14:17, 11:14] = t  # found
    whole[1, 11:14, 12:15] = t  # too far from the bottom
    whole[2] = 9  # flat
    whole[3, 2:5, 2:5] = t  # outside the corner
    px = spark.createDataFrame([(k, y, x, int(whole[k, y, x])) for k in range(4) for y in range(20) for x in range(20)] + [(4, 0, 0, 1)], "img long, py int, px int, v int")
    template = spark.createDataFrame([(y, x, float(t[y, x])) for y in range(3) for x in range(3)], "ty int, tx int, t double")
    got = {r.img: r for r in kernels.corner_match(px, template, 3, 0.5, 0.5, 0.95, 4).collect()}
    assert (got[0].row_, got[0].col_, got[0].score, got[0].reject) == (14, 11, 1.0, None)
    assert (got[1].row_, got[1].reject) == (11, "edge") and got[2].reject == "flat" and got[3].reject == "score" and got[4].reject == "small"


def test_parts_against_plain_flooding():
    rng = np.random.default_rng(4)
    for _ in range(60):
        mask = rng.random(tuple(rng.integers(0, 14, 2))) < rng.random()
        for near in (kernels.AROUND, kernels.BESIDE):
            label, found = np.zeros(mask.shape, int), 0
            for at in map(tuple, np.argwhere(mask)):
                todo, found = [at], found + (label[at] == 0)
                while todo:
                    p = todo.pop()
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not label[p]:
                        label[p] = found
                        todo += [(p[0] + a, p[1] + b) for a, b in near]
            assert (kernels.parts_of(mask, near) == label).all()


def test_solidity_of_nested_parts(spark):
    # a part inside the hole of a larger one, a part that only touches at corners, and one without holes of a smaller outline
    picture = ["######....", "#....#.#..", "#.##.#..#.", "#.##.#.#..", "#....#....", "######.###", ".......###"]
    rows = [(1, y, x, 200) for y, line in enumerate(picture) for x, c in enumerate(line) if c == "#"]
    found = kernels.solidity(spark.createDataFrame(rows, "img long, py int, px int, v int"), 100).first()
    assert (found.outline, found.hull) == (25.0, 25.0)  # the ring of 6 x 6 pixels, through their centres


def test_solidity_fills_holes_and_takes_the_largest_part(spark):
    ring = [(y, x) for y in range(5) for x in range(5) if {y, x} & {0, 4}]  # a square outline: 16
    corner = [(y, 20 + x) for y in range(6) for x in range(6) if y == 5 or x == 0]  # an L of lines: no area
    notched = [(y, 40 + x) for y in range(7) for x in range(7) if y <= x or x > 4]
    rows = [(1, y, x, 200) for y, x in ring + corner] + [(2, y, x, 200) for y, x in notched] + [(3, 2, 2, 200), (4, 1, 1, 5)]
    got = {r.img: r for r in kernels.solidity(spark.createDataFrame(rows, "img long, py int, px int, v int"), 100).collect()}
    assert (got[1].outline, got[1].hull, got[1].solidity) == (16.0, 16.0, 1.0) and 4 not in got
    assert (got[3].outline, got[3].hull, got[3].solidity) == (0.0, 0.0, 0.0)
    assert got[2].outline <= got[2].hull and 0.5 < got[2].solidity <= 1


def test_axes_of_a_path_are_rotations_that_look_at_the_centre(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(20):  # cameras on a ring that look at (1, 2, 3)
        at = np.array([1, 2, 3]) + 4 * np.array([np.cos(i), np.sin(i), rng.normal() / 9])
        back = (at - [1, 2, 3]) / np.linalg.norm(at - [1, 2, 3])
        right = np.cross([0, 0, 1], back)
        right /= np.linalg.norm(right)
        rows.append((i, *map(float, at), *map(float, np.stack((right, np.cross(back, right), back), 1).ravel())))
    poses = spark.createDataFrame(rows, "pid long, x double, y double, z double, " + ", ".join(f"r{k} double" for k in range(9)))
    assert np.allclose(paths.centre_of_view(poses), [1, 2, 3])
    for path in (paths.spiral(poses, 7, 1.0, 9.0), paths.ellipse(poses, 7), paths.ellipse(poses, 7, "y"), paths.interpolated(poses, 2)):
        for r in path.collect():
            m = np.array(r[4:]).reshape(3, 3)
            assert np.allclose(m @ m.T, np.eye(3)) and np.isclose(np.linalg.det(m), 1)
    for r in paths.ellipse(poses, 7, "z", 3.0).collect():
        assert np.allclose(np.cross([r.x - 1, r.y - 2, r.z - 3], [r.r2, r.r5, r.r8]), 0)
