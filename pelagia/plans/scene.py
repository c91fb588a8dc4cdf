"""Queries: scene geometry and rasterisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pelagia.functions import geometry as G
from pelagia.operators import frustum, raster
from pelagia.plans.register import R, query, r6
from pelagia.plans.views import ctes
from pelagia.session import written

ROT = {
    "m00": "1 - 2 * (qy * qy + qz * qz)", "m01": "2 * (qx * qy - qw * qz)", "m02": "2 * (qx * qz + qw * qy)",
    "m10": "2 * (qx * qy + qw * qz)", "m11": "1 - 2 * (qx * qx + qz * qz)", "m12": "2 * (qy * qz - qw * qx)",
    "m20": "2 * (qx * qz - qw * qy)", "m21": "2 * (qy * qz + qw * qx)", "m22": "1 - 2 * (qx * qx + qy * qy)",
}
_N = "sqrt(qw * qw + qx * qx + qy * qy + qz * qz)"
#: unit quaternions, rotations, covariances of the splats
QS = f"""qn as (select * replace (qw / {_N} as qw, qx / {_N} as qx, qy / {_N} as qy, qz / {_N} as qz) from splats),
rot as (select *, {", ".join(f"{e} as {n}" for n, e in ROT.items())} from qn),
cov as (select *, {", ".join(f"m{i}0 * m{j}0 * sx * sx + m{i}1 * m{j}1 * sy * sy + m{i}2 * m{j}2 * sz * sz as w{i}{j}" for i in range(3) for j in range(i, 3))} from rot)"""
SPLATS = ctes("splats") + ",\n" + QS
#: in camera coordinates: R about y, (ca 0 sa; 0 1 0; -sa 0 ca)
CAMERA = ctes("splats", "cams") + ",\n" + QS + """,
cc as (select *, ca * x + sa * z + tx as mx, y + ty as my, -sa * x + ca * z + tz as mz,
  ca * ca * w00 + 2 * ca * sa * w02 + sa * sa * w22 as k00, ca * w01 + sa * w12 as k01,
  -ca * sa * w00 + (ca * ca - sa * sa) * w02 + ca * sa * w22 as k02, w11 as k11, -sa * w01 + ca * w12 as k12,
  sa * sa * w00 - 2 * ca * sa * w02 + ca * ca * w22 as k22 from cov, cams)"""
PROJECTED = CAMERA + """,
zz as (select *, case when abs(mz) < 1e-6 then 1e-6 else mz end as z_ from cc),
lm as (select *, (width - cx) / fx + 0.3 * 0.5 * width / fx as right_, cx / fx + 0.3 * 0.5 * width / fx as left_,
  (height - cy) / fy + 0.3 * 0.5 * height / fy as down_, cy / fy + 0.3 * 0.5 * height / fy as up_ from zz),
tt as (select *, z_ * least(right_, greatest(-left_, mx / z_)) as txc, z_ * least(down_, greatest(-up_, my / z_)) as tyc from lm),
jj as (select *, fx / z_ as ja, -fx * txc / (z_ * z_) as jb, fy / z_ as jc, -fy * tyc / (z_ * z_) as jd from tt),
c2 as (select *, round(fx * mx / z_ + cx, 9) as u, round(fy * my / z_ + cy, 9) as v, round(mz, 9) as depth,
  ja * ja * k00 + 2 * ja * jb * k02 + jb * jb * k22 as c0, ja * jc * k01 + ja * jd * k02 + jb * jc * k12 + jb * jd * k22 as c1,
  jc * jc * k11 + 2 * jc * jd * k12 + jd * jd * k22 as c2 from jj),
dd as (select *, c0 + 0.3 as aa, c2 + 0.3 as bb, greatest((c0 + 0.3) * (c2 + 0.3) - c1 * c1, 1e-10) as det from c2),
rr as (select *, bb / det as ca_, -c1 / det as cb_, aa / det as cc_, sqrt(greatest((c0 * c2 - c1 * c1) / det, 0)) as comp,
  case when depth > 0.01 and depth < 1e10 then ceil(round(3 * sqrt((aa + bb) / 2 + sqrt(greatest((aa + bb) / 2 * (aa + bb) / 2 - det, 0.01))), 9))::int else 0 end as rad from dd),
pr as materialized (select * exclude (rad), case when u + rad > 0 and u - rad < width and v + rad > 0 and v - rad < height then rad else 0 end as radius from rr)"""
TILED = PROJECTED + """,
bx as (select *, least(greatest(floor((u - radius) / tile), 0), ceil(width / tile))::int as x0, least(greatest(ceil((u + radius) / tile), 0), ceil(width / tile))::int as x1,
  least(greatest(floor((v - radius) / tile), 0), ceil(height / tile))::int as y0, least(greatest(ceil((v + radius) / tile), 0), ceil(height / tile))::int as y1 from pr where radius > 0),
t1 as (select *, unnest(range(y0, y1))::int as tile_y from bx where x1 > x0 and y1 > y0),
tl as materialized (select *, unnest(range(x0, x1))::int as tile_x from t1)"""
PAIRS = TILED + """,
p1 as (select *, unnest(range(tile_y * tile, least((tile_y + 1) * tile, height)))::int as py from tl),
p2 as (select *, unnest(range(tile_x * tile, least((tile_x + 1) * tile, width)))::int as px from p1),
p3 as (select *, round(0.5 * (ca_ * (px + 0.5 - u) * (px + 0.5 - u) + cc_ * (py + 0.5 - v) * (py + 0.5 - v)) + cb_ * (px + 0.5 - u) * (py + 0.5 - v), 9) as sigma from p2),
p4 as (select *, round(least(0.999, o * exp(-sigma)), 9) as alpha from p3),
pp as materialized (select * from p4 where sigma >= 0 and alpha >= round(1 / 255.0::double, 9))"""
WEIGHTED = PAIRS + """,
w1 as (select *, exp(sum(ln(1 - alpha)) over (partition by cam, px, py order by depth, gid rows unbounded preceding)) as after from pp),
ww as materialized (select *, after / (1 - alpha) as t from w1 where round(after, 9) > 1e-4)"""


def _pairs(view) -> DataFrame:
    return raster.cameras_by_splats(view("cams"), view("splats"))


def projected(view) -> DataFrame:
    """Projected splats, spread over tasks and written before they are filtered or exploded: Catalyst would push a filter on
    the radius down through the projection and evaluate the projection's expressions again for each of its uses."""
    return written(raster.project(_pairs(view)).repartition(F.col("gid"), F.col("cam")))


def weighted(view) -> DataFrame:
    return raster.transmittance(raster.pixel_pairs(raster.tiles(projected(view))))


@query("sc_quat_to_rotmat", f"{SPLATS} select gid, {', '.join(f'{R(n)} as {n}' for n in ROT)} from rot")
def _(view):
    m = G.quat_to_rotmat(*(F.col(c) for c in ("qw", "qx", "qy", "qz")))
    return view("splats").select("gid", *(r6(c).alias(n) for c, n in zip(m, ROT, strict=True)))


@query("sc_quat_scale_cov", f"{SPLATS} select gid, {', '.join(f'{R(f'w{i}{j}')} as w{i}{j}' for i in range(3) for j in range(i, 3))} from cov")
def _(view):
    names = [f"w{i}{j}" for i in range(3) for j in range(i, 3)]
    return view("splats").select("gid", *(r6(c).alias(n) for c, n in zip(raster.world_covariance(), names, strict=True)))


@query("sc_triu_pack", f"{SPLATS} select gid, [{', '.join(R(x) for x in ('w00', 'w01', 'w02', 'w11', 'w12', 'w22'))}] as packed, [{', '.join(R(x) for x in ('w00', 'w01', 'w02', 'w01', 'w11', 'w12', 'w02', 'w12', 'w22'))}] as unpacked from cov")
def _(view):
    six = view("splats").select("gid", F.array(*(r6(c) for c in raster.world_covariance())).alias("packed"))
    return six.select("gid", "packed", F.array(*G.symmetric([F.get("packed", F.lit(i)) for i in range(6)])).alias("unpacked"))


_CAM_OUT = [("mx", "mx"), ("my", "my"), ("mz", "mz"), ("k_xx", "k00"), ("k_xy", "k01"), ("k_xz", "k02"), ("k_yy", "k11"), ("k_yz", "k12"), ("k_zz", "k22")]


@query("sc_world_to_cam", f"{CAMERA} select cam, gid, {', '.join(f'{R(b)} as {a}' for a, b in _CAM_OUT)} from cc")
def _(view):
    return raster.to_camera(_pairs(view)).select("cam", "gid", *(r6(a).alias(a) for a, _ in _CAM_OUT))


@query("jn_cam_x_gauss", ctes("splats", "cams") + " select cam, count(*) as n, count(distinct gid) as n_gid from splats, cams group by cam")
def _(view):
    return _pairs(view).groupBy("cam").agg(F.count("*").alias("n"), F.count_distinct("gid").alias("n_gid"))


@query("sc_proj_pinhole", f"{PROJECTED} select cam, gid, {', '.join(f'{R(c)} as {c}' for c in ('u', 'v', 'c0', 'c1', 'c2'))} from pr where depth > 0.01")
def _(view):
    return raster.project(_pairs(view)).where("depth > 0.01").select("cam", "gid", *(r6(c).alias(c) for c in ("u", "v", "c0", "c1", "c2")))


@query("sc_proj_ortho", f"{CAMERA} select cam, gid, {R('fx * mx + cx')} as u, {R('fy * my + cy')} as v, {R('fx * fx * k00')} as c0, {R('fx * fy * k01')} as c1, {R('fy * fy * k11')} as c2 from cc")
def _(view):
    df = raster.to_camera(_pairs(view))
    fx, fy, cx, cy = (F.col(c) for c in ("fx", "fy", "cx", "cy"))
    mean, cov = G.orthographic([F.col(c) for c in ("mx", "my", "mz")], [F.col(f"k_{n}") for n in raster.COV], fx, fy, cx, cy)
    return df.select("cam", "gid", *(r6(c).alias(n) for c, n in zip([*mean, *cov], ("u", "v", "c0", "c1", "c2"), strict=True)))


_QUAD = lambda p: " + ".join(f"{p}{i} * {p}{j} * k{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3))


@query("sc_proj_fisheye", CAMERA + f""",
f1 as (select *, sqrt(mx * mx + my * my) as off_, mx * mx + my * my + mz * mz as sq from cc where mz > 0.1),
f2 as (select *, case when off_ > 1e-7 then mx / off_ else 1 end as dir_x, case when off_ > 1e-7 then my / off_ else 0 end as dir_y,
  case when off_ > 1e-7 then atan2(off_, mz) / off_ else 1 / mz end as side, mz / sq as outward, -off_ / sq as ahead from f1),
f3 as (select *, fx * (dir_x * dir_x * outward + dir_y * dir_y * side) as jx0, fx * dir_x * dir_y * (outward - side) as jx1, fx * dir_x * ahead as jx2,
  fy * dir_x * dir_y * (outward - side) as jy0, fy * (dir_y * dir_y * outward + dir_x * dir_x * side) as jy1, fy * dir_y * ahead as jy2 from f2)
select cam, gid, {R('fx * side * mx + cx')} as u, {R('fy * side * my + cy')} as v, {R(_QUAD('jx'))} as c0, {R(_QUAD('jy'))} as c2 from f3""")
def _(view):
    df = raster.to_camera(_pairs(view)).where("mz > 0.1")
    fx, fy, cx, cy = (F.col(c) for c in ("fx", "fy", "cx", "cy"))
    mean, cov = G.fisheye([F.col(c) for c in ("mx", "my", "mz")], [F.col(f"k_{n}") for n in raster.COV], fx, fy, cx, cy)
    return df.select("cam", "gid", r6(mean[0]).alias("u"), r6(mean[1]).alias("v"), r6(cov[0]).alias("c0"), r6(cov[2]).alias("c2"))


@query("sc_conic_radius", f"{PROJECTED} select cam, gid, {R('ca_')} as ca_, {R('cb_')} as cb_, {R('cc_')} as cc_, {R('comp')} as comp from pr where depth > 0.01")
def _(view):
    return raster.project(_pairs(view)).where("depth > 0.01").select("cam", "gid", *(r6(c).alias(c) for c in ("ca_", "cb_", "cc_", "comp")))


_PROJ = ("u", "v", "depth", "ca_", "cb_", "cc_")


@query("sc_fused_projection", f"{PROJECTED} select cam, gid, radius, {', '.join(f'{R(c)} as {c}' for c in _PROJ)} from pr where radius > 0")
def _(view):
    return projected(view).where("radius > 0").select("cam", "gid", "radius", *(r6(c).alias(c) for c in _PROJ))


@query("flt_frustum", f"{PROJECTED} select cam, count(*) as n, sum(case when radius > 0 then 1 else 0 end)::bigint as kept from pr group by cam")
def _(view):
    """What each camera keeps of all splats; it meets those of the cells only that it may see."""
    cams, splats = view("cams"), view("splats")
    kept = written(raster.project(frustum.pairs(cams, splats, leaf=64))).where("radius > 0").groupBy("cam").agg(F.count("*").alias("kept"))
    every = cams.select("cam").crossJoin(F.broadcast(splats.agg(F.count("*").alias("n"))))  # one row
    return every.join(kept, "cam", "left").select("cam", "n", F.coalesce("kept", F.lit(0)).alias("kept"))


@query("jn_cam_visible", f"{PROJECTED} select cam, gid, radius from pr where radius > 0")
def _(view):
    return written(raster.project(frustum.pairs(view("cams"), view("splats"), leaf=64))).where("radius > 0").select("cam", "gid", "radius")


@query("flt_radius_clip", f"{PROJECTED} select cam, gid, radius from pr where radius > 8")
def _(view):
    return projected(view).where("radius > 8").select("cam", "gid", "radius")


@query("sc_cart_to_sph", CAMERA + f""",
s1 as (select *, sqrt(mx*mx + my*my) as fl_, greatest(sqrt(mx*mx + my*my), 1e-7) as fl, greatest(sqrt(mx*mx + my*my + mz*mz), 1e-7) as rn from cc)
select cam, gid, {R('sqrt(mx*mx + my*my + mz*mz)')} as rng, {R('atan2(my, mx)')} as az, {R('atan2(mz, fl_)')} as incl,
 {R('(mx*mx*k00 + my*my*k11 + mz*mz*k22 + 2*mx*my*k01 + 2*mx*mz*k02 + 2*my*mz*k12) / (rn*rn)')} as v_rr,
 {R('(my*my*k00 - 2*mx*my*k01 + mx*mx*k11) / (fl*fl*fl*fl)')} as v_aa from s1""")
def _(view):
    df = raster.to_camera(_pairs(view))
    mean, cov = [F.col(c) for c in ("mx", "my", "mz")], [F.col(f"k_{n}") for n in raster.COV]
    s, c = G.spherical(mean), G.spherical_covariance(mean, cov)
    return df.select("cam", "gid", r6(s[0]).alias("rng"), r6(s[1]).alias("az"), r6(s[2]).alias("incl"), r6(c[0]).alias("v_rr"), r6(c[3]).alias("v_aa"))


@query("sc_ae_permute", CAMERA + f" select cam, gid, [{R('atan2(my, mx)')}, {R('atan2(mz, sqrt(mx*mx + my*my))')}, {R('sqrt(mx*mx + my*my + mz*mz)')}] as aer from cc")
def _(view):
    s = G.spherical([F.col(c) for c in ("mx", "my", "mz")])
    return raster.to_camera(_pairs(view)).select("cam", "gid", F.array(r6(s[1]), r6(s[2]), r6(s[0])).alias("aer"))


#: The bases as textbooks give them, by degree.
_HARMONICS = (
    ("sqrt(1 / (4 * pi()))",),
    ("-sqrt(3 / (4 * pi())) * y", "sqrt(3 / (4 * pi())) * z", "-sqrt(3 / (4 * pi())) * x"),
    ("sqrt(15 / (4 * pi())) * x * y", "-sqrt(15 / (4 * pi())) * y * z", "sqrt(5 / (16 * pi())) * (3 * z * z - 1)", "-sqrt(15 / (4 * pi())) * x * z", "sqrt(15 / (16 * pi())) * (x * x - y * y)"),
    ("-sqrt(35 / (32 * pi())) * y * (3 * x * x - y * y)", "sqrt(105 / (4 * pi())) * x * y * z", "-sqrt(21 / (32 * pi())) * y * (5 * z * z - 1)", "sqrt(7 / (16 * pi())) * z * (5 * z * z - 3)", "-sqrt(21 / (32 * pi())) * x * (5 * z * z - 1)", "sqrt(105 / (16 * pi())) * z * (x * x - y * y)", "-sqrt(35 / (32 * pi())) * x * (x * x - 3 * y * y)"),
    ("0.75 * sqrt(35 / pi()) * x * y * (x * x - y * y)", "-0.75 * sqrt(35 / (2 * pi())) * y * z * (3 * x * x - y * y)", "0.75 * sqrt(5 / pi()) * x * y * (7 * z * z - 1)", "-0.75 * sqrt(5 / (2 * pi())) * y * z * (7 * z * z - 3)", "0.1875 * sqrt(1 / pi()) * (35 * z * z * z * z - 30 * z * z + 3)", "-0.75 * sqrt(5 / (2 * pi())) * x * z * (7 * z * z - 3)", "0.375 * sqrt(5 / pi()) * (x * x - y * y) * (7 * z * z - 1)", "-0.75 * sqrt(35 / (2 * pi())) * x * z * (x * x - 3 * y * y)", "0.1875 * sqrt(35 / pi()) * (x * x * x * x - 6 * x * x * y * y + y * y * y * y)"),
)
_SHARES = ("r", "o", "0.25::double", "g * 0.5", "b * 0.125")
_COLOUR = lambda degree: " + ".join(f"{share} * (1 + {k} / 10.0::double) * {base}" for bases, share in zip(_HARMONICS[: degree + 1], _SHARES, strict=False) for k, base in enumerate(bases))


@query("sc_spherical_harmonics", ctes("splats") + f""",
d as (select *, sqrt(x*x + y*y + z*z) as n from splats where x*x + y*y + z*z > 0), u as (select gid, o, r, g, b, x/n as x, y/n as y, z/n as z from d)
select gid, {', '.join(f'{R(f"greatest(0, 0.5 + {_COLOUR(d)})")} as c{d}' for d in range(5))} from u""")
def _(view):
    """The colour of each splat seen from the origin, by harmonics of degrees 0 to 4."""
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    df = view("splats").withColumn("n", n).where("n > 0").selectExpr("gid", "r", "g", "b", "o", "x / n as x", "y / n as y", "z / n as z")
    basis = G.sh_basis(F.col("x"), F.col("y"), F.col("z"), 4)
    shares = [F.col("r"), F.col("o"), F.lit(0.25), F.col("g") * 0.5, F.col("b") * 0.125]
    parts = [sum((shares[d] * (1 + k / 10.0) * basis[d * d + k] for k in range(1, 2 * d + 1)), shares[d] * basis[d * d]) for d in range(5)]
    return df.select("gid", *(r6(F.greatest(sum(parts[1 : d + 1], parts[0]) + 0.5, F.lit(0.0))).alias(f"c{d}") for d in range(5)))


@query("sc_rgb_sh", ctes("splats") + f" select gid, {R('(r - 0.5) / 0.28209479177387814')} as sh0, {R('(r - 0.5) / 0.28209479177387814 * 0.28209479177387814 + 0.5')} as back from splats")
def _(view):
    sh = (F.col("r") - 0.5) / G.SH0
    return view("splats").select("gid", r6(sh).alias("sh0"), r6(sh * G.SH0 + 0.5).alias("back"))


@query("sc_logit_sigmoid_exp", ctes("splats") + f" select gid, {R('ln(o / (1 - o))')} as logit, {R('1 / (1 + exp(-x))')} as sig, {R('sign(x) * ln(1 + abs(x))')} as slog, {R('ln(sx)')} as log_scale from splats where o > 0 and o < 1")
def _(view):
    df = view("splats").where("o > 0 and o < 1")
    return df.select("gid", r6(G.logit(F.col("o"))).alias("logit"), r6(G.sigmoid(F.col("x"))).alias("sig"), r6(G.signed_log(F.col("x"))).alias("slog"), r6(F.ln("sx")).alias("log_scale"))


_BEAM = "case when abs({0}) < 1e-12 then 1.0 else sin(pi() * {0}) / (pi() * {0}) end"
_BEAMS = CAMERA + f""",
b1 as (select *, 0.5 * sin(atan2(my, mx)) as ub, atan2(mz, sqrt(mx*mx + my*my)) as el from cc),
b2 as (select *, ({_BEAM.format('8 * ub')}) / ({_BEAM.format('ub')}) as rt from b1 where abs(sin(pi() * ub)) > 1e-9 or abs(ub) < 1e-12),
b3 as (select *, greatest(0, least(1, rt * rt * cos(el) * cos(el))) as wt from b2)"""


def _beam(view):
    df = raster.to_camera(_pairs(view))
    s = G.spherical([F.col(c) for c in ("mx", "my", "mz")])
    return df.withColumns({"az_": s[1], "el_": s[2]}).where("abs(sin(pi() * 0.5 * sin(az_))) > 1e-9 or abs(0.5 * sin(az_)) < 1e-12").withColumn("wt", G.beam_weight(F.col("az_"), F.col("el_")))


@query("sc_beam_pattern", _BEAMS + f" select cam, gid, {R('wt')} as wt from b3")
def _(view):
    return _beam(view).select("cam", "gid", r6("wt").alias("wt"))


@query("sc_beam_blend", _BEAMS + f" select cam, gid, {R('o * refl * (0.4 + 0.6 * wt)')} as eff from b3")
def _(view):
    return _beam(view).select("cam", "gid", r6(F.col("o") * F.col("refl") * (0.4 + 0.6 * F.col("wt"))).alias("eff"))


@query("sc_rot6d", ctes("splats") + f""",
a as (select *, sqrt(x*x+y*y+z*z) as n from splats where x*x+y*y+z*z > 0), u as (select *, x/n as u0, y/n as u1, z/n as u2 from a),
d as (select *, u0*r + u1*g + u2*b as dt from u), v as (select *, r - dt*u0 as v0, g - dt*u1 as v1, b - dt*u2 as v2 from d), m as (select *, sqrt(v0*v0+v1*v1+v2*v2) as mm from v)
select gid, {R('u0')} as m00, {R('v0/mm')} as m10, {R('(u1*v2 - u2*v1)/mm')} as m20, {R('(u0*v1 - u1*v0)/mm')} as m22 from m where mm > 1e-6""")
def _(view):
    df = view("splats").where("x*x+y*y+z*z > 0")
    m = G.rotation_6d([F.col(c) for c in "xyz"], [F.col(c) for c in "rgb"])
    return df.select("gid", *(r6(m[i]).alias(n) for i, n in ((0, "m00"), (3, "m10"), (6, "m20"), (8, "m22"))))


@query("jn_tile_intersect", f"{TILED} select cam, gid, tile_x, tile_y, {R('depth')} as depth from tl")
def _(view):
    return raster.tiles(projected(view)).select("cam", "gid", "tile_x", "tile_y", r6("depth").alias("depth"))


@query("so_isect_radix", f"{TILED} select cam, gid, tile_x, tile_y, row_number() over (partition by cam, tile_y, tile_x order by depth, gid)::int as place from tl")
def _(view):
    order = Window.partitionBy("cam", "tile_y", "tile_x").orderBy("depth", "gid")
    return raster.tiles(projected(view)).select("cam", "gid", "tile_x", "tile_y", F.row_number().over(order).alias("place"))


@query("wn_tile_offsets", f"{TILED}, n as (select cam, tile_y, tile_x, count(*) as n from tl group by 1, 2, 3) select *, (sum(n) over (partition by cam order by tile_y, tile_x rows unbounded preceding) - n)::bigint as first from n")
def _(view):
    counts = raster.tiles(projected(view)).groupBy("cam", "tile_y", "tile_x").agg(F.count("*").alias("n"))
    order = Window.partitionBy("cam").orderBy("tile_y", "tile_x").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("first", F.sum("n").over(order) - F.col("n"))


@query("wn_cum_intersects", f"{TILED}, n as (select cam, gid, count(*) as n from tl group by 1, 2) select *, (sum(n) over (partition by cam order by gid rows unbounded preceding))::bigint as upto from n")
def _(view):
    counts = raster.tiles(projected(view)).groupBy("cam", "gid").agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.partitionBy("cam").orderBy("gid").rowsBetween(Window.unboundedPreceding, 0)))


@query("jn_tile_pixels", f"{PAIRS} select cam, px, py, count(*) as n, round(sum(alpha), 9) as a from pp group by 1, 2, 3")
def _(view):
    return raster.pixel_pairs(raster.tiles(projected(view))).groupBy("cam", "px", "py").agg(F.count("*").alias("n"), F.round(F.sum("alpha"), 9).alias("a"))


@query("jn_tile_pixels_sonar", f"{PAIRS} select cam, gid, count(*) as n, round(sum(sigma), 9) as s from pp group by 1, 2")
def _(view):
    return raster.pixel_pairs(raster.tiles(projected(view))).groupBy("cam", "gid").agg(F.count("*").alias("n"), F.round(F.sum("sigma"), 9).alias("s"))


@query("flt_alpha_min", f"{PAIRS} select cam, count(*) as n, round(min(alpha), 9) as least, round(max(alpha), 9) as most from pp group by 1")
def _(view):
    return raster.pixel_pairs(raster.tiles(projected(view))).groupBy("cam").agg(F.count("*").alias("n"), F.round(F.min("alpha"), 9).alias("least"), F.round(F.max("alpha"), 9).alias("most"))


@query("jn_gather_attr", f"{TILED} select cam, tile_x, tile_y, {R('sum(s.r)')} as r, count(*) as n from (select cam, tile_x, tile_y, gid from tl) join splats s using (gid) group by 1, 2, 3")
def _(view):
    ids = raster.tiles(projected(view)).select("cam", "tile_x", "tile_y", "gid")
    return ids.join(view("splats").select("gid", "r"), "gid").groupBy("cam", "tile_x", "tile_y").agg(r6(F.sum("r")).alias("r"), F.count("*").alias("n"))


@query("wn_running_transmittance", f"{WEIGHTED} select cam, px, py, gid, round(t, 9) as t from ww")
def _(view):
    return weighted(view).select("cam", "px", "py", "gid", F.round("t", 9).alias("t"))


_COMP = f"{WEIGHTED}, cm as (select cam, px, py, sum(alpha*t*r) as r, sum(alpha*t*g) as g, sum(alpha*t*b) as b, sum(alpha*t) as a, sum(alpha*t*depth) as d, count(*) as n from ww group by 1, 2, 3)"


@query("ag_alpha_composite", f"{_COMP} select cam, px, py, n, {R('r + 1 - a')} as r, {R('g + 1 - a')} as g, {R('b + 1 - a')} as b, round(a, 9) as a from cm")
def _(view):
    return raster.composite(weighted(view)).select("cam", "px", "py", "n", *(r6(F.col(c) + 1 - F.col("a")).alias(c) for c in "rgb"), F.round("a", 9).alias("a"))


@query("ag_render_depth", f"{_COMP} select cam, px, py, {R('d')} as d, {R('d / greatest(a, 1e-10)')} as ed from cm")
def _(view):
    return raster.composite(weighted(view)).select("cam", "px", "py", r6("d").alias("d"), r6(F.col("d") / F.greatest("a", F.lit(1e-10))).alias("ed"))


@query("ag_sum_weights", f"{WEIGHTED} select cam, gid, round(sum(alpha*t), 9) as w, round(sum(alpha*t) / greatest(count(*), 1), 9) as mean from ww group by 1, 2")
def _(view):
    w = F.sum(F.col("alpha") * F.col("t"))
    return weighted(view).groupBy("cam", "gid").agg(F.round(w, 9).alias("w"), F.round(w / F.greatest(F.count("*"), F.lit(1)), 9).alias("mean"))


_SONAR = f"""{WEIGHTED}, sn as (select cam, px, py, greatest(0, least(1, sum(least(refl*o*t*exp(-sigma), 0.999)))) as reflected,
greatest(0, least(1, sum(least(o*t*exp(-sigma), 0.999)))) as plain, greatest(0, least(1, sum(least(sat*o*t*exp(-sigma), 0.999)))) as saturated from ww group by 1, 2, 3)"""


@query("ag_sonar_accumulate", f"{_SONAR} select cam, px, py, {R('reflected')} as reflected, {R('plain')} as plain, {R('saturated')} as saturated from sn")
def _(view):
    return raster.sonar_sums(weighted(view)).select("cam", "px", "py", *(r6(c).alias(c) for c in ("reflected", "plain", "saturated")))


@query("ag_gauss_transmittance", f"{WEIGHTED} select cam, gid, round(avg(t), 9) as t from ww group by 1, 2")
def _(view):
    return weighted(view).groupBy("cam", "gid").agg(F.round(F.avg("t"), 9).alias("t"))


@query("ag_saturate", f"{_SONAR}, pg as (select *, least(1, greatest(0, sum(saturated) over (partition by cam, py))) as p from sn) select cam, px, py, {R('p')} as p, {R('p * plain * (exp(plain) - 1) / (exp(1.0::double) - 1) + 1 - p')} as gain from pg")
def _(view):
    return raster.column_gain(raster.sonar_sums(weighted(view))).select("cam", "px", "py", r6("p").alias("p"), r6("gain").alias("gain"))
