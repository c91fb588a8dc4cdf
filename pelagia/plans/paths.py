"""Queries of camera paths; the splats' centres and rotations serve as poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pelagia.functions import geometry as G
from pelagia.operators import paths as P
from pelagia.plans.register import R, query, r6
from pelagia.plans.views import ctes

_POSES = ctes("splats") + """, qn as (select gid as pid, x, y, z, qw / n as w, qx / n as a, qy / n as b, qz / n as c from (select *, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) as n from splats)),
po as materialized (select pid, x, y, z, 1 - 2 * (b * b + c * c) as r0, 2 * (a * b - w * c) as r1, 2 * (a * c + w * b) as r2, 2 * (a * b + w * c) as r3, 1 - 2 * (a * a + c * c) as r4, 2 * (b * c - w * a) as r5,
  2 * (a * c - w * b) as r6, 2 * (b * c + w * a) as r7, 1 - 2 * (a * a + b * b) as r8 from qn)"""
#: The point fx, fy, fz nearest to all viewing axes, by Cramer's rule.
_FOCUS = """, fs as (select count(*) - sum(r2 * r2) as a, -sum(r2 * r5) as b, -sum(r2 * r8) as c, count(*) - sum(r5 * r5) as d, -sum(r5 * r8) as e, count(*) - sum(r8 * r8) as f,
  sum(x - r2 * (r2 * x + r5 * y + r8 * z)) as u, sum(y - r5 * (r2 * x + r5 * y + r8 * z)) as v, sum(z - r8 * (r2 * x + r5 * y + r8 * z)) as w from po),
fo as materialized (select ((d * f - e * e) * u + (c * e - b * f) * v + (b * e - c * d) * w) / det as fx, ((c * e - b * f) * u + (a * f - c * c) * v + (b * c - a * e) * w) / det as fy,
  ((b * e - c * d) * u + (b * c - a * e) * v + (a * d - b * b) * w) / det as fz from (select *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) as det from fs))"""


def _axes(of: str) -> str:
    """CTEs that turn ``of`` (bx, by_, bz: backwards, ux, uy, uz: up) into axes a (right), d (up), c (back)."""
    return f"""f1_{of} as (select *, bx / sqrt(bx * bx + by_ * by_ + bz * bz) as c0, by_ / sqrt(bx * bx + by_ * by_ + bz * bz) as c1, bz / sqrt(bx * bx + by_ * by_ + bz * bz) as c2 from {of}),
f2_{of} as (select *, uy * c2 - uz * c1 as g0, uz * c0 - ux * c2 as g1, ux * c1 - uy * c0 as g2 from f1_{of}),
f3_{of} as (select *, g0 / sqrt(g0 * g0 + g1 * g1 + g2 * g2) as a0, g1 / sqrt(g0 * g0 + g1 * g1 + g2 * g2) as a1, g2 / sqrt(g0 * g0 + g1 * g1 + g2 * g2) as a2 from f2_{of}),
ax_{of} as (select *, c1 * a2 - c2 * a1 as d0, c2 * a0 - c0 * a2 as d1, c0 * a1 - c1 * a0 as d2 from f3_{of})"""


_OUT = ", ".join(f"{R(c)} as {n}" for c, n in zip(["x", "y", "z", "a0", "d0", "c0", "a1", "d1", "c1", "a2", "d2", "c2"], [*"xyz", *P.R9], strict=True))


def _poses(view) -> DataFrame:
    rotation = G.quat_to_rotmat(*(F.col(c) for c in ("qw", "qx", "qy", "qz")))
    return view("splats").select(F.col("gid").alias("pid"), "x", "y", "z", *(m.alias(n) for m, n in zip(rotation, P.R9, strict=True)))


def _rounded(path: DataFrame, key: str = "i") -> DataFrame:
    return path.select(key, *((r6(c) + 0.0).alias(c) for c in [*"xyz", *P.R9]))


@query("sc_trajectories", f"""{_POSES}, m as (select avg(x) as x, avg(y) as y, avg(z) as z, avg(r2) as bx, avg(r5) as by_, avg(r8) as bz, avg(r1) as ux, avg(r4) as uy, avg(r7) as uz,
  quantile_cont(abs(x), 0.9) as p, quantile_cont(abs(y), 0.9) as q, quantile_cont(abs(z), 0.9) as r from po), {_axes('m')},
l as (select i.i::int as i, ax_m.* exclude (bx, by_, bz), p * cos(i.i * 4 * pi() / 120) as l0, -q * sin(i.i * 4 * pi() / 120) as l1, -r * sin(0.5::double * i.i * 4 * pi() / 120) as l2 from ax_m, range(120) i(i)),
k as (select i, ux, uy, uz, x + a0 * l0 + d0 * l1 + c0 * l2 as x, y + a1 * l0 + d1 * l1 + c1 * l2 as y, z + a2 * l0 + d2 * l1 + c2 * l2 as z,
  a0 * l0 + d0 * l1 + c0 * (l2 + 1 / (0.25::double / 0.5 + 0.75::double / 8)) as bx, a1 * l0 + d1 * l1 + c1 * (l2 + 1 / (0.25::double / 0.5 + 0.75::double / 8)) as by_, a2 * l0 + d2 * l1 + c2 * (l2 + 1 / (0.25::double / 0.5 + 0.75::double / 8)) as bz from l),
{_axes('k')} select i, {_OUT} from ax_k""")
def _(view):
    return _rounded(P.spiral(_poses(view), 120, 0.5, 8.0))


def _ellipse_sql(axis: str) -> str:
    other, sign = ("y", "-") if axis == "z" else ("z", "")
    along = f"1.5::double + 0.2::double * (lo + (hi - lo) * (0.5::double * cos(t + pi() / 2) + 0.5))"
    place = {"x": "fx + p * cos(t)", other: f"f{other} + q * sin(t)", axis: along}
    return f"""{_POSES}{_FOCUS}, m as (select quantile_cont(abs(x - fx), 0.9) as p, quantile_cont(abs({other} - f{other}), 0.9) as q, quantile_cont({axis}, 0.1) as lo, quantile_cont({axis}, 0.9) as hi,
  avg(r1) as m0, avg(r4) as m1, avg(r7) as m2 from po, fo),
k0 as (select i.i::int as i, m.*, fo.*, i.i * 2 * pi() / 90 as t, case when abs(m0) >= greatest(abs(m1), abs(m2)) then sign(m0) else 0 end as ux, case when abs(m1) > abs(m0) and abs(m1) >= abs(m2) then sign(m1) else 0 end as uy,
  case when abs(m2) > greatest(abs(m0), abs(m1)) then sign(m2) else 0 end as uz from m, fo, range(90) i(i)),
k1 as (select *, {place['x']} as x, {place['y']} as y, {place['z']} as z from k0), k as (select *, {sign}(x - fx) as bx, {sign}(y - fy) as by_, {sign}(z - fz) as bz from k1), {_axes('k')} select i, {_OUT} from ax_k"""


@query("sc_trajectories_ellipse", _ellipse_sql("z"))
def _(view):
    return _rounded(P.ellipse(_poses(view), 90, "z", 1.5, 0.2, 0.25))


@query("sc_trajectories_ellipse_y", _ellipse_sql("y"))
def _(view):
    return _rounded(P.ellipse(_poses(view), 90, "y", 1.5, 0.2, 0.25))


@query("sc_trajectories_shift", f"""{_POSES} select pid, {R('x - (r0 * 0.5::double + r1 * -0.25::double + r2 * 2)')} as x, {R('y - (r3 * 0.5::double + r4 * -0.25::double + r5 * 2)')} as y, {R('z - (r6 * 0.5::double + r7 * -0.25::double + r8 * 2)')} as z,
{', '.join(f'{R(c)} as {c}' for c in P.R9)} from po""")
def _(view):
    return _rounded(P.shifted(_poses(view), (0.5, -0.25, 2.0)), "pid")


_LINE = _POSES + """, a as (select x, y, z from po order by pid limit 1), b as (select x, y, z from po order by pid desc limit 1 offset 1), c as (select * from po where pid = (select min(pid) from po)),
k as (select i.i::int as i, a.x * (1 - i.i / 59.0::double) + b.x * (i.i / 59.0::double) as x, a.y * (1 - i.i / 59.0::double) + b.y * (i.i / 59.0::double) + {wave} as y, a.z * (1 - i.i / 59.0::double) + b.z * (i.i / 59.0::double) as z,
  c.* exclude (pid, x, y, z) from a, b, c, range(60) i(i))""" + f" select i, {', '.join(f'{R(c)} as {c}' for c in [*'xyz', *P.R9])} from k"


def _line(view, **wave) -> DataFrame:
    poses = _poses(view)
    return _rounded(P.straight(poses, 60, poses.agg(F.min("pid")).first()[0], **wave))


@query("sc_trajectories_straight", _LINE.replace("{wave}", "0"))
def _(view):
    return _line(view)


@query("sc_trajectories_sine", _LINE.replace("{wave}", "0.3::double * sin(2 * pi() * 2 * i.i / 59.0::double)"))
def _(view):
    return _line(view, amplitude=0.3, waves=2.0)


_KEYS = ("x", "y", "z", "lx", "ly", "lz", "vx", "vy", "vz")


#: Five poses and degree four: the spline is the polynomial through them.
@query("sc_trajectories_spline", ctes("cams") + f""", p as (select cam, 6 * sa as x, 0::double as y, -6 * ca as z, 6 * sa + 0.1::double * sa as lx, 0::double as ly, -6 * ca - 0.1::double * ca as lz, 6 * sa as vx, 0.1::double as vy, -6 * ca as vz from cams),
d as (select *, coalesce(sqrt({' + '.join(f'({c} - lag({c}) over w) ** 2' for c in _KEYS)}), 0) as step from p window w as (order by cam)),
k as (select *, sum(step) over (order by cam) / (select sum(step) from d) as u from d),
g as (select i::int as i, i / (20.0::double) as t from range(20) r(i)),
b as (select g.i, a.cam, product((g.t - o.u) / (a.u - o.u)) as w from g, k a, k o where a.cam <> o.cam group by 1, 2),
s as (select i, {', '.join(f'sum(w * {c}) as {c}' for c in _KEYS)} from b join k using (cam) group by i),
q as (select i, x, y, z, x - lx as bx, y - ly as by_, z - lz as bz, vx - x as ux, vy - y as uy, vz - z as uz from s), {_axes('q')} select i, {_OUT} from ax_q""")
def _(view):
    zero, one = F.lit(0.0), F.lit(1.0)
    turn = [F.col("ca"), zero, -F.col("sa"), zero, one, zero, F.col("sa"), zero, F.col("ca")]
    keys = view("cams").select(F.col("cam").alias("pid"), (6 * F.col("sa")).alias("x"), zero.alias("y"), (-6 * F.col("ca")).alias("z"), *(t.alias(n) for t, n in zip(turn, P.R9, strict=True)))
    return _rounded(P.interpolated(keys, 5))
