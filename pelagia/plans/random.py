"""Queries with hashed randomness: sampling, noise, growing and thinning of splats; the SQL hashes alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.operators import density as D, extended as X, model, resample
from pelagia.plans import scene
from pelagia.plans.register import R, query, r6
from pelagia.plans.views import ctes, placed

SP, S, I = ctes("splats"), ctes("sonar_px"), ctes("img_px")


def U(seed: str, *keys: str) -> str:
    """The SQL of ``extended.uniform``."""
    return f"((('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'({k})::varchar' for k in keys)})), 1, 12))::bigint + 0.5) / {float(1 << 48)!r}::double)"


def N(seed: str, *keys: str) -> str:
    """The SQL of ``extended.normal``."""
    return f"(sqrt(-2 * ln({U(seed + ':r', *keys)})) * cos(2 * pi() * {U(seed + ':a', *keys)}))"


def draws(name: str, of: str, n: str, seed: str) -> str:
    """CTE ``name`` (draw, gid): n draws from ``of`` by opacity."""
    return f"""{name}_c as (select gid, sum(o) over (order by gid rows unbounded preceding) as s from {of} where o > 0),
{name}_q as (select draw, {U(seed, 'draw')} * (select max(s) from {name}_c) as u from (select unnest(range({n})) as draw)),
{name} as materialized (select draw, min(gid) as gid from {name}_q join {name}_c on s >= u group by draw)"""


def thinned(name: str, of: str, drawn: str) -> str:
    """CTE ``name``: splats drawn k times take the opacity and scales of one of k + 1."""
    terms = "list_sum(list_transform(range(1, n + 1), lambda j: case when j % 2 = 1 then 1 else -1 end * (factorial(n::int) / (factorial(j::int) * factorial((n - j)::int)))::double * pow(p, j) / sqrt(j)))"
    return f"""{name}_k as (select s.*, coalesce(k, 0) + 1 as n, 1 - pow(1 - o, 1.0::double / (coalesce(k, 0) + 1)) as p from {of} s left join (select gid, count(*) as k from {drawn} group by gid) using (gid)),
{name} as materialized (select * exclude (n, p) replace (case when n > 1 then greatest(p, 0.005) else o end as o, {', '.join(f'case when n > 1 then {s} * o / {terms} else {s} end as {s}' for s in D.SCALES)}) from {name}_k)"""


def relocation(name: str, of: str, dead: float) -> str:
    return f"""{name}_live as (select * from {of} where o > {dead}),
{draws(f'{name}_d', f'{name}_live', f'(select count(*) from {of} where o <= {dead})', 'relocate')},
{thinned(f'{name}_t', f'{name}_live', f'{name}_d')},
{name}_g as (select gid as slot, row_number() over (order by gid) - 1 as draw from {of} where o <= {dead}),
{name} as materialized (select * from {name}_t union all by name select t.* replace (slot as gid) from {name}_g join {name}_d d using (draw) join {name}_t t on d.gid = t.gid)"""


def addition(name: str, of: str, growth: float) -> str:
    return f"""{draws(f'{name}_d', of, f"(select floor({growth}::double * count(*))::bigint - count(*) from {of})", 'add')},
{thinned(f'{name}_t', of, f'{name}_d')},
{name} as materialized (select * from {name}_t union all by name select t.* replace (draw + (select max(gid) from {of}) + 1 as gid) from {name}_d d join {name}_t t using (gid))"""


#: rotations of the rows of a table like splats
def rotated(of: str) -> str:
    return scene.QS.replace("from splats", f"from {of}")


def noise(seed: str, *keys: str) -> dict[str, str]:
    """A normal step within the ellipsoid: R (scale * normal)."""
    return {c: " + ".join(f"m{i}{j} * {s} * {N(f'{seed}:{s}', *keys)}" for j, s in enumerate(D.SCALES)) for i, c in enumerate("xyz")}


_OUT = ("x", "y", "z", "sx", "sy", "sz", "o")
#: Scales of six digits over 1.6 end in a half at the seventh: they keep nine.
_SELECT = ", ".join(f"{R(c)} as {c}" if c not in D.SCALES else f"round({c}, 9) as {c}" for c in _OUT)


def _out(df, *keys: str):
    return df.select(*keys, *(F.round(c, 9 if c in D.SCALES else 6).alias(c) for c in _OUT))


@query("so_random_cap", f"{SP}, r as (select gid, scene, row_number() over (partition by scene order by {U('cap', 'gid')}, gid) as n from splats) select gid, scene from r where n <= 10")
def _(view):
    return X.random_cap(view("splats").select("gid", "scene"), "scene", 10)


@query("so_weighted_sample", f"{SP}, {draws('d', 'splats', '200', 'draw')} select draw, gid from d")
def _(view):
    return X.weighted_sample(view("splats").select("gid", "o"), "gid", "o", 200)


@query("so_uniform_box", ctes("cloud_a") + ", b as (select " + ", ".join(f"min({c}) as l{c}, max({c}) as h{c}" for c in "xyz") + " from cloud_a) select id, " + ", ".join(f"{R(f'l{c} + {U(f'box:{c}', 'id')} * (h{c} - l{c})')} as {c}" for c in "xyz") + " from (select unnest(range(500)) as id), b")
def _(view):
    return X.uniform_box(view("cloud_a"), 500).select("id", *(r6(c).alias(c) for c in "xyz"))


_G = noise("g", "gid", "k")


@query("so_gaussian_sample", f"{SP}, {rotated('splats')}, k as (select *, unnest(range(4))::int as k from rot) select gid, k, " + ", ".join(f"{R(f'{c} + {_G[c]}')} as {c}" for c in "xyz") + " from k")
def _(view):
    return X.gaussian_sample(view("splats"), 4).select("gid", "k", *(r6(c).alias(c) for c in "xyz"))


@query("so_plas_grid", f"""{SP}, k as (select * from splats order by o desc, gid limit (select floor(sqrt(count(*)))::bigint * floor(sqrt(count(*)))::bigint from splats)),
b as (select {', '.join(f'min({c}) as l{c}, max({c}) as h{c}' for c in 'xyz')} from k),
q as (select gid, {', '.join(f'round_even(({c} - l{c}) / (h{c} - l{c}) * 255, 0)::bigint as q{c}' for c in 'xyz')} from k, b),
m as (select gid, {' + '.join(f'(((q{c} >> {b}) & 1) << {3 * b + i})' for b in range(8) for i, c in enumerate('xyz'))} as code from q)
select gid, row_number() over (order by code, gid) - 1 as place from m""")
def _(view):
    return X.morton_grid(view("splats"), "gid", "o")


@query("sc_elevation_samples", f"{S}, k as (select *, unnest(range(3))::int as k from sonar_px where v > 0.9) select frame, rng, az, k, {R(f'0.2 * ({U('el', 'frame', 'rng', 'az', 'k')} - 0.5)')} as elevation from k")
def _(view):
    return X.elevation_samples(view("sonar_px").where("v > 0.9"), 3).select("frame", "rng", "az", "k", r6("elevation").alias("elevation"))


@query("flt_random_patch", f"""{I}, z as (select img, max(py) + 1 as h, max(px) + 1 as w from img_px group by img),
o as (select img, py, px, v, floor({U('patch:y', 'img')} * greatest(h - 7, 1))::int as oy, floor({U('patch:x', 'img')} * greatest(w - 7, 1))::int as ox from img_px join z using (img))
select img, py - oy as py, px - ox as px, v, {R('32::double - ox')} as cx, {R('24::double - oy')} as cy from o where py - oy between 0 and 7 and px - ox between 0 and 7""")
def _(view):
    return resample.random_patch(view("img_texts"), 8, 32.0, 24.0, placed)


_W = [f"w{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)]


def noised(of: str, scale: float = 0.01) -> str:
    """gid and the position moved by the covariance times gated noise; ``of`` has w00 .. w22."""
    step = [f"{N(f'noise:{c}', 'gid')} * {scale} / (1 + exp(-100 * (1 - o - 0.995)))" for c in "xyz"]
    return "select gid, " + ", ".join(f"{R(f'{c} + ' + ' + '.join(f'{_W[3 * i + j]} * {step[j]}' for j in range(3)))} as {c}" for i, c in enumerate("xyz")) + f", {R('sx')} as sx, {R('o')} as o from {of}"


@query("dm_noise", f"{SP}, {rotated('splats')} {noised('cov')}")
def _(view):
    return X.noised(view("splats")).select("gid", *(r6(c).alias(c) for c in ("x", "y", "z", "sx", "o")))


_SPLIT = noise("split", "gid", "child")


def grown(of: str, more: str = "") -> str:
    """Rows of ``of`` (rotated, act, child) with children moved and shrunk where act is split."""
    new = "act = 'split' and child > 0"
    return "select * replace (" + ", ".join([*(f"case when {new} then {c} + {_SPLIT[c]} else {c} end as {c}" for c in "xyz"), *(f"case when {new} or act = 'shrunk' then {s} / 1.6::double else {s} end as {s}" for s in D.SCALES)]) + f"){more} from {of}"


@query("dm_split", f"{SP}, {rotated('splats')}, a as (select *, case when o > 0.5 then 'split' else 'keep' end as act from rot), c as (select *, unnest(case act when 'split' then [1, 2] else [0] end) as child from a), d as ({grown('c')}) select gid, child, {_SELECT} from d")
def _(view):
    return _out(D.split(view("splats"), F.col("o") > 0.5), "gid", "child")


@query("dm_relocate", f"{SP}, {relocation('r', 'splats', 0.2)} select gid, {_SELECT} from r")
def _(view):
    return _out(D.relocated(view("splats"), 0.2), "gid")


@query("dm_sample_add", f"{SP}, {addition('a', 'splats', 1.05)} select gid, {_SELECT} from a")
def _(view):
    return _out(D.sample_added(view("splats"), 1.05, 1_000_000_000), "gid")


@query("dm_policy_mcmc", f"{SP}, {relocation('r', 'splats', 0.005)}, {addition('a', 'r', 1.05)}, {rotated('a')} {noised('cov')}")
def _(view):
    grown_ = D.sample_added(D.relocated(view("splats"), 0.005), 1.05, 1_000_000_000)
    return X.noised(grown_).select("gid", *(r6(c).alias(c) for c in ("x", "y", "z", "sx", "o")))


_STATS = ctes("splats", "observations") + f", {rotated('splats')}, g as (select gid, sum(grad) as grad, count(*) as n, max(radius) as radius from observations group by gid)"


@query("dm_densify_3dgs", f"""{_STATS}, a as (select r.*, round(coalesce(grad / n, 0), 9) as avg_, greatest(sx, sy, sz) as big from rot r left join g using (gid)),
b as (select *, case when avg_ >= 0.0002 and big > 0.01 * 13.0::double then 'split' when avg_ >= 0.0002 then 'clone' else 'keep' end as act from a),
c as (select *, unnest(case act when 'split' then [1, 2] when 'clone' then [0, 1] else [0] end) as child from b), d as ({grown('c')})
select gid, child, {_SELECT} from d where o >= 0.005 and greatest(sx, sy, sz) <= 0.1 * 13.0::double""")
def _(view):
    return _out(D.densified(view("splats"), model.grad_stats(view("observations")), 13.0), "gid", "child")


def _water(step: int) -> str:
    """Of one step before 15,000: growth beyond a reset by 100, culling by size after 3,000 and by screen size before 4,000."""
    grows = step % 3000 > 100
    wide = "(big > 0.13 or rad > 0.7)" if step < 4000 else "big > 0.13"
    act = f"case when high and {wide} then 'split' else 'keep' end" if grows else "'keep'"
    kinds = f"case when high and {wide} then [1, 2] else [0] end || case when high and big / (case when high and {wide} then 1.6::double else 1 end) <= 0.13 then [3] else [] end" if grows else "[0]"
    gone = ["o < 0.1"] if grows else ["false"]
    if grows and step > 3000:
        gone += ["greatest(sx, sy, sz) > 0.5"] + ["rad2 > 0.75"] * (step < 4000)
    reset = "least(o, 0.5)" if step % 3000 == 100 else "o"
    return f"""{_STATS}, a as (select r.*, round(coalesce(grad / n * 0.5 * 64, 0), 9) > 0.0064 as high, coalesce(radius, 0) as rad, greatest(sx, sy, sz) as big from rot r left join g using (gid)),
b as (select *, {act} as act, {kinds} as kinds from a), c as (select *, unnest(kinds) as kind from b), c2 as (select * replace (case when kind = 3 and act = 'split' then 'shrunk' else act end as act), kind as child, case when kind > 0 then 0 else rad end as rad2 from c),
d as ({grown('c2')}), e as (select * replace ({reset} as o) from d where not ({' or '.join(gone)})) select gid, child::int as child, {_SELECT} from e"""


def _refined(view, step: int):
    stats = model.grad_stats(view("observations"))
    return _out(D.water_refined(view("splats"), stats, step, 64, grow=0.0064, size=0.13, split_screen=0.7, cull_screen=0.75), "gid", "child")


@query("dm_cull_water", _water(3500))
def _(view):
    return _refined(view, 3500)


@query("dm_cull_water_late", _water(4500))
def _(view):
    return _refined(view, 4500)


@query("dm_cull_water_reset", _water(6100))
def _(view):
    return _refined(view, 6100)
