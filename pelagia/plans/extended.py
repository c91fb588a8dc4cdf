"""Queries: surfels, water, windows of pixels, joins by name and place, sampling, model edits with hashed randomness."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from pelagia.functions import geometry as G
from pelagia.operators import cloud, extended as X, image_rows, raster, resample, surfel
from pelagia.operators.model import poses_bounds
from pelagia.plans import scene
from pelagia.plans.imaging import I, S
from pelagia.plans.register import R, query, r6
from pelagia.plans.views import ctes, placed
from pelagia.session import scratch, written

SP = ctes("splats")


def _saved(df: DataFrame, form: str) -> DataFrame:
    """``df`` written as text files of the form by the executors, and read back."""
    path = scratch(df.sparkSession)
    df.write.format(form).save(path)
    return df.sparkSession.read.schema(df.schema).format(form).load(path)


@query("flt_label_mask", f"{S}, m as (select ltrim(lpad(frame::varchar, 4, '0'), '0') as stem, rng, az from sonar_px where v > 0.5), p as (select frame, ltrim(frame::varchar, '0') as stem, rng, az, v from sonar_px) select frame, count(*) as n, {R('sum(case when m.rng is not null then v else 0 end)')} as v from p left join m using (stem, rng, az) group by frame")
def _(view):
    px = view("sonar_px")
    labels = px.where("v > 0.5").select(F.lpad(F.col("frame").cast("string"), 4, "0").alias("file"), "rng", "az")
    return X.masked(px.withColumn("file", F.col("frame").cast("string")), labels).groupBy("frame").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("v"))


@query("flt_nan_cov", f"{SP} select gid from splats where gid % 7 <> 0")
def _(view):
    cov = F.array(*raster.world_covariance(), F.when(F.col("gid") % 7 == 0, float("nan")).otherwise(0.0))
    return view("splats").select("gid", cov.alias("cov")).where(~F.exists("cov", lambda c: F.isnan(c))).select("gid")


@query("sink_ply_splats", f"{SP} select gid, o from splats where gid % 7 <> 0 and gid % 11 <> 0")
def _(view):
    odd = F.when(F.col("gid") % 7 == 0, float("nan")).when(F.col("gid") % 11 == 0, float("inf")).otherwise(F.col("o"))
    return view("splats").select("gid", F.array(odd, "x", "y").alias("p"), "o").where(X.finite(F.col("p"))).select("gid", "o")


@query("flt_in_image", scene.PROJECTED + f" select cam, gid, {R('depth')} as depth from pr where u >= 0 and u < width and v >= 0 and v < height and depth > 0")
def _(view):
    return scene.projected(view).where("u >= 0 and u < width and v >= 0 and v < height and depth > 0").select("cam", "gid", r6("depth").alias("depth"))


@query("sc_rotmat_quat", scene.SPLATS + f", q as (select gid, 0.5 * sqrt(1 + m00 + m11 + m22) as w, m21 - m12 as a, m02 - m20 as b, m10 - m01 as c from rot where 1 + m00 + m11 + m22 > 0.01) select gid, {R('w')} as w, {R('a / (4 * w)')} as x, {R('b / (4 * w)')} as y, {R('c / (4 * w)')} as z from q")
def _(view):
    m = G.quat_to_rotmat(*(F.col(c) for c in ("qw", "qx", "qy", "qz")))
    # 1 + trace is 4 w^2: the filter stands on the plain columns, so the rotation is not evaluated twice
    turned = view("splats").where("4 * qw * qw > 0.01 * (qw * qw + qx * qx + qy * qy + qz * qz)")
    df = turned.select("gid", *(c.alias(f"m{i}") for i, c in enumerate(m)))
    return df.select("gid", *(r6(c).alias(n) for n, c in zip("wxyz", X.quat_of([F.col(f"m{i}") for i in range(9)]), strict=True)))


@query("sc_depth_to_normal", f"""{I}, d as (select img, py, px, v::double as v, lead(v) over (partition by img, py order by px)::double - v as gx, lead(v) over (partition by img, px order by py)::double - v as gy from img_px)
select img, py, px, {R('-gx / sqrt(gx * gx + gy * gy + 1)')} as nx, {R('-gy / sqrt(gx * gx + gy * gy + 1)')} as ny from d where gx is not null and gy is not null""")
def _(view):
    return image_rows.normals(view("img_rows"), 6)


_SIZES = f"{I}, z as (select img, max(py) + 1 as h, max(px) + 1 as w from img_px group by img)"


@query("sc_cart_sector_to_polar", f"""{_SIZES}, e as (select *, unnest(range(h))::int as r from z), f as (select *, unnest(range(w))::int as a from e),
g as (select img, r, a, least(w - 1, trunc(round(w // 2 + (r + 0.5::double) / h * (w // 2) * sin((a - w // 2) * (pi() * 2 / 3) / w), 9)))::int as px, least(h - 1, trunc(round((r + 0.5::double) / h * h * cos((a - w // 2) * (pi() * 2 / 3) / w), 9)))::int as py from f)
select img, r, a, v from g join img_px using (img, px, py)""")
def _(view):
    return resample.sector_to_polar(view("img_rows"), math.pi * 2 / 3).withColumn("v", F.col("v").cast("int"))


@query("sc_medium_transport", f"""{scene.WEIGHTED}, k as (select *, coalesce(lag(depth) over (partition by cam, px, py order by depth, gid), 0) as d0 from ww)
select cam, px, py, {R('sum(alpha * t * r * exp(-0.2 * depth))')} as object, {R('sum(t * 0.3 * (exp(-0.2 * d0) - exp(-0.2 * depth)))')} as medium from k group by 1, 2, 3""")
def _(view):
    m = X.medium(scene.weighted(view), 0.2, 0.3)
    return m.groupBy("cam", "px", "py").agg(r6(F.sum("object")).alias("object"), r6(F.sum("medium")).alias("medium"))


@query("ag_medium_composite", f"""{scene.WEIGHTED}, k as (select *, coalesce(lag(depth) over (partition by cam, px, py order by depth, gid), 0) as d0 from ww)
select cam, {R('sum(alpha * t * r * exp(-0.2 * depth))')} as object, {R('sum(alpha * t * r)')} as clear, {R('sum(t * 0.3 * (exp(-0.2 * d0) - exp(-0.2 * depth)))')} as medium from k group by cam""")
def _(view):
    m = X.medium(scene.weighted(view), 0.2, 0.3)
    return m.groupBy("cam").agg(r6(F.sum("object")).alias("object"), r6(F.sum(F.col("alpha") * F.col("t") * F.col("r"))).alias("clear"), r6(F.sum("medium")).alias("medium"))


_ST = "select 'src' || (l_suppkey % 40) as name, l_suppkey::int as k from (select distinct l_suppkey from lineitem)"


@query("jn_frame_stem", f"with f as (select distinct source as stem from documents), p as ({_ST}) select stem, max(k)::int as k from f left join p on stem = name group by stem")
def _(view):
    stems = view("documents").select(F.col("source").alias("stem")).distinct()
    files = view("lineitem").select("l_suppkey").distinct().select(F.concat(F.lit("src"), (F.col("l_suppkey") % 40)).alias("stem"), F.col("l_suppkey").cast("int").alias("k"))
    return stems.join(files, "stem", "left").groupBy("stem").agg(F.max("k").alias("k"))


@query("jn_nav_index", "select doc_id as i, printf('%05d', doc_id + 1) as file from documents where doc_id + 1 in (select doc_id from labels)")
def _(view):
    nav = view("documents").select(F.col("doc_id").alias("i"), F.format_string("%05d", F.col("doc_id") + 1).alias("file"))
    files = view("labels").select(F.format_string("%05d", "doc_id").alias("file")).distinct()
    return nav.join(files, "file").select("i", "file")


@query("jn_positional", "with a as (select c_name as a, row_number() over (order by c_name) as i from customer), b as (select s_name as b, row_number() over (order by s_name) as i from supplier) select i - 1 as i, a, b from a join b using (i)")
def _(view):
    return X.zipped(view("customer").select(F.col("c_name").alias("a")), view("supplier").select(F.col("s_name").alias("b")), "a", "b")


@query("jn_extr_intr", "select c_custkey as k, n_name as model, c_acctbal::double as bal from customer join nation on c_nationkey = n_nationkey")
def _(view):
    models = view("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("model"))
    return view("customer").join(models, "c_nationkey").select(F.col("c_custkey").alias("k"), "model", F.col("c_acctbal").cast("double").alias("bal"))


@query("jn_point_tracks", "select l_suppkey as img, count(distinct l_partkey) as points, min(l_partkey) as first from lineitem group by 1")
def _(view):
    tracks = view("lineitem").groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("seen"))
    return tracks.select(F.explode("seen").alias("img"), "l_partkey").groupBy("img").agg(F.count("*").alias("points"), F.min("l_partkey").alias("first"))


@query("jn_interval_member", ctes("splats") + ", b as (select scene, min(x) + 1 as lo, max(x) - 1 as hi from splats group by scene) select scene, count(*) as n, arg_max(gid, (o, -gid)) as top from splats join b using (scene) where x between lo and hi group by scene")
def _(view):
    sp = view("splats")
    box = sp.groupBy("scene").agg((F.min("x") + 1).alias("lo"), (F.max("x") - 1).alias("hi"))
    return sp.join(box, "scene").where("x between lo and hi").groupBy("scene").agg(F.count("*").alias("n"), F.max_by("gid", F.struct("o", -F.col("gid"))).alias("top"))


@query("jn_peak_window", f"""{S}, p as (select frame, rng, sum(v) as s from sonar_px group by 1, 2), q as (select frame, rng as bin, o::int as o, least(63, greatest(0, rng + o))::int as rng from (select distinct frame, rng from sonar_px), range(-2, 3) t(o))
select frame, bin, arg_max(rng, (round(s, 9), -o)) as peak from q join p using (frame, rng) group by frame, bin""")
def _(view):
    profile = view("sonar_px").groupBy("frame", "rng").agg(F.sum("v").alias("s"))
    return X.peak_near(profile, 2, 64)


_GRID = "g as (select x.i::int as gx, y.i::int as gy from range(-4, 5) x(i), range(-4, 5) y(i))"


@query("jn_grid_eval", f"{SP}, {_GRID} select gx, gy, {R('sum(o * exp(-0.5 * ((gx - x) * (gx - x) + (gy - y) * (gy - y)) / (sx * sx)))')} as density from g, splats where abs(gx - x) <= 3 * sx and abs(gy - y) <= 3 * sx group by 1, 2")
def _(view):
    return X.grid_density(view("splats"), -4, 4).select("gx", "gy", r6("density").alias("density"))


@query("jn_method_pairs", "with p as (select lang, source, arg_min(md5(coalesce(text, '')), doc_id) as image from documents group by all) select a.lang as a, b.lang as b, count(*) as scenes, count(*) filter (a.image = b.image) as equal_ from p a join p b using (source) group by 1, 2")
def _(view):
    p = view("documents").groupBy("lang", "source").agg(F.min_by(F.md5(F.coalesce("text", F.lit(""))), "doc_id").alias("image"))
    side = lambda n: p.select("source", F.col("lang").alias(n), F.col("image").alias(f"i{n}"))
    return side("a").join(side("b"), "source").groupBy("a", "b").agg(F.count("*").alias("scenes"), F.count_if(F.col("ia") == F.col("ib")).alias("equal_"))


@query("ag_hist_2d_gauss", f"""{S}, p as (select frame, row_number() over (order by frame, rng, az) as id, v as a, rng / 64::double as b from sonar_px),
k as (select frame, id, k, exp(-0.5 * pow((a - (k + 0.5) / 8) / 0.1, 2)) as wa, exp(-0.5 * pow((b - (k + 0.5) / 8) / 0.1, 2)) as wb from p, range(8) t(k)),
n as materialized (select frame, id, k::int as k, wa / sum(wa) over (partition by id) as wa, wb / sum(wb) over (partition by id) as wb from k)
select x.frame, x.k as i, y.k as j, {R('sum(x.wa * y.wb)')} as w from n x join n y using (id) group by 1, 2, 3""")
def _(view):
    points = view("sonar_px").select("frame", F.col("v").alias("a"), (F.col("rng") / 64.0).alias("b"))
    return X.kernel_histogram_2d(points, 8, 0.1).select("frame", "i", "j", r6("w").alias("w"))


@query("ag_static_corr", f"{I}, m as (select *, median(v) over (partition by py, px) as m from img_px) select img, {R('(count(*) * sum(v::double * m) - sum(v::double) * sum(m)) / nullif(sqrt((count(*) * sum(v::double * v) - sum(v::double) * sum(v::double)) * (count(*) * sum(m * m) - sum(m) * sum(m))), 0)')} as c, {R('stddev_pop(v)')} as s from m group by img having count(distinct v) > 1 and count(distinct m) > 1")
def _(view):
    return image_rows.static_likeness(view("img_rows")).select("img", r6("c").alias("c"), r6("s").alias("s"))


@query("ag_edge_profile", f"{I}, r as (select img, py, sum(v)::double / count(*) as m from img_px group by 1, 2), d as (select img, py, abs(m - lag(m) over (partition by img order by py)) as d from r) select img, arg_max(py, (round(d, 9), -py)) as row_, {R('max(d)')} as d, max(d) >= 2 and max(d) > 5 * median(d) as hard from d where d is not null group by img")
def _(view):
    return image_rows.edge_profile(view("img_rows")).select("img", "row_", r6("d").alias("d"), "hard")


@query("ag_icv", f"{I}, w as (select img, py // 4 as wy, px // 4 as wx, count(*)::bigint as n, sum(v)::bigint as s1, sum(v * v)::bigint as s2 from img_px group by 1, 2, 3), s as (select img, s1::double / n as m, sqrt((n * s2 - s1 * s1)::double / (n * n)) as s from w) select img, {R('avg(m / s)')} as icv from s where s > 0 group by img")
def _(view):
    return X.icv(view("img_px"), 4).select("img", r6("icv").alias("icv"))


def _blur(of: str, names: tuple[str, ...], window: str) -> str:
    """One pass of an 11-tap Gaussian window of sigma 1.5, zeros beyond the edge."""
    raw = [f"exp({-k * k} / 4.5::double)" for k in range(-5, 6)]
    total = "(" + " + ".join(raw) + ")"
    taps = lambda c: " + ".join(f"{raw[k + 5]} / {total} * " + (c if not k else f"coalesce({'lag' if k < 0 else 'lead'}({c}, {abs(k)}) over w, 0)") for k in range(-5, 6))
    return f"select img, py, px, {', '.join(f'{taps(c)} as {c}' for c in names)} from {of} window w as ({window})"


_FIVE = ("a", "b", "aa", "bb", "ab")


@query("ag_ssim", f"""{I}, p as (select img, py, px, v / 255.0::double as a, (255 - v) / 255.0::double * 0.2 + v / 255.0::double * 0.8 as b from img_px), q as (select *, a * a as aa, b * b as bb, a * b as ab from p),
r as ({_blur('q', _FIVE, 'partition by img, py order by px')}), c as ({_blur('r', _FIVE, 'partition by img, px order by py')})
select img, {R('avg((2 * a * b + 0.0001) * (2 * (ab - a * b) + 0.0009) / ((a * a + b * b + 0.0001) * (aa - a * a + bb - b * b + 0.0009)))')} as ssim from c group by img""")
def _(view):
    pair = lambda v: (v / 255.0, (255 - v) / 255.0 * 0.2 + v / 255.0 * 0.8)
    return image_rows.similarity(view("img_rows"), pair).select("img", r6("ssim").alias("ssim"))


@query("ag_reflectivity_reg", ctes("cloud_a") + f", d as (select a.pid as q, b.pid as p, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 9) as d2 from cloud_a a, cloud_a b), k as (select *, row_number() over (partition by q order by d2, p) as r from d) select {R('avg(pow((k.q % 10 - k.p % 10) / 10.0::double, 2)) + 0.1 * (select var_pop((pid % 10) / 10.0::double) from cloud_a)')} as loss from k where r between 2 and 4")
def _(view):
    a = view("cloud_a")
    near = cloud.nearest(a, a, 4).where("rank > 1")
    smooth = near.agg(F.avg(((F.col("qid") % 10 - F.col("pid") % 10) / 10.0) ** 2).alias("s"))
    return smooth.crossJoin(a.agg(F.var_pop((F.col("pid") % 10) / 10.0).alias("v"))).select(r6(F.col("s") + 0.1 * F.col("v")).alias("loss"))


_AXIS = lambda a, rest: f"(select avg(pow(n - v, 2)) from (select v, lead(v) over w as n, lead({a}) over w as nx, {a} as x from sonar_px window w as (partition by {rest} order by {a})) where nx = x + 1)"


@query("ag_bilagrid_tv", f"{S} select {R(_AXIS('frame', 'rng, az') + ' + ' + _AXIS('rng', 'frame, az') + ' + ' + _AXIS('az', 'frame, rng'))} as tv")
def _(view):
    return X.grid_variation(view("sonar_px"), ("frame", "rng", "az"), "v").select(r6("tv").alias("tv"))


@query("ag_hue_component", f"""{I.replace('with ', 'with recursive ', 1)}, b as materialized (select img, py, px, py * 16 + px as id from img_px where v between 102 and 104 and px >= 4),
e as materialized (select a.img, a.id as s, c.id as t from b a join b c on a.img = c.img and abs(a.py - c.py) <= 1 and abs(a.px - c.px) <= 1),
r as (select img, id as s, id as t from b union select r.img, r.s, e.t from r join e on r.img = e.img and r.t = e.s),
c as materialized (select img, s as id, min(t) as root from r group by 1, 2),
k as materialized (select c.img, root, count(*) as area, min(py) as top from c join b using (img, id) group by 1, 2),
m as (select img, count(*) as n, sum(area) as total from k group by 1),
o as (select * from k qualify row_number() over (partition by img order by area desc, root) = 1),
x as (select o.img, max(px) as last from o join c on c.img = o.img and c.root = o.root join b on b.img = c.img and b.id = c.id where b.py = o.top group by 1)
select img, n, area, case when area >= 3 and 16 - last <= 8 and area >= 0.2 * total then top end::bigint as row_ from o join m using (img) join x using (img)""")
def _(view):
    return X.band_component(view("img_px").where("px >= 4"), 102, 104, 3, 16, 8, 0.2)


@query("ag_mutual_info", f"""{scene.WEIGHTED}, p as materialized (select cam, px, py, gid, alpha * t / sum(alpha * t) over (partition by cam, px, py) as p from ww),
h as (select cam, px, py, -sum(p * log2(p)) as h from p group by all),
c as (select a.cam, a.px, a.py, a.gid, a.p * -sum(case when a.gid = b.gid then 0 else b.p / a.p * log2(b.p / a.p) end) as c from p a join p b using (cam, px, py) group by a.cam, a.px, a.py, a.gid, a.p)
select cam, px, py, gid, {R('h - c')} as bits from c join h using (cam, px, py)""")
def _(view):
    w = scene.weighted(view).select("cam", "px", "py", "gid", (F.col("alpha") * F.col("t")).alias("w"))
    p = F.col("w") / F.sum("w").over(Window.partitionBy("cam", "px", "py"))
    return X.information(w.withColumn("p", p), "cam", "px", "py").select("cam", "px", "py", "gid", r6("h").alias("bits"))


@query("wn_edge_scan", f"{I}, r as (select img, py, sum(v)::double / count(*) < 90 as hit from img_px group by 1, 2), d as (select *, max(case when hit then py end) over (partition by img order by py rows unbounded preceding) as deep from r), b as (select img, min(py) as stop from d where py - coalesce(deep, -1) >= 3 group by img) select d.img, coalesce(max(py) filter (hit and py < coalesce(stop, 1000)), -1)::int as edge from d left join b using (img) group by d.img")
def _(view):
    return image_rows.edge_scan(view("img_texts"), 90.0, 3, rows=placed)


@query("src_sonar_config", "select event_id, (event_id % 512)::int as bins, (event_id % 30)::double as range_max from events")
def _(view):
    text = F.concat(F.lit('{"agents":[{"sensors":[{"configuration":{}},{"configuration":{"RangeBins":'), (F.col("event_id") % 512).cast("string"), F.lit(',"RangeMax":'), (F.col("event_id") % 30).cast("string"), F.lit("}}]}]}"))
    return X.sonar_config(view("events").select("event_id", text.alias("json"))).select("event_id", "bins", "range_max")


@query("src_test_scene", f"{SP}, b as (select * from splats where abs(x) <= 1 and abs(y) <= 1 and abs(z) <= 1) select gid, i::int as i, j::int as j, {R('x + 2 * i')} as x, {R('y + 2 * j')} as y from b, range(3) a(i), range(3) c(j)")
def _(view):
    return X.lattice(view("splats"), 1.0, 3).select("gid", "i", "j", r6("x").alias("x"), r6("y").alias("y"))


_LLFF = ("ca", "0", "-sa", "0", "h", "0", "1", "0", "0", "w", "sa", "0", "ca", "6", "f")


@query("sink_llff", scene.PROJECTED + f", q as (select cam, coalesce(quantile_cont(depth, 0.01), 0.1) as near, coalesce(quantile_cont(depth, 0.99), 100) as far from pr group by cam), p as (select cam, ca, sa, 48::double as h, 64::double as w, fx as f from cams) select cam, {', '.join(f'{R(f'({c})::double')} as m{i}' for i, c in enumerate(_LLFF))}, {R('coalesce(near, 0.1)')} as near, {R('coalesce(far, 100)')} as far from p left join q using (cam)")
def _(view):
    """A row of 17 numbers a camera: the 3 x 5 matrix (the turned axes, the translation, height, width and focal length) and the bounds."""
    cams, zero, one = view("cams"), F.lit(0.0), F.lit(1.0)
    ca, sa = F.col("ca"), F.col("sa")
    axes = [ca, zero, -sa, zero, one, zero, sa, zero, ca]  # camera to world, by rows
    poses = cams.select("cam", *(c.alias(f"r{i}") for i, c in enumerate(axes)), *(F.col(c).alias(c) for c in ("tx", "ty", "tz")), F.col("height").cast("double"), F.col("width").cast("double"), "fx")
    lines = poses_bounds(poses, scene.projected(view), "cam")
    saved = _saved(lines, "csv")
    return saved.select("cam", *(r6(c).alias(c) for c in saved.columns if c != "cam"))


@query("sink_cameras_json", ctes("cams") + """ select cam, '{"id":' || cam || ',"width":64,"height":48,"img_name":"cam' || cam || '","position":[' || (tz * sa) || ',0.0,' || (-tz * ca) || '],"rotation":[[' || ca || ',0.0,' || (-sa) || '],[0.0,1.0,0.0],[' || sa || ',0.0,' || ca || ']],"fx":' || fx || ',"fy":' || fy || '}' as line from cams""")
def _(view):
    # where the camera stands and how it is turned in the world: the inverse of x' = R x + t, with t along z
    zero, one, ca, sa, tz = F.lit(0.0), F.lit(1.0), F.col("ca"), F.col("sa"), F.col("tz")
    rotation = F.array(F.array(ca, zero, -sa), F.array(zero, one, zero), F.array(sa, zero, ca))
    body = F.struct(F.col("cam").alias("id"), "width", "height", F.concat(F.lit("cam"), "cam").alias("img_name"), F.array(tz * sa, zero, -tz * ca).alias("position"), rotation.alias("rotation"), "fx", "fy")
    return _saved(view("cams").select("cam", F.to_json(body).alias("line")), "json")


@query("sink_jsonl_csv_json", "select doc_id, lang || ';' || source || ',' || printf('%.6f', n_chars / 7.0::double) as line from documents")
def _(view):
    df = view("documents").select("doc_id", F.concat(F.array_join(F.array("lang", "source"), ";"), F.lit(","), F.format_string("%.6f", F.col("n_chars") / 7.0)).alias("line"))
    return _saved(_saved(df, "json"), "csv")


@query("sink_eval_json", ctes("telemetry") + f" select kind as stage, {R('avg(value)')} as mean, count(distinct run) as runs, max(step) as last from telemetry group by kind")
def _(view):
    return _saved(view("telemetry").groupBy(F.col("kind").alias("stage")).agg(r6(F.avg("value")).alias("mean"), F.count_distinct("run").alias("runs"), F.max("step").alias("last")), "json")


@query("ud_codec_map", f"{SP}, b as (select min(x) as xl, max(x) as xh, min(o) as ol, max(o) as oh from splats) select gid, round_even((x - xl) / (xh - xl) * 65535, 0)::int as x, round_even((o - ol) / (oh - ol) * 255, 0)::int as o from splats, b")
def _(view):
    return X.coded(view("splats").select("gid", "x", "o"), {"x": 16, "o": 8})


@query("ud_distributed", "select n_nationkey as cam, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1")
def _(view):
    return view("customer").repartition(F.col("c_nationkey")).groupBy(F.col("c_nationkey").alias("cam")).agg(F.count("*").alias("n"))


_FLAT = scene.CAMERA.replace("cc as (select *,", "cc as (select *, ca * m00 * sx + sa * m20 * sx as a0, m10 * sx as a1, -sa * m00 * sx + ca * m20 * sx as a2, ca * m01 * sy + sa * m21 * sy as b0, m11 * sy as b1, -sa * m01 * sy + ca * m21 * sy as b2, ca * m02 + sa * m22 as n0, m12 as n1, -sa * m02 + ca * m22 as n2,") + """,
t as (select * replace (0 as m00), fx * a0 + cx * a2 as t00, fx * b0 + cx * b2 as t01, fx * mx + cx * mz as t02, fy * a1 + cy * a2 as t10, fy * b1 + cy * b2 as t11, fy * my + cy * mz as t12, a2 as t20, b2 as t21, mz as t22, round(mz, 9) as depth,
  case when mx * n0 + my * n1 + mz * n2 < 0 then 1 else -1 end as facing from cc),
d as (select *, t20 * t20 + t21 * t21 - t22 * t22 as d from t),
e as (select *, round((t00 * t20 + t01 * t21 - t02 * t22) / d, 9) as u, round((t10 * t20 + t11 * t21 - t12 * t22) / d, 9) as v, (t00 * t00 + t01 * t01 - t02 * t02) / d as e0, (t10 * t10 + t11 * t11 - t12 * t12) / d as e1 from d where abs(d) > 1e-6),
h as (select *, case when depth > 0.01 and depth < 1e10 then ceil(round(3 * greatest(sqrt(greatest(1e-4, u * u - e0)), sqrt(greatest(1e-4, v * v - e1))), 6))::int else 0 end as rad from e),
pr as materialized (select cam, gid, u, v, depth, o, r, tile, width, height, t00, t01, t02, t10, t11, t12, t20, t21, t22, facing * n0 as nx, facing * n1 as ny, facing * n2 as nz, case when u + rad > 0 and u - rad < width and v + rad > 0 and v - rad < height then rad else 0 end as radius from h)"""
_FLAT_PAIRS = _FLAT + scene.TILED[len(scene.PROJECTED):] + """,
p1 as (select *, unnest(range(tile_y * tile, least((tile_y + 1) * tile, height)))::int as py from tl), p2 as (select *, unnest(range(tile_x * tile, least((tile_x + 1) * tile, width)))::int as px from p1),
p3 as (select *, (px + 0.5) * t20 - t00 as a0, (px + 0.5) * t21 - t01 as a1, (px + 0.5) * t22 - t02 as a2, (py + 0.5) * t20 - t10 as b0, (py + 0.5) * t21 - t11 as b1, (py + 0.5) * t22 - t12 as b2 from p2),
p4 as (select *, a1 * b2 - a2 * b1 as ray0, a2 * b0 - a0 * b2 as ray1, a0 * b1 - a1 * b0 as ray2 from p3),
p5 as (select *, round(0.5 * least(case when ray2 <> 0 then (ray0 * ray0 + ray1 * ray1) / (ray2 * ray2) end, 2 * ((px + 0.5 - u) * (px + 0.5 - u) + (py + 0.5 - v) * (py + 0.5 - v))), 9) as sigma from p4),
p6 as (select *, round(least(0.999, o * exp(-sigma)), 9) as alpha from p5),
pp as materialized (select * from p6 where alpha >= round(1 / 255.0::double, 9))"""
_FLAT_WEIGHTS = _FLAT_PAIRS + scene.WEIGHTED[len(scene.PAIRS):]


def _flat(view) -> DataFrame:
    return written(surfel.project(raster.cameras_by_splats(view("cams"), view("splats").repartition("gid"))))


def _surfels(view) -> DataFrame:
    return surfel.pixel_pairs(raster.tiles(_flat(view)))


@query("jn_tile_pixels_2dgs", f"{_FLAT_PAIRS} select cam, gid, count(*) as n, {R('sum(alpha)')} as a from pp group by 1, 2")
def _(view):
    return _surfels(view).groupBy("cam", "gid").agg(F.count("*").alias("n"), r6(F.sum("alpha")).alias("a"))


_SUMS = ("r", "a", "d", "nx", "ny", "nz", "distortion")


@query("ag_composite_2dgs", f"""{_FLAT_WEIGHTS}, w2 as (select *, alpha * t as w from ww),
w3 as (select *, coalesce(sum(w) over b, 0) as pa, coalesce(sum(w * depth) over b, 0) as pd from w2 window b as (partition by cam, px, py order by depth, gid rows between unbounded preceding and 1 preceding))
select cam, px, py, {R('sum(w * r)')} as r, {R('sum(w)')} as a, {R('sum(w * depth)')} as d, {R('sum(w * nx)')} as nx, {R('sum(w * ny)')} as ny, {R('sum(w * nz)')} as nz, {R('sum(2 * w * (depth * pa - pd))')} as distortion, {R('max(depth) filter (round(t, 9) > 0.5)')} as median from w3 group by 1, 2, 3""")
def _(view):
    return surfel.composite(raster.transmittance(_surfels(view))).select("cam", "px", "py", *(r6(c).alias(c) for c in _SUMS), r6("median").alias("median"))


@query("sc_proj_2dgs", f"{_FLAT} select cam, gid, radius, {R('u')} as u, {R('v')} as v, {R('depth')} as depth, {R('nx')} as nx, {R('ny')} as ny, {R('nz')} as nz from pr where radius > 0")
def _(view):
    return _flat(view).where("radius > 0").select("cam", "gid", "radius", *(r6(c).alias(c) for c in ("u", "v", "depth", "nx", "ny", "nz")))


@query("wn_median_filter", f"{I}, m as (select img, py, px, v, median(v) over (partition by img, px order by py rows between 2 preceding and 2 following) as m from img_px) select img, py, px, m::double as m, abs(v - m) > 60 as odd from m")
def _(view):
    return image_rows.column_medians(view("img_rows"), 2, 60)


@query("wn_edge_peaks", f"{I}, r as (select img, py, sum(v)::double / count(*) as m from img_px group by 1, 2), d as (select img, py, round(abs(m - lag(m) over (partition by img order by py)), 9) as d from r), n as (select *, coalesce(lag(d) over w, 0) as b, coalesce(lead(d) over w, 0) as a from d where d is not null window w as (partition by img order by py)), k as (select img, py, d, row_number() over (partition by img order by d desc, py)::int as r from n where d >= 2 and d > b and d >= a) select img, py, d, r from k where r <= 3")
def _(view):
    return image_rows.edge_peaks(view("img_rows"), 2.0, 3)


@query("ag_mask_props", f"""{I}, z as (select img, max(py) + 1 as h, max(px) + 1 as w from img_px group by img), e as (select p.*, py < h // 10 or py >= h - h // 10 or px < w // 10 or px >= w - w // 10 as edge from img_px p join z using (img))
select img, count(*) filter (v > 110) as area, {R('avg(py) filter (v > 110)')} as cy, {R('avg(px) filter (v > 110)')} as cx, min(py) filter (v > 110) as y0, max(py) filter (v > 110) as y1, {R('avg(v) filter (v > 110)')} as inside, {R('avg(v) filter (v <= 110)')} as outside,
{R('count(*) filter (v > 110 and edge) / (count(*) filter (v > 110))::double')} as edge, {R('stddev_pop(v) filter (v > 110)')} as std from e group by img having count(*) filter (v > 110) > 0""")
def _(view):
    return image_rows.mask_props(view("img_rows"), 110).select("img", "area", "y0", "y1", *(r6(c).alias(c) for c in ("cy", "cx", "inside", "outside", "edge", "std")))


@query("sc_affine_color", f"{SP} select gid, round(0.9 * r + 0.05 * g + 0.02 * b + 0.01, 9) as r, round(0.03 * r + 0.92 * g - 0.01 * b, 9) as g, round(0.01 * r + 0.04 * g + 0.88 * b + 0.02, 9) as b from splats")
def _(view):
    rows = ((0.9, 0.05, 0.02, 0.01), (0.03, 0.92, -0.01, 0.0), (0.01, 0.04, 0.88, 0.02))
    return view("splats").select("gid", *(F.round(a * F.col("r") + b * F.col("g") + c * F.col("b") + d, 9).alias(n) for n, (a, b, c, d) in zip("rgb", rows, strict=True)))


@query("ag_pose_normalise", ctes("cloud_a") + f", m as (select median(x) as a, median(y) as b, median(z) as c from cloud_a), q as (select pid, x - a as x, y - b as y, z - c as z from cloud_a, m), s as (select median(sqrt(x * x + y * y + z * z)) as s from q) select pid, {R('x / s')} as x, {R('y / s')} as y, {R('z / s')} as z from q, s")
def _(view):
    return X.normalised(view("cloud_a")).select("pid", *(r6(c).alias(c) for c in "xyz"))


#: Taps are added in one order, so that both engines round alike.
_TAPS = """select img, y, x, list_reduce(list(v::double * share order by px, py), lambda s, x: s + x) as v from
(select *, (1 - abs(u - px)) * (1 - abs(t - py)) as share from (select img, y, x, u, t, (floor(u) + a.a)::int as px, (floor(t) + b.b)::int as py from m, range(2) a(a), range(2) b(b))) join img_px using (img, px, py)
where share > 0 group by 1, 2, 3"""


@query("flt_undistort", f"""{_SIZES}, e as (select *, unnest(range(1, h - 1))::int as y from z), f as (select *, unnest(range(2, w - 2))::int as x from e),
g as (select *, (x + 0.5::double) / w - 0.5 as cx, (y + 0.5::double) / h - 0.5 as cy from f),
m as (select img, y, x, round((cx * (1 + 0.0987654321::double * (cx * cx + cy * cy)) + 0.5) * w - 0.5, 9) as u, round((cy * (1 + 0.0987654321::double * (cx * cx + cy * cy)) + 0.5) * h - 0.5, 9) as t from g),
v as ({_TAPS}) select img, (y - 1)::int as y, (x - 2)::int as x, {R('v')} as v from v""")
def _(view):
    return resample.undistorted(view("img_rows"), 0.0987654321, (2, 1, 2, 1), 6)


@query("flt_undistort_fisheye", f"""{_SIZES}, e as (select *, unnest(range(h))::int as y from z), f as (select *, unnest(range(w))::int as x from e),
g as (select *, (x - w / 2.0::double) / w as x1, (y - h / 2.0::double) / h as y1 from f), k as (select *, x1 * x1 + y1 * y1 as q from g),
l as (select *, 1 + q * (0.05::double + q * (-0.01::double + q * (0.002::double + q * -0.0005::double))) as b from k),
m as (select *, round(w * x1 * b + w // 2, 9) as u, round(h * y1 * b + h // 2, 9) as t from l),
s as (select *, u > 0 and t > 0 and u < w - 1 and t < h - 1 as seen from m), o as (select img, min(y) as y0, max(y) as y2, min(x) as x0, max(x) as x2 from s where seen group by img),
v as ({_TAPS}) select img, (y - y0)::int as y, (x - x0)::int as x, {R('v.v')} as v, seen from v join s using (img, y, x) join o using (img) where y between y0 and y2 and x between x0 and x2""")
def _(view):
    return resample.fisheye_undistorted(view("img_rows"), (0.05, -0.01, 0.002, -0.0005), 6)


@query("ag_pose_align", ctes("cloud_a") + f""", c as (select covar_samp(x, x) as a, covar_samp(x, y) as b, covar_samp(x, z) as c, covar_samp(y, y) as d, covar_samp(y, z) as e, covar_samp(z, z) as f from cloud_a),
q as (select *, (a + d + f) / 3 as q from c), p as (select *, sqrt(((a - q) * (a - q) + (d - q) * (d - q) + (f - q) * (f - q) + 2 * (b * b + c * c + e * e)) / 6) as p from q),
r as (select *, acos(greatest(-1, least(1, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)) / (2 * p * p * p)))) / 3 as phi from p)
select {R('q + 2 * p * cos(phi)')} as x, {R('3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3))')} as y, {R('q + 2 * p * cos(phi + 2 * pi() / 3)')} as z from r""")
def _(view):
    return X.aligned(view("cloud_a")).agg(*(r6(F.var_samp(c)).alias(c) for c in "xyz"))
