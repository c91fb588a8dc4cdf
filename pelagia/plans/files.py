"""Queries: scene files written from the views to the shared folder and read back."""

from __future__ import annotations

import io
import json
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pelagia.plans.register import R, query, r6
from pelagia.plans.views import ctes
from pelagia.session import scratch
from pelagia.sources import png, scene_files as S

C, SP, PX, CL = ctes("cams"), ctes("splats"), ctes("sonar_px"), ctes("cloud_a")
f4 = lambda c: f"({c})::float::double"


def _cameras(view) -> DataFrame:
    cams = view("cams")
    path = scratch(cams.sparkSession)
    params = F.array("fx", "fy", "cx", "cy")
    S.write_colmap_cameras(cams.select(F.col("cam").cast("int").alias("camera_id"), F.lit("PINHOLE").alias("model"), F.col("width").cast("long"), F.col("height").cast("long"), params.alias("params")), f"{path}/cameras.bin")
    return S.colmap_cameras(cams.sparkSession, path)


@query("src_colmap_cameras_bin", f"{C} select cam::int as camera_id, 'PINHOLE' as model, width::bigint as width, height::bigint as height, fx, fy, cx, cy from cams")
def _(view):
    return _cameras(view).select("camera_id", "model", "width", "height", *(F.get("params", F.lit(i)).alias(n) for i, n in enumerate(("fx", "fy", "cx", "cy"))))


def _image_rows(view) -> DataFrame:
    """An image for each splat, with three points, some without a 3D point."""
    g = F.col("gid")
    points = F.transform(F.array(*map(F.lit, range(3))), lambda k: F.struct((F.col("x") + k).alias("x"), (F.col("y") - k).alias("y"), F.when((g + k) % 3 == 0, -1).otherwise(g * 10 + k).cast("long").alias("pid")))
    return view("splats").select(g.cast("int").alias("image_id"), F.array("qw", "qx", "qy", "qz").alias("q"), F.array("x", "y", "z").alias("t"), F.lit(1).alias("camera_id"), F.concat(F.lit("img "), g, F.lit(".png")).alias("name"), points.alias("points"))


_IMAGES = f"{SP}, p as (select *, unnest(range(3)) as k from splats), m as (select gid, count(*) filter ((gid + k) % 3 <> 0) as matched, sum(case when (gid + k) % 3 = 0 then -1 else gid * 10 + k end)::bigint as pids from p group by gid) select gid::int as image_id, 'img ' || gid || '.png' as name, qw, qz, x, z, matched, pids from splats join m using (gid)"


def _image_columns(images: DataFrame) -> DataFrame:
    pick = lambda c, i: F.get(c, F.lit(i))
    pids = F.aggregate("points", F.lit(0).cast("long"), lambda s, p: s + p["pid"])
    return images.select("image_id", "name", pick("q", 0).alias("qw"), pick("q", 3).alias("qz"), pick("t", 0).alias("x"), pick("t", 2).alias("z"), F.size(F.filter("points", lambda p: p["pid"] >= 0)).cast("long").alias("matched"), pids.alias("pids"))


def _images(view) -> DataFrame:
    rows = _image_rows(view)
    path = scratch(rows.sparkSession)
    S.write_colmap_images(rows, f"{path}/images.bin")
    return S.colmap_images(rows.sparkSession, path)


@query("src_colmap_images_bin", _IMAGES)
def _(view):
    return _image_columns(_images(view))


@query("src_colmap_text", _IMAGES)
def _(view):
    rows = _image_rows(view)
    path = scratch(rows.sparkSession)
    S.write_colmap_text_images(rows, f"{path}/images.txt")
    return _image_columns(S.colmap_text_images(rows.sparkSession, path))


def _point_rows(view) -> DataFrame:
    p = F.col("pid")
    track = F.transform(F.sequence(F.lit(1), (p % 4 + 1).cast("int")), lambda i: F.struct(i.alias("image_id"), (i * 2).alias("point")))
    return view("cloud_a").select(p.cast("long"), "x", "y", "z", (p % 256).cast("int").alias("r"), (p % 7).cast("int").alias("g"), (p % 11).cast("int").alias("b"), (p % 10 / 8.0).cast("double").alias("error"), track.alias("track"))


def _points(view) -> DataFrame:
    rows = _point_rows(view)
    path = scratch(rows.sparkSession)
    S.write_colmap_points(rows, f"{path}/points3D.bin")
    return S.colmap_points(rows.sparkSession, path)


_POINTS = f"{CL} select pid::bigint as pid, x, y, z, (pid % 256)::int as r, (pid % 7)::int as g, (pid % 11)::int as b, pid % 10 / 8.0::double as error, (pid % 4 + 1)::int as track from cloud_a"


@query("src_colmap_points_bin", _POINTS)
def _(view):
    return _points(view).select("pid", "x", "y", "z", "r", "g", "b", "error", F.size("track").alias("track"))


@query("sink_colmap_bin", _POINTS)
def _(view):
    return _points(view).select("pid", "x", "y", "z", "r", "g", "b", "error", F.size("track").alias("track"))


@query("src_colmap_eda", f"{SP}, p as (select *, unnest(range(3)) as k from splats), {CL[5:]} select 'image' as kind, 'img ' || gid || '.png' as name, count(*) filter ((gid + k) % 3 <> 0)::int as n, null::double as error from p group by gid union all select 'point', pid::varchar, (pid % 4 + 1)::int, pid % 10 / 8.0::double from cloud_a")
def _(view):
    images = S.matched_counts(_images(view)).select(F.lit("image").alias("kind"), "name", F.col("matched").alias("n"), F.lit(None).cast("double").alias("error"))
    points = S.track_summary(_points(view)).select(F.lit("point").alias("kind"), F.col("pid").cast("string").alias("name"), F.col("track").alias("n"), "error")
    return images.unionByName(points)


def _saved_frames(view, content) -> tuple:
    """Files of the sonar frames, written where the frames are: ``content(frame, image)`` gives (name, bytes) pairs of a 64 x 48 grid."""
    px = view("sonar_px")

    def run(cells: pa.Table) -> pa.Table:
        image = np.zeros((64, 48))
        rng, az, v = (cells.column(c).to_numpy() for c in ("rng", "az", "v"))
        image[rng, az] = v
        names, contents = zip(*content(cells.column("frame")[0].as_py(), image), strict=True)
        return pa.table({"name": pa.array(names, pa.string()), "content": pa.array(contents, pa.binary())})

    path = scratch(px.sparkSession)
    S.write_files(px.groupBy("frame").applyInArrow(run, "name string, content binary"), path)
    return px.sparkSession, path


_CELLS = f"{PX} select frame::int as frame, rng, az, {R(f4('v'))} as v from sonar_px where v > 0"


@query("src_colmap_dense", _CELLS)
def _(view):
    spark, path = _saved_frames(view, lambda frame, image: [(f"{frame}.bin", b"48&64&1&" + image.astype("<f4").tobytes())])
    found = S.colmap_dense(spark, path).where("v > 0")
    return found.select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("int").alias("frame"), F.col("row").alias("rng"), F.col("col").alias("az"), r6("v").alias("v"))


@query("src_sonar_pkl", f"{PX} select frame::bigint as frame, rng, az, {R('v')} as v from sonar_px where v > 0")
def _(view):
    spark, path = _saved_frames(view, lambda frame, image: [(f"f{frame:04d}.pkl", pickle.dumps({"ImagingSonar": image, "PoseSensor": np.eye(4)}))])
    return S.sonar_frames(spark, path).where("v > 0").select("frame", "rng", "az", r6("v").alias("v"))


@query("src_tof_mitsuba", f"{PX} select frame::int as frame, rng as row, {R(f4('sum(v)'))} as depth, (frame * 2)::double as tx from sonar_px group by frame, rng")
def _(view):
    def saved(frame: int, image: np.ndarray):
        pose = np.eye(4)
        pose[0, 3] = frame * 2
        for name, array in ((f"poses/{frame}", pose), (f"depths/{frame}", image)):
            out = io.BytesIO()
            np.save(out, array)
            yield f"{name}.npy", out.getvalue()

    spark, path = _saved_frames(view, saved)
    found = S.tof_frames(spark, path)
    total = F.aggregate("depth", F.lit(0.0), lambda s, x: s + x)
    return found.select("frame", "row", r6(total.cast("float").cast("double")).alias("depth"), F.get("pose", F.lit(3)).alias("tx")).where("depth > 0")


@query("src_nerf_transforms", f"{C} select 'r_' || cam as file, 0.7::double as fov, {R('ca')} as a, {R('-0.5')}::double as b, {R('-sa')} as c, {R('tz')} as d from cams")
def _(view):
    cams = view("cams")
    spark, path = cams.sparkSession, scratch(cams.sparkSession)
    frames = [{"file_path": f"r_{r.cam}", "transform_matrix": [[r.ca, 0.5, r.sa, r.tx], [0, 1, 0, r.ty], [-r.sa, 0, r.ca, r.tz], [0, 0, 0, 1]]} for r in cams.collect()]  # a row a camera
    S._saved(spark, f"{path}/transforms_train.json", [json.dumps({"camera_angle_x": 0.7, "frames": frames}).encode()])
    found = S.nerf_cameras(spark, path)
    pick = lambda i: r6(F.get("c2w", F.lit(i))) + 0.0
    return found.select("file", "fov", pick(0).alias("a"), pick(1).alias("b"), pick(2).alias("c"), pick(11).alias("d"))


@query("src_nerf_blend", f"{SP} select gid, {R('r * o + (1 - o)')} as r, {R('g * o + (1 - o)')} as g, {R('b * o')} as b from splats")
def _(view):
    o = F.col("o")
    return view("splats").select("gid", r6(S.blended(F.col("r"), o)).alias("r"), r6(S.blended(F.col("g"), o)).alias("g"), r6(S.blended(F.col("b"), o, 0.0)).alias("b"))


_BY = "row_number() over (order by pid) - 1"


@query("src_ply_points", f"{CL} select {_BY} as pid, {f4('x')} as x, {f4('y')} as y, {f4('z')} as z, (pid % 256)::int as r, (pid % 7)::int as g, (pid % 11)::int as b from cloud_a")
def _(view):
    rows = _point_rows(view)
    path = scratch(rows.sparkSession)
    S.write_ply_points(rows, f"{path}/a.ply")
    return S.ply_points(rows.sparkSession, path).drop("path")


_PLY_SQL = f"{SP} select row_number() over (order by gid) - 1 as gid, {f4('x')} as x, {f4('z')} as z, {f4('ln(sx)')} as s, {f4('qy')} as qy, {R(f4('ln(o / (1 - o))'))} as o, {f4('r')} as r from splats"


def _ply(view) -> DataFrame:
    s = view("splats")
    path = scratch(s.sparkSession)
    o, empty = F.col("o"), F.array().cast("array<double>")
    S.write_ply_splats(s.select("gid", F.array("x", "y", "z").alias("mean"), F.ln(o / (1 - o)).alias("opacity_logit"), F.array("r", "g", "b").alias("dc"), empty.alias("rest"), F.array(F.ln("sx"), F.ln("sy"), F.ln("sz")).alias("log_scale"), F.array("qw", "qx", "qy", "qz").alias("quat")), f"{path}/a.ply")
    pick = lambda c, i: F.get(c, F.lit(i))
    found = S.ply_splats(s.sparkSession, path)
    return found.select("gid", pick("mean", 0).alias("x"), pick("mean", 2).alias("z"), pick("log_scale", 0).alias("s"), pick("quat", 2).alias("qy"), r6("opacity_logit").alias("o"), pick("dc", 0).alias("r"))


for _name in ("src_ply_gaussians", "sink_ply_gaussians"):
    query(_name, _PLY_SQL)(_ply)


@query("src_cameras_npz", f"{C} select cam::int as i, {R('fx')} as fx, {R('cx')} as cx, {R('cy')} as cy, {R('ca')} as ca, {R('sa')} as sa, {R('tz')} as tz from cams")
def _(view):
    cams = view("cams")
    spark, path, out = cams.sparkSession, scratch(cams.sparkSession), io.BytesIO()
    worlds = {}
    for r in cams.collect():  # a row a camera
        k = np.array([[r.fx, 0, r.cx], [0, r.fy, r.cy], [0, 0, 1]])
        turn = np.array([[r.ca, 0, r.sa], [0, 1, 0], [-r.sa, 0, r.ca]])
        worlds[f"world_mat_{r.cam}"] = np.vstack((k @ np.column_stack((turn, [r.tx, r.ty, r.tz])), [0, 0, 0, 1]))
    np.savez(out, **worlds)
    S._saved(spark, f"{path}/cameras.npz", [out.getvalue()])
    pick = lambda c, i: r6(F.get(c, F.lit(i))) + 0.0
    return S.npz_cameras(spark, path).select("i", pick("k", 0).alias("fx"), pick("k", 2).alias("cx"), pick("k", 5).alias("cy"), pick("r", 0).alias("ca"), pick("r", 2).alias("sa"), pick("t", 2).alias("tz"))


@query("src_dataverse_meta", "select n_nationkey::bigint as id, n_name as filename, (n_regionkey * 100)::bigint as size, 'image/png' as content_type, case when n_regionkey = 0 then '' else 'r' || n_regionkey end as subdir from nation")
def _(view):
    nations = view("nation")
    spark, path = nations.sparkSession, scratch(nations.sparkSession)
    files = [{**({"directoryLabel": f"r{r.n_regionkey}"} if r.n_regionkey else {}), "dataFile": {"id": r.n_nationkey, "filename": r.n_name, "filesize": r.n_regionkey * 100, "contentType": "image/png"}} for r in nations.collect()]  # 25 rows
    S._saved(spark, f"{path}/dataverse.json", [json.dumps({"data": {"latestVersion": {"files": files}}}).encode()])
    return S.dataverse_files(spark, path)


@query("src_archive", "select 'd/a' || p_size || '_' || (p_partkey // 1000) || '.7z' as archive, count(*) as parts, sum(p_partkey)::bigint as size, 'd/a' || p_size || '_' || (p_partkey // 1000) || '.7z.' || lpad((min(p_partkey) % 1000)::varchar, 3, '0') as first from part group by p_size, p_partkey // 1000")
def _(view):
    part = F.col("p_partkey")
    name = F.concat(F.lit("d/a"), "p_size", F.lit("_"), F.floor(part / 1000).cast("string"), F.lit(".7z."), F.lpad((part % 1000).cast("string"), 3, "0"))
    parts = S.archive_parts(view("part").select(name.alias("path"), part.cast("long").alias("length")))
    return parts.select("archive", F.size("parts").cast("long").alias("parts"), "size", F.get("parts", F.lit(0)).alias("first"))


def _tree(view, headers: bool = False) -> tuple:
    """A file for each nation, in r<region>/images or r<region>/deep/er; one directory is named cache. Every fifth is no whole image: no
    PNG, a cut one, or one with a changed byte. With ``headers`` each is a PNG's first 33 bytes, every fifth no PNG of 8 bytes, so that
    sizes do not hang on a compressor."""
    nations = view("nation")
    spark, path = nations.sparkSession, scratch(nations.sparkSession) + "/walk"
    for r in nations.collect():  # 25 rows
        k = r.n_nationkey
        folder = f"r{r.n_regionkey}/" + ("images" if k % 3 else "deep/er" if k % 2 else "cache")
        y, x = np.mgrid[0 : 20 + k, 0 : 30 + k]
        good = png.encode(((x * 3 + y * 5 + k) % 256).astype(np.uint8)[..., None], [0, 1, 2, 3, 4])
        if k % 5 == 0:
            good = (b"no image", good[: len(good) // 2], good[:60] + bytes([good[60] ^ 1]) + good[61:])[k // 5 % 3]
        if headers:
            good = b"no image" if k % 5 == 0 else good[:33]
        S._saved(spark, f"{path}/{folder}/n{k}.png", [good])
        S._saved(spark, f"{path}/{folder}/n{k}.txt", [b"text"])
    return spark, path


_TREE = "with t as (select n_nationkey as k, 'r' || n_regionkey as top, case when n_nationkey % 3 <> 0 then 'images' when n_nationkey % 2 <> 0 then 'deep/er' else 'cache' end as low from nation), f as (select k, top, low, top || '/' || low || '/n' || k || '.png' as relative from t)"


@query("src_image_walk", f"{_TREE} select row_number() over (order by relative) - 1 as i, relative, (case when k % 5 = 0 then 8 else 33 end)::bigint as length from f")
def _(view):
    return S.image_walk(*_tree(view, headers=True)).select("i", "relative", "length")


@query("src_scene_discovery", f"{_TREE} select case when low = 'images' then top else top || '/' || low end as scene, count(*) as n from f where low <> 'cache' and low <> 'deep/er' group by 1")
def _(view):
    return S.scenes(S.image_walk(*_tree(view)), 2, ("cache", "deep"))


@query("src_safe_image", f"{_TREE}, p as (select top, k, k % 5 = 0 as bad, y, x from f, range(44) a(y), range(54) b(x) where y < 20 + k and x < 30 + k) select top as scene, count(distinct k) as n, count(distinct k) filter (bad) as failed, sum(30 + k) filter (not bad and y = 0 and x = 0)::bigint as width, sum((x * 3 + y * 5 + k) % 256) filter (not bad)::bigint as light from p group by top")
def _(view):
    found = S.safe_images(*_tree(view)).withColumn("scene", F.regexp_extract("path", r"/walk/(\w+)/", 1))
    light = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x)
    return found.groupBy("scene").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("width").alias("width"), F.sum(light).alias("light"))
