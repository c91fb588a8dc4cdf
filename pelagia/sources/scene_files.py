"""Readers and writers of scene files: COLMAP models (binary and text), PLY, sonar frames, JSON and NPZ cameras.

Files that hold a whole scene (points, images, PLY vertices) are read and written in ranges of records by many tasks
(``record_files``). Small files (cameras, frames, dense maps) are found and read by Spark's own file sources (``binaryFile``, ``text``,
``json``) and parsed on executors, one file a row, many files in parallel. Pickles are read with an unpickler that knows numpy
arrays and plain containers only.
"""

from __future__ import annotations

import io
import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pelagia.sources import png, record_files
from pelagia.sources.record_files import CAMERA_MODELS, IMAGES, POINTS, SPLATS, write_files  # noqa: F401

BATCH = 50_000

def _parsed(spark: SparkSession, path: str, parse, schema: str, pattern: str = "*") -> DataFrame:
    """Rows that ``parse(content)`` yields as dicts, with the file's path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    wanted = spark.createDataFrame([], f"path string, {schema}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(wanted)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for row in parse(content.as_py()):
                    rows.append({"path": name, **row})
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.mapInArrow(run, wanted)


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out


def _cameras(data: bytes) -> Iterator[dict]:
    c = _Cursor(data)
    for _ in range(c.take("Q")[0]):
        camera, model, width, height = c.take("iiQQ")
        name, n = CAMERA_MODELS[model]
        yield {"camera_id": camera, "model": name, "width": width, "height": height, "params": list(c.take(f"{n}d"))}


CAMERAS = "camera_id int, model string, width long, height long, params array<double>"


def colmap_cameras(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, _cameras, CAMERAS, "cameras.bin")


def colmap_images(spark: SparkSession, path: str) -> DataFrame:
    return record_files.variable_records(spark, "images", path, "images.bin")


def colmap_points(spark: SparkSession, path: str) -> DataFrame:
    return record_files.variable_records(spark, "points3D", path, "points3D.bin")


def matched_counts(images: DataFrame) -> DataFrame:
    """name, matched: points of each image that have a 3D point."""
    return images.select("name", F.size(F.filter("points", lambda p: p["pid"] >= 0)).alias("matched"))


def colmap_text_cameras(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    return lines.select(F.get(f, F.lit(0)).cast("int").alias("camera_id"), F.get(f, F.lit(1)).alias("model"), F.get(f, F.lit(2)).cast("long").alias("width"), F.get(f, F.lit(3)).cast("long").alias("height"), F.slice(f, 5, 100).cast("array<double>").alias("params"))


def colmap_text_points(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    names = (("pid", "long"), ("x", "double"), ("y", "double"), ("z", "double"), ("r", "int"), ("g", "int"), ("b", "int"), ("error", "double"))
    return lines.select(*(F.get(f, F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(names)), (F.size(f) - 8).alias("track_fields"))


def colmap_text_images(spark: SparkSession, path: str) -> DataFrame:
    """Two lines for each image: its pose, and its points as x y id triples (the line may be empty)."""
    return record_files.text_images(spark, path)


def track_summary(points: DataFrame) -> DataFrame:
    """pid, track (images that see the point), error."""
    return points.select("pid", F.size("track").alias("track"), "error")


def _dense(data: bytes) -> Iterator[dict]:
    """``width&height&channels&`` and 32-bit floats, the first axis (across) running fastest."""
    head, at = [], 0
    while len(head) < 3:
        end = data.index(b"&", at)
        head.append(int(data[at:end]))
        at = end + 1
    across, down, channels = head
    values = np.frombuffer(data, "<f4", across * down * channels, at).reshape(channels, down, across)
    for row in range(down):
        yield {"row": row, "v": values[:, row, :].T.astype(float).tolist()}


def colmap_dense(spark: SparkSession, path: str, pattern: str = "*.bin") -> DataFrame:
    """path, row, col, channel, v of dense maps (depths, normals)."""
    lines = _parsed(spark, path, _dense, "row int, v array<array<double>>", pattern)
    return lines.select("path", "row", F.posexplode("v").alias("col", "c")).select("path", "row", "col", F.posexplode("c").alias("channel", "v"))


def _npy(data: bytes) -> Iterator[dict]:
    found = np.load(io.BytesIO(data), allow_pickle=False)
    flat = found.reshape(len(found), -1) if found.ndim > 1 else found.reshape(-1, 1)
    for row, line in enumerate(flat):
        yield {"row": row, "v": line.astype(float).tolist()}


def npy_rows(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """path, row, v of arrays in ``*.npy``: a time-of-flight scene's poses (4 x 4, by rows) and depth maps."""
    return _parsed(spark, path, _npy, "row int, v array<double>", pattern)


def tof_frames(spark: SparkSession, path: str) -> DataFrame:
    """frame, pose (16 numbers), row, depth (a line of the map) of a scene whose poses and depths are ``poses/N.npy`` and
    ``depths/N.npy``; a frame without a pose is left out."""
    name = lambda kind: F.regexp_extract("path", rf"{kind}/(\d+)\.npy$", 1)
    rows = npy_rows(spark, path)
    poses = rows.where(name("poses") != "").groupBy(name("poses").cast("int").alias("frame")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row", "v"))), lambda x: x["v"])).alias("pose"))
    return rows.where(name("depths") != "").select(name("depths").cast("int").alias("frame"), "row", F.col("v").alias("depth")).join(poses, "frame")


def blended(colour, alpha, background=1.0):
    """A colour of some opacity over a background."""
    return colour * alpha + background * (1 - alpha)


IMAGE_NAMES = r"(?i)\.(png|jpe?g|bmp|tiff?|pgm)$"


def image_walk(spark: SparkSession, path: str) -> DataFrame:
    """i, path, relative, length of the images under ``path``, numbered in order of their paths; no content is read."""
    from pelagia.operators.pixels import indexed

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where(F.col("path").rlike(IMAGE_NAMES))
    root = "/" + path.rstrip("/").rpartition("/")[2] + "/"
    return indexed(files.select(F.substring_index("path", root, -1).alias("relative"), "path", "length"), "relative")


def scenes(files: DataFrame, depth: int, skip: tuple[str, ...] = ()) -> DataFrame:
    """scene, n: directories of at most ``depth`` levels that hold images (relative), directly or in a directory named images;
    paths through a directory named in ``skip`` are left out."""
    folders = F.slice(F.split("relative", "/"), 1, F.size(F.split("relative", "/")) - 1)
    df = files.select(folders.alias("f")).where(~F.arrays_overlap("f", F.array(*map(F.lit, skip))) if skip else F.lit(True))
    own = F.when(F.element_at("f", -1) == "images", F.slice("f", 1, F.size("f") - 1)).otherwise(F.col("f"))
    return df.where(F.size("f") > 0).select(own.alias("f")).where(F.size("f").between(1, depth)).groupBy(F.array_join("f", "/").alias("scene")).agg(F.count("*").alias("n"))


def _png(data: bytes) -> Iterator[dict]:
    try:
        image = png.gray(png.decode(data))
    except png.BrokenImage as e:
        yield {"width": None, "height": None, "v": None, "error": str(e)}
    else:
        yield {"width": image.shape[1], "height": image.shape[0], "v": image.ravel().tolist(), "error": None}


def safe_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, v (gray levels by lines), error of ``*.png``: decoded on executors; a file that is cut, broken or no image has
    nulls and says why, so failures can be counted. Spark lists no files of no bytes."""
    return _parsed(spark, path, _png, "width int, height int, v array<int>, error string", "*.png")


def ply_points(spark: SparkSession, path: str) -> DataFrame:
    return record_files.ply_records(spark, "ply_points", path)


def ply_splats(spark: SparkSession, path: str) -> DataFrame:
    return record_files.ply_records(spark, "ply_splats", path)


class _Plain(pickle.Unpickler):
    """Knows numpy arrays and scalars; any other global is an error."""

    KNOWN = {("numpy", "ndarray"), ("numpy", "dtype")} | {(m, f) for m in ("numpy.core.multiarray", "numpy._core.multiarray") for f in ("_reconstruct", "scalar")} | {("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer")}

    def find_class(self, module, name):
        if (module, name) not in self.KNOWN:
            raise pickle.UnpicklingError(f"{module}.{name} is not read from frames")
        return super().find_class(module, name)


def _frame(data: bytes) -> Iterator[dict]:
    found = _Plain(io.BytesIO(data)).load()
    image = np.asarray(found["ImagingSonar"])
    image = image / 255.0 if image.dtype == np.uint8 else image.astype(float)
    pose = np.asarray(found["PoseSensor"], float).ravel().tolist()
    for rng, line in enumerate(image):
        yield {"rng": rng, "v": line.tolist(), "pose": pose}


def sonar_frames(spark: SparkSession, path: str) -> DataFrame:
    """frame (all digits of the file's name), rng, az, v, pose of every pixel of ``*.pkl`` frames."""
    lines = _parsed(spark, path, _frame, "rng int, v array<double>, pose array<double>", "*.pkl")
    frame = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\D", "").cast("long")
    return lines.select(frame.alias("frame"), "rng", "pose", F.posexplode("v").alias("az", "v"))


def nerf_cameras(spark: SparkSession, path: str) -> DataFrame:
    """file, fov, c2w (16 numbers, y and z axes flipped) of the frames of ``transforms_*.json``."""
    schema = "camera_angle_x double, frames array<struct<file_path:string,transform_matrix:array<array<double>>>>"
    frames = spark.read.schema(schema).option("multiLine", True).json(path).select("camera_angle_x", F.explode("frames").alias("f"))
    flipped = F.flatten(F.transform(F.col("f.transform_matrix"), lambda r: F.array(r[0], -r[1], -r[2], r[3])))
    return frames.select(F.col("f.file_path").alias("file"), F.col("camera_angle_x").alias("fov"), flipped.alias("c2w"))


def _npz(data: bytes) -> Iterator[dict]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        for name in sorted((n for n in z.files if n.startswith("world_mat_") and n[10:].isdigit()), key=lambda n: int(n[10:])):
            i = int(name[10:])
            p = z[name][:3, :4]
            q, r = np.linalg.qr(np.linalg.inv(p[:, :3]))
            k, rot = np.linalg.inv(r), q.T
            sign = np.diag(np.sign(np.diag(k)))
            k, rot = k @ sign, sign @ rot
            t = np.linalg.solve(k, p[:, 3])
            k = k / k[2, 2]
            yield {"i": i, "k": k.ravel().tolist(), "r": rot.ravel().tolist(), "t": t.ravel().tolist()}


def npz_cameras(spark: SparkSession, path: str) -> DataFrame:
    """i, k, r, t of the world matrices of ``*.npz``, by an RQ factorisation."""
    return _parsed(spark, path, _npz, "i int, k array<double>, r array<double>, t array<double>", "*.npz")


def archive_parts(files: DataFrame) -> DataFrame:
    """archive, parts, size: split archives (``x.7z.001`` ...) regrouped by name."""
    name = F.regexp_replace("path", r"(\.(?:7z|zip|tar))\.\d{3}$", "$1")
    return files.groupBy(name.alias("archive")).agg(F.sort_array(F.collect_list("path")).alias("parts"), F.sum("length").alias("size"))


def dataverse_files(spark: SparkSession, path: str) -> DataFrame:
    """id, filename, size, content_type, subdir of a saved dataset description."""
    schema = "data struct<latestVersion:struct<files:array<struct<directoryLabel:string,dataFile:struct<id:long,filename:string,filesize:long,contentType:string>>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("data.latestVersion.files").alias("f"))
    return f.select(F.col("f.dataFile.id").alias("id"), F.col("f.dataFile.filename").alias("filename"), F.col("f.dataFile.filesize").alias("size"), F.col("f.dataFile.contentType").alias("content_type"), F.coalesce("f.directoryLabel", F.lit("")).alias("subdir"))


def _saved(spark: SparkSession, path: str, chunks) -> None:
    """Write byte chunks to one file of any store that Hadoop reaches."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        for chunk in chunks:
            out.write(bytearray(chunk))
    finally:
        out.close()


def _counted(n: int) -> bytes:
    return struct.pack("<Q", n)


def _ply_head(fields: list[tuple[str, str]]):
    return lambda n: ("ply\nformat binary_little_endian 1.0\n" + f"element vertex {n}\n" + "".join(f"property {kind} {name}\n" for kind, name in fields) + "end_header\n").encode()


def write_colmap_cameras(cameras: DataFrame, path: str) -> None:
    """cameras.bin in order of camera_id."""
    record_files.write_records(cameras, "cameras", path, "camera_id", _counted)


def write_colmap_images(images: DataFrame, path: str) -> None:
    """images.bin in order of image_id."""
    record_files.write_records(images, "images", path, "image_id", _counted)


def write_colmap_text_images(images: DataFrame, path: str) -> None:
    """images.txt in order of image_id: two lines an image."""
    number = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    points = F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["pid"].cast("string"))), " ")
    lines = images.select("image_id", F.concat_ws(" ", "image_id", number("q"), number("t"), "camera_id", "name").alias("head"), points.alias("body"))
    record_files.write_records(lines, "images_text", path, "image_id", lambda n: b"")


def write_colmap_points(points: DataFrame, path: str) -> None:
    """points3D.bin in order of pid."""
    record_files.write_records(points, "points3D", path, "pid", _counted)


def write_ply_points(points: DataFrame, path: str) -> None:
    """A little-endian PLY of x, y, z (f4) and red, green, blue in order of pid."""
    fields = [*(("float", n) for n in "xyz"), *(("uchar", n) for n in ("red", "green", "blue"))]
    record_files.write_records(points, "ply_points", path, "pid", _ply_head(fields))


def write_ply_splats(splats: DataFrame, path: str) -> None:
    """A little-endian PLY of the splats in order of gid, all f4; rows with a value that is not finite are left out."""
    fine = F.forall(F.concat("mean", "dc", "rest", "log_scale", "quat", F.array("opacity_logit")), lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    kept = splats.where(fine)
    one = kept.select(F.size("dc"), F.size("rest"), F.size("log_scale"), F.size("quat")).first() or (3, 0, 3, 4)
    names = ["x", "y", "z", "nx", "ny", "nz", *(f"f_dc_{i}" for i in range(one[0])), *(f"f_rest_{i}" for i in range(one[1])), "opacity", *(f"scale_{i}" for i in range(one[2])), *(f"rot_{i}" for i in range(one[3]))]
    record_files.write_records(kept, "ply_splats", path, "gid", _ply_head([("float", n) for n in names]))


def camera_list(cameras: DataFrame) -> DataFrame:
    """One JSON line for each camera: id, img_name, width, height, position, rotation, fx, fy."""
    return cameras.select(F.to_json(F.struct("id", "img_name", "width", "height", "position", "rotation", "fx", "fy")).alias("value"))

