"""Scene files of any size as a Spark data source: records in byte ranges, read and written by many tasks.

``scene_records`` reads splits of files. A split is a range of whole records, so no task reads more than about ``CHUNK`` bytes and
no row passes the driver. Files of fixed records (PLY vertices) are cut by arithmetic. Where a record's size stands in the record
(points, images of a COLMAP model), a record's start is not known inside the file: every chunk guesses the first start in it (the first
place from which ``CHAIN`` records in a row look sane) and follows the sizes to the first start behind it. The guess is then proved:
each chunk must start where the one before ended, from the first on. Chunks that guessed wrong are followed again from where the
proof says, so the splits are exact whatever the guesses. The driver holds a row for each chunk. Chunks of text start at a line;
pairs of lines are kept together by the counts of the lines before.

Writing goes the other way: tasks write their rows, in order of a key, as part files; their sizes give each part's place in the
one file, and tasks copy the parts there. The file must be on a mounted file system, which allows writing at a place; reading works
on any store that pyarrow reaches as well.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CHUNK = 8 << 20
CHAIN = 8
ROWS = 20_000


def local(path: str) -> str | None:
    """The path on a mounted file system, or None for another store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def opened(path: str):
    """A file for random reads."""
    at = local(path)
    if at:
        return open(at, "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def read_at(path: str, start: int, stop: int) -> bytes:
    with opened(path) as f:
        f.seek(start)
        return f.read(max(0, stop - start))


def spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges first[i] .. first[i] + counts[i] - 1."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


# --- layouts: how a record is followed, checked, decoded and encoded


@dataclass(frozen=True)
class Layout:
    """A kind of record file: ``schema`` of its rows; ``begin`` bytes before the first record; ``step(data, at)`` gives the next
    record's place, or -1 if ``data`` ends inside what tells it; ``sane(data, at)`` a cheap check of a record; ``decode(data, places,
    first)`` rows of the records at ``places`` (one more than records), the first having number ``first``."""

    schema: str
    begin: int
    step: Callable[[bytes, int], int]
    sane: Callable[[bytes, int], bool]
    decode: Callable[[bytes, list[int], int], list[pa.Array]]


POINT = np.dtype([("pid", "<u8"), ("p", "<f8", 3), ("c", "u1", 3), ("error", "<f8"), ("n", "<u8")])


def _point_step(data: bytes, at: int) -> int:
    return at + 51 + 8 * struct.unpack_from("<Q", data, at + 43)[0] if at + 51 <= len(data) else -1


def _point_sane(data: bytes, at: int) -> bool:
    pid, x, y, z, _, _, _, error, n = struct.unpack_from("<QdddBBBdQ", data, at)
    return pid < 1 << 48 and n < 1 << 24 and max(abs(x), abs(y), abs(z)) < 1e12 and -1 <= error < 1e9 and all(v == 0 or abs(v) > 1e-12 for v in (x, y, z, error))


def _point_rows(data: bytes, places: list[int], first: int) -> list[pa.Array]:
    raw, at = np.frombuffer(data, np.uint8), np.array(places, np.int64)
    heads = raw[spans(at[:-1], np.full(len(at) - 1, 51))].view(POINT)
    n = heads["n"].astype(np.int64)
    track = raw[spans(at[:-1] + 51, 8 * n)].view("<i4").reshape(-1, 2)
    pairs = pa.StructArray.from_arrays([pa.array(track[:, 0]), pa.array(track[:, 1])], ["image_id", "point"])
    return [pa.array(heads["pid"].astype(np.int64)), *(pa.array(heads["p"][:, i]) for i in range(3)), *(pa.array(heads["c"][:, i].astype(np.int32)) for i in range(3)), pa.array(heads["error"]), lists(np.append(0, np.cumsum(n)), pairs)]


def _image_name_end(data: bytes, at: int) -> int:
    return data.find(b"\0", at + 64)


def _image_step(data: bytes, at: int) -> int:
    end = _image_name_end(data, at)
    return end + 9 + 24 * struct.unpack_from("<Q", data, end + 1)[0] if end >= 0 and end + 9 <= len(data) else -1


def _image_sane(data: bytes, at: int) -> bool:
    head, end = struct.unpack_from("<idddddddi", data, at), _image_name_end(data, at)
    if end < 0 or end - at > 4200 or end + 9 > len(data):
        return False
    name, n = data[at + 64 : end], struct.unpack_from("<Q", data, end + 1)[0]
    return head[0] >= 0 and head[8] >= 0 and abs(sum(q * q for q in head[1:5]) - 1) < 1e-3 and max(map(abs, head[5:8])) < 1e12 and len(name) > 0 and min(name) >= 32 and n < 1 << 32


def _image_rows(data: bytes, places: list[int], first: int) -> list[pa.Array]:
    heads, names, counts, bodies = [], [], [], []
    for at in places[:-1]:
        end = _image_name_end(data, at)
        heads.append(struct.unpack_from("<idddddddi", data, at))
        names.append(data[at + 64 : end].decode())
        counts.append(struct.unpack_from("<Q", data, end + 1)[0])
        bodies.append(end + 9)
    n = np.array(counts, np.int64)
    body = np.frombuffer(data, np.uint8)[spans(np.array(bodies, np.int64), 24 * n)].view(np.dtype([("x", "<f8"), ("y", "<f8"), ("pid", "<i8")]))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(body[c])) for c in ("x", "y", "pid")], ["x", "y", "pid"])
    ids = [h[0] for h in heads]
    fixed = lambda lo, hi: lists(np.arange(len(heads) + 1) * (hi - lo), pa.array([v for h in heads for v in h[lo:hi]], pa.float64()))
    return [pa.array(ids, pa.int32()), fixed(1, 5), fixed(5, 8), pa.array([h[8] for h in heads], pa.int32()), pa.array(names, pa.string()), lists(np.append(0, np.cumsum(n)), points)]


POINTS = "pid long, x double, y double, z double, r int, g int, b int, error double, track array<struct<image_id:int,point:int>>"
IMAGES = "image_id int, q array<double>, t array<double>, camera_id int, name string, points array<struct<x:double,y:double,pid:long>>"
PLY_POINTS = "pid long, x double, y double, z double, r int, g int, b int"
SPLATS = "gid long, mean array<double>, opacity_logit double, dc array<double>, rest array<double>, log_scale array<double>, quat array<double>"
VARIABLE = {
    "points3D": Layout(POINTS, 8, _point_step, _point_sane, _point_rows),
    "images": Layout(IMAGES, 8, _image_step, _image_sane, _image_rows),
}


def _text_rows(lines: list[str]) -> list[pa.Array]:
    """Rows of pairs of lines: a pose, and its points as x y id triples."""
    heads = [x.split() for x in lines[::2]]
    bodies = [x.split() for x in lines[1::2]]
    bodies += [[]] * (len(heads) - len(bodies))
    n = np.array([len(b) // 3 for b in bodies], np.int64)
    flat = [v for b in bodies for v in b]
    points = pa.StructArray.from_arrays([pa.array(np.array(flat[k::3], float)) for k in (0, 1)] + [pa.array(np.array(flat[2::3], np.int64))], ["x", "y", "pid"])
    fixed = lambda lo, hi: lists(np.arange(len(heads) + 1) * (hi - lo), pa.array([float(v) for h in heads for v in h[lo:hi]], pa.float64()))
    return [pa.array([int(h[0]) for h in heads], pa.int32()), fixed(1, 5), fixed(5, 8), pa.array([int(h[8]) for h in heads], pa.int32()), pa.array([" ".join(h[9:]) for h in heads], pa.string()), lists(np.append(0, np.cumsum(n)), points)]


#: Names of PLY's number types.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


@dataclass(frozen=True)
class PlyHead:
    begin: int
    rows: int
    fields: tuple
    binary: bool

    @property
    def kind(self) -> np.dtype:
        return np.dtype(list(self.fields))


def ply_head(data: bytes) -> PlyHead:
    """The vertex element of a PLY file, from its first bytes; elements before it must be empty."""
    end = data.find(b"end_header\n")
    if not data.startswith(b"ply\n") or end < 0:
        raise ValueError("this is no PLY file with a header of 64 KiB at most")
    n, fields, inside, binary = 0, [], False, False
    for x in (line.split() for line in data[:end].decode("ascii", "replace").splitlines()):
        if x[:1] == ["format"]:
            if x[1] == "binary_big_endian":
                raise ValueError("big-endian PLY is not read")
            binary = x[1] == "binary_little_endian"
        elif x[:1] == ["element"]:
            if x[1] != "vertex" and not fields and int(x[2]):
                raise ValueError(f"element {x[1]} stands before the vertices")
            inside = x[1] == "vertex"
            n = int(x[2]) if inside else n
        elif x[:1] == ["property"] and inside:
            if x[1] == "list":
                raise ValueError("a vertex with a list has no fixed size")
            fields.append((x[2], "<" + PLY_TYPES[x[1]]))
    return PlyHead(end + len(b"end_header\n"), n, tuple(fields), binary)


def _suffixed(names, prefix: str) -> list[str]:
    return sorted((x for x in names if x.startswith(prefix)), key=lambda x: int(x.rpartition("_")[2]))


def ply_rows(v: np.ndarray, kind: str, first: int) -> list[pa.Array]:
    names, n = v.dtype.names, len(v)
    ids = pa.array(np.arange(first, first + n))
    if kind == "ply_points":
        colour = [pa.array(v[c].astype(np.int32)) if c in names else pa.nulls(n, pa.int32()) for c in ("red", "green", "blue")]
        return [ids, *(pa.array(v[c].astype(float)) for c in "xyz"), *colour]

    def group(fields: list[str]) -> pa.ListArray:
        values = np.stack([v[c].astype(float) for c in fields], axis=1).ravel() if fields else np.zeros(0)
        return lists(np.arange(n + 1) * len(fields), pa.array(values))

    return [ids, group(list("xyz")), pa.array(v["opacity"].astype(float)), *(group(_suffixed(names, p)) for p in ("f_dc_", "f_rest_", "scale_", "rot_"))]


SCHEMAS = {"points3D": POINTS, "images": IMAGES, "images_text": IMAGES, "ply_points": PLY_POINTS, "ply_splats": SPLATS}


# --- reading


@dataclass
class Split(InputPartition):
    path: str
    start: int
    stop: int
    first: int
    extra: str = ""


class SceneRecords(DataSource):
    """``spark.read.format("scene_records")`` with options kind and splits (JSON rows path, start, stop, first, extra)."""

    @classmethod
    def name(cls) -> str:
        return "scene_records"

    def schema(self) -> str:
        return "path string, " + SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["kind"], json.loads(self.options["splits"]), schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Parts(self.options["kind"], self.options["into"], json.loads(self.options.get("names", "[]")))


class _Reader(DataSourceReader):
    def __init__(self, kind: str, splits: list, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.kind, self.splits, self.arrow = kind, splits, to_arrow_schema(schema)

    def partitions(self) -> list[Split]:
        return [Split(*s) for s in self.splits] or [Split("", 0, 0, 0)]

    def _batch(self, path: str, columns: list[pa.Array]) -> pa.RecordBatch:
        arrays = [pa.array([path] * len(columns[0]), pa.string()), *columns]
        return pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, self.arrow, strict=True)], schema=self.arrow)

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.start >= split.stop:
            return
        data = read_at(split.path, split.start, split.stop)
        if self.kind in VARIABLE:
            layout, places, at = VARIABLE[self.kind], [0], 0
            first = split.first
            while at < len(data):
                at = layout.step(data, at)
                if at < 0 or at > len(data):
                    raise ValueError(f"{split.path} ends inside a record")
                places.append(at)
                if len(places) > ROWS or at == len(data):
                    yield self._batch(split.path, layout.decode(data, places, first))
                    first += len(places) - 1
                    places = [at]
        elif self.kind == "images_text":
            lines = _text_lines(data)
            for k in range(0, len(lines), 2 * ROWS):
                yield self._batch(split.path, _text_rows(lines[k : k + 2 * ROWS]))
        else:
            v = np.frombuffer(data, np.dtype([tuple(f) for f in json.loads(split.extra)]))
            for k in range(0, len(v), ROWS):
                yield self._batch(split.path, ply_rows(v[k : k + ROWS], self.kind, split.first + k))


def _text_lines(data: bytes) -> list[str]:
    return [x.strip() for x in data.decode().split("\n")[: data.count(b"\n") + (not data.endswith(b"\n"))] if not x.startswith("#")]


def files_of(spark: SparkSession, path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under ``path``; one row a file, no content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")
    return sorted((r.path, r.length) for r in found.collect())


def _loaded(spark: SparkSession, kind: str, splits: list) -> DataFrame:
    spark.dataSource.register(SceneRecords)
    return spark.read.format("scene_records").option("kind", kind).option("splits", json.dumps(splits)).load()


def follow(kind: str, path: str, start: int, stop: int, size: int, entry: int | None) -> tuple[int, int, int]:
    """(entry, records, exit) of a chunk [start, stop): the first record's place in it, as given or guessed; how many records start in
    the chunk; and the first record's place at or behind ``stop``. Without a record the entry is the exit, ``stop``."""
    layout, ahead = VARIABLE[kind], 1 << 16
    base = start if entry is None else entry
    data = read_at(path, base, min(size, stop + ahead))

    def step(at: int) -> int:
        """The next record's place; reads on where the data ends too early."""
        nonlocal data, ahead
        while (then := layout.step(data, at)) < 0:
            if base + len(data) >= size:
                return -1
            ahead *= 4
            data += read_at(path, base + len(data), min(size, base + len(data) + ahead))
        return then

    def sane(at: int) -> bool:
        for _ in range(CHAIN):
            if base + at == size:
                return True
            if at + 80 > len(data):
                return at > 0  # as far as the data goes
            if not layout.sane(data, at) or (at := step(at)) < 0 or base + at > size:
                return False
        return True

    if entry is None:
        entry = next((base + k for k in range(stop - start) if k + 80 <= len(data) and sane(k)), stop)
        if entry == stop:
            return stop, 0, stop
    at, n = entry - base, 0
    while base + at < stop:
        at = step(at)
        if at < 0 or base + at > size:  # a wrong guess, or a cut file: the proof or the reader tells
            return entry, n, size
        n += 1
    return entry, n, base + at


def index(spark: SparkSession, kind: str, files: list[tuple[str, int]], chunk: int = CHUNK) -> list:
    """Splits of files of variable records: chunks are followed in parallel from guessed places, and again where those fail the proof."""
    begin = VARIABLE[kind].begin
    rows = [(f, k, max(begin, k * chunk), min(size, (k + 1) * chunk), size, begin if k == 0 else None) for f, size in files if size > begin for k in range(-(-size // chunk))]
    found: dict[tuple[str, int], tuple] = {}
    todo = rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["path"], r["k"], *follow(kind, r["path"], r["start"], r["stop"], r["size"], r["entry"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["path", "k", "entry", "n", "stop"])

    while todo:
        asked = spark.createDataFrame(todo, "path string, k int, start long, stop long, size long, entry long").repartition(min(len(todo), 10_000))
        found |= {(r.path, r.k): (r.entry, r.n, r.stop) for r in asked.mapInArrow(run, "path string, k int, entry long, n long, stop long").collect()}
        todo, at = [], {}
        for path, k, start, stop, size, _ in rows:
            want = at.get(path, begin)
            entry, n, then = found[path, k]
            if want >= stop:  # the record before reaches over the chunk
                found[path, k] = (want, 0, want)
            elif entry != want:
                todo.append((path, k, start, stop, size, want))
            at[path] = max(want, found[path, k][2])
    splits, first = [], {}
    for path, k, *_ in rows:
        entry, n, then = found[path, k]
        if n:
            splits.append([path, entry, then, first.get(path, 0), ""])
            first[path] = first.get(path, 0) + n
    for path, size in files:
        (told,) = struct.unpack("<Q", read_at(path, 0, 8))
        if told != first.get(path, 0):
            raise ValueError(f"{path} has {first.get(path, 0)} records and tells of {told}")
    return splits


def variable_records(spark: SparkSession, kind: str, path: str, pattern: str, chunk: int = CHUNK) -> DataFrame:
    return _loaded(spark, kind, index(spark, kind, files_of(spark, path, pattern), chunk))


def ply_records(spark: SparkSession, kind: str, path: str, chunk: int = CHUNK) -> DataFrame:
    """Vertices of ``*.ply`` in ranges of whole records; an ASCII file is one task's work."""
    splits, plain = [], []
    for name, _ in files_of(spark, path, "*.ply"):
        head = ply_head(read_at(name, 0, 1 << 16))
        if not head.binary:
            plain.append(name)
            continue
        size, step = head.kind.itemsize, max(1, chunk // head.kind.itemsize)
        splits += [[name, head.begin + k * size, head.begin + min(head.rows, k + step) * size, k, json.dumps(head.fields)] for k in range(0, head.rows, step)]
    found = _loaded(spark, kind, splits)
    if not plain:
        return found
    named = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with opened(name) as f:
                    data = f.read()
                head = ply_head(data[: 1 << 16])
                rows = [tuple(map(float, line.split())) for line in data[head.begin :].decode().splitlines()[: head.rows]]
                columns = ply_rows(np.array(rows, head.kind), kind, 0)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(columns[0]), pa.string()), *columns], named)

    return found.unionByName(spark.createDataFrame([(n,) for n in plain], "path string").repartition(len(plain)).mapInArrow(run, found.schema))


def text_images(spark: SparkSession, path: str, pattern: str = "images.txt", chunk: int = CHUNK) -> DataFrame:
    """Pairs of lines of ``images.txt``: chunks start at lines and are counted; a pair belongs where its first line starts."""
    rows = [(f, k, k * chunk, min(size, (k + 1) * chunk), size) for f, size in files_of(spark, path, pattern) for k in range(-(-size // chunk))]

    def line_at(path: str, at: int, size: int) -> int:
        """The first line's place at or behind ``at``."""
        if at == 0 or at >= size:
            return min(at, size)
        at, step = at - 1, 1 << 16
        while at < size:
            data = read_at(path, at, min(size, at + step))
            end = data.find(b"\n")
            if end >= 0:
                return at + end + 1
            at += len(data)
        return size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                start, stop = line_at(r["path"], r["start"], r["size"]), line_at(r["path"], r["stop"], r["size"])
                data = read_at(r["path"], start, stop)
                second, at = -1, 0
                while at < len(data) and data[at : at + 1] == b"#":
                    at = (data.find(b"\n", at) + 1) or len(data)
                if at < len(data):  # behind the first line that is no comment
                    second = start + ((data.find(b"\n", at) + 1) or len(data))
                yield pa.RecordBatch.from_pydict({"path": [r["path"]], "k": pa.array([r["k"]], pa.int32()), "start": [start], "stop": [stop], "n": [len(_text_lines(data)) if data else 0], "second": [second]})

    found = {}
    if rows:
        asked = spark.createDataFrame(rows, "path string, k int, start long, stop long, size long").repartition(min(len(rows), 10_000))
        found = {(r.path, r.k): r for r in asked.mapInArrow(run, "path string, k int, start long, stop long, n long, second long").collect()}
    splits, lines, last = [], {}, {}
    for name, k, *_ in rows:
        r = found[name, k]
        if not r.n:
            continue
        odd = lines.get(name, 0) % 2  # the chunk's first line ends the pair before
        if odd:
            last[name][2] = r.second
        if r.n > odd:
            last[name] = [name, r.second if odd else r.start, r.stop, 0, ""]
            splits.append(last[name])
        lines[name] = lines.get(name, 0) + r.n
    return _loaded(spark, "images_text", splits)


# --- writing


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a list column."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), sizes


def _numbers(column: pa.Array, kind=float) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(kind)


def _encode_points(batch: pa.RecordBatch) -> bytes:
    heads = np.zeros(batch.num_rows, POINT)
    heads["pid"], heads["error"] = _numbers(batch.column("pid"), np.int64), _numbers(batch.column("error"))
    heads["p"] = np.stack([_numbers(batch.column(c)) for c in "xyz"], axis=1)
    heads["c"] = np.stack([_numbers(batch.column(c), np.uint8) for c in "rgb"], axis=1)
    track, n = _flat(batch.column("track"))
    heads["n"] = n
    pairs = np.stack([_numbers(track.field(c), "<i4") for c in ("image_id", "point")], axis=1)
    return _woven([(heads.view(np.uint8), np.full(len(n), 51)), (np.ascontiguousarray(pairs).view(np.uint8).ravel(), 8 * n)])


def _woven(parts: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Each row's bytes of every part, one after the other; a part is (bytes, sizes by row)."""
    sizes = np.stack([s for _, s in parts])
    starts = np.cumsum(sizes.sum(axis=0)) - sizes.sum(axis=0)
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k, (data, size) in enumerate(parts):
        out[spans(starts + sizes[:k].sum(axis=0), size)] = data
    return out.tobytes()


def _encode_images(batch: pa.RecordBatch) -> bytes:
    n_rows = batch.num_rows
    heads = np.zeros(n_rows, np.dtype([("id", "<i4"), ("q", "<f8", 4), ("t", "<f8", 3), ("camera", "<i4")]))
    heads["id"], heads["camera"] = _numbers(batch.column("image_id"), np.int32), _numbers(batch.column("camera_id"), np.int32)
    heads["q"], heads["t"] = _numbers(_flat(batch.column("q"))[0]).reshape(n_rows, 4), _numbers(_flat(batch.column("t"))[0]).reshape(n_rows, 3)
    names = [x.encode() + b"\0" for x in batch.column("name").to_pylist()]
    points, n = _flat(batch.column("points"))
    body = np.zeros(len(points), np.dtype([("x", "<f8"), ("y", "<f8"), ("pid", "<i8")]))
    for c, kind in (("x", float), ("y", float), ("pid", np.int64)):
        body[c] = _numbers(points.field(c), kind)
    return _woven([
        (heads.view(np.uint8), np.full(n_rows, 64)), (np.frombuffer(b"".join(names), np.uint8), np.array([len(x) for x in names], np.int64)),
        (n.astype("<u8").view(np.uint8), np.full(n_rows, 8)), (body.view(np.uint8), 24 * n),
    ])


def _encode_images_text(batch: pa.RecordBatch) -> bytes:
    return "".join(f"{line}\n" for pair in zip(batch.column("head").to_pylist(), batch.column("body").to_pylist(), strict=True) for line in pair).encode()


def _encode_ply_points(batch: pa.RecordBatch) -> bytes:
    out = np.zeros(batch.num_rows, np.dtype([*((c, "<f4") for c in "xyz"), *((c, "u1") for c in "rgb")]))
    for c in "xyzrgb":
        out[c] = _numbers(batch.column(c), out.dtype[c])
    return out.tobytes()


def _encode_splats(batch: pa.RecordBatch) -> bytes:
    n = batch.num_rows
    group = lambda c: _numbers(_flat(batch.column(c))[0]).reshape(n, -1)
    return np.concatenate((group("mean"), np.zeros((n, 3)), group("dc"), group("rest"), _numbers(batch.column("opacity_logit")).reshape(n, 1), group("log_scale"), group("quat")), axis=1).astype("<f4").tobytes()


#: Camera models of the COLMAP format with their numbers of parameters.
CAMERA_MODELS = (
    ("SIMPLE_PINHOLE", 3), ("PINHOLE", 4), ("SIMPLE_RADIAL", 4), ("RADIAL", 5), ("OPENCV", 8), ("OPENCV_FISHEYE", 8),
    ("FULL_OPENCV", 12), ("FOV", 5), ("SIMPLE_RADIAL_FISHEYE", 4), ("RADIAL_FISHEYE", 5), ("THIN_PRISM_FISHEYE", 12),
)


def _encode_cameras(batch: pa.RecordBatch) -> bytes:
    numbers = {name: i for i, (name, _) in enumerate(CAMERA_MODELS)}
    return b"".join(struct.pack(f"<iiQQ{len(r['params'])}d", r["camera_id"], numbers[r["model"]], r["width"], r["height"], *r["params"]) for r in batch.to_pylist())


ENCODERS = {"cameras": _encode_cameras, "points3D": _encode_points, "images": _encode_images, "images_text": _encode_images_text, "ply_points": _encode_ply_points, "ply_splats": _encode_splats}


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    size: int


class _Parts(DataSourceArrowWriter):
    """Each task writes a part; the commit lists the parts of the tasks that count."""

    def __init__(self, kind: str, into: str, names: list):
        self.kind, self.into, self.names = kind, into, names

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        name, rows, size = uuid.uuid4().hex, 0, 0
        os.makedirs(self.into, exist_ok=True)
        with open(f"{self.into}/{name}", "wb") as f:
            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):
                    data = ENCODERS[self.kind](batch.slice(k, ROWS))
                    f.write(data)
                    rows, size = rows + min(ROWS, batch.num_rows - k), size + len(data)
        return Part(TaskContext.get().partitionId(), name, rows, size)

    def commit(self, messages: list) -> None:
        os.makedirs(self.into, exist_ok=True)
        parts = sorted((m.partition, m.name, m.rows, m.size) for m in messages if m is not None)
        with open(f"{self.into}/_parts.json", "w") as f:
            json.dump(parts, f)

    def abort(self, messages: list) -> None:
        pass  # what is not listed does not count


def write_records(df: DataFrame, kind: str, path: str, key: str, head: Callable[[int], bytes]) -> None:
    """``df`` in order of ``key`` as one file: parts by tasks, then each copied to the place that the sizes before it give. ``head(n)``
    are the bytes before the records."""
    spark, target = df.sparkSession, local(path)
    if target is None:
        raise ValueError(f"{path}: one file is written on a mounted file system only; write Parquet")
    spark.dataSource.register(SceneRecords)
    into = f"{target}.parts-{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    df.repartitionByRange(key).sortWithinPartitions(key).write.format("scene_records").option("kind", kind).option("into", into).mode("append").save()
    with open(f"{into}/_parts.json") as f:
        parts = json.load(f)
    first = head(sum(p[2] for p in parts))
    places, at = [], len(first)
    for _, name, _, size in parts:
        places.append((f"{into}/{name}", at, size))
        at += size
    whole = f"{into}/whole"
    with open(whole, "wb") as f:
        f.write(first)
        f.truncate(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open(r["part"], "rb") as source, open(whole, "r+b") as out:
                    out.seek(r["at"])
                    while data := source.read(1 << 20):
                        out.write(data)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    if full := [p for p in places if p[2]]:
        copied = spark.createDataFrame(full, "part string, at long, size long").repartition(min(len(full), 10_000)).mapInArrow(run, "n long")
        copied.agg(F.sum("n")).collect()
    os.replace(whole, target)
    for name, _, _ in places:
        os.unlink(name)
    os.unlink(f"{into}/_parts.json")


class FileRows(DataSource):
    """``df.write.format("file_rows")``: a file for each row (name, content), written by the row's task."""

    @classmethod
    def name(cls) -> str:
        return "file_rows"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Files(self.options["into"])


class _Files(DataSourceArrowWriter):
    def __init__(self, into: str):
        self.into = into

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = f"{self.into}/{name}"
                os.makedirs(os.path.dirname(target), exist_ok=True)
                half = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
                with open(half, "wb") as f:
                    f.write(content)
                os.replace(half, target)  # whole, however often the task runs
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        pass


def write_files(df: DataFrame, path: str) -> None:
    """A file under ``path`` (on a mounted file system) for each row (name, content) of ``df``."""
    target = local(path)
    if target is None:
        raise ValueError(f"{path}: files are written on a mounted file system only")
    df.sparkSession.dataSource.register(FileRows)
    df.select("name", "content").write.format("file_rows").option("into", target).mode("append").save()
