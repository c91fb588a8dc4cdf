"""Scene files of several splits: every record is read once, whatever the chunks and the guesses."""

import random
import struct

import numpy as np
import pytest

from pelagia.sources import record_files as R
from pelagia.sources import scene_files as S


def points(n: int, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, rng.random(), -rng.random(), 5.0, i % 256, 2, 3, 0.5, [(j, j * 2) for j in range(rng.randrange(0, 40))]) for i in range(n)]


def point_bytes(rows: list[tuple]) -> bytes:
    out = struct.pack("<Q", len(rows))
    for pid, x, y, z, r, g, b, e, track in rows:
        out += struct.pack("<QdddBBBdQ", pid, x, y, z, r, g, b, e, len(track)) + b"".join(struct.pack("<ii", *t) for t in track)
    return out


@pytest.mark.parametrize("chunk", [64, 500, 3000, 1 << 20])
def test_points_in_chunks(spark, tmp_path, chunk):
    rows = points(60)
    (tmp_path / "points3D.bin").write_bytes(point_bytes(rows))
    found = R.variable_records(spark, "points3D", str(tmp_path), "points3D.bin", chunk)
    assert chunk > 1000 or found.rdd.getNumPartitions() > 3
    got = sorted((r.pid, r.x, r.y, r.z, r.r, r.g, r.b, r.error, [tuple(t) for t in r.track]) for r in found.collect())
    assert got == rows


def test_wrong_guesses_are_followed_again(spark, tmp_path):
    """A track that looks like many short points: every chunk inside it guesses wrong."""
    fake = b"".join(struct.pack("<QdddBBBdQ", 7, 1.0, 1.0, 1.0, 1, 1, 1, 1.0, 0) for _ in range(320))
    assert len(fake) % 8 == 0
    head = struct.pack("<QdddBBBdQ", 1, 0.5, 0.5, 0.5, 1, 2, 3, 0.5, len(fake) // 8)
    rows = points(40, 2)
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 41) + head + fake + point_bytes(rows)[8:])
    files = R.files_of(spark, str(tmp_path), "points3D.bin")
    entry, n, _ = R.follow("points3D", files[0][0], 2048, 4096, files[0][1], None)
    assert n and entry < 4096, "the guess is wrong here"
    found = R.variable_records(spark, "points3D", str(tmp_path), "points3D.bin", 2048).collect()
    assert len(found) == 41 and max(len(r.track) for r in found) == len(fake) // 8
    assert sorted(r.pid for r in found) == sorted([1, *range(40)])


def test_cut_and_empty_files(spark, tmp_path):
    (tmp_path / "points3D.bin").write_bytes(point_bytes(points(30))[:-5])
    with pytest.raises(Exception):  # noqa: B017
        R.variable_records(spark, "points3D", str(tmp_path), "points3D.bin", 256).collect()
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 0))
    assert R.variable_records(spark, "points3D", str(tmp_path), "points3D.bin").collect() == []


@pytest.mark.parametrize("chunk", [200, 5000])
def test_images_round_trip(spark, tmp_path, monkeypatch, chunk):
    rows = [(i, [1.0, 0.0, 0.0, 0.0], [0.1 * i, 2.0, 3.0], 1, f"dir/ümage {i}.png", [(float(k), 2.0, k - 1) for k in range(i % 5)]) for i in range(50)]
    df = spark.createDataFrame(rows, S.IMAGES).repartition(3)
    S.write_colmap_images(df, f"file://{tmp_path}/b/images.bin")
    S.write_colmap_text_images(df, f"file://{tmp_path}/t/images.txt")
    for found in (R.variable_records(spark, "images", f"{tmp_path}/b", "images.bin", chunk), R.text_images(spark, f"{tmp_path}/t", chunk=chunk)):
        got = sorted((r.image_id, list(r.q), list(r.t), r.camera_id, r.name, [tuple(p) for p in r.points]) for r in found.collect())
        assert got == rows
    assert [p.name for p in (tmp_path / "b").iterdir() if p.is_file()] == ["images.bin"]


@pytest.mark.parametrize("chunk", [90, 1 << 20])
def test_splats_in_ranges(spark, tmp_path, chunk):
    rows = [(i, [float(i), 2.0, 3.0], 0.5, [0.25] * 3, [0.5] * 45, [0.0] * 3, [1.0, 0.0, 0.0, 0.0]) for i in range(40)]
    S.write_ply_splats(spark.createDataFrame(rows, S.SPLATS).repartition(4), f"file://{tmp_path}/a.ply")
    found = R.ply_records(spark, "ply_splats", str(tmp_path), chunk)
    assert sorted((r.gid, r.mean[0], len(r.rest)) for r in found.collect()) == [(i, float(i), 45) for i in range(40)]
    assert found.rdd.getNumPartitions() == (40 if chunk == 90 else 1)
    head = R.ply_head((tmp_path / "a.ply").read_bytes()[: 1 << 16])
    assert head.rows == 40 and (tmp_path / "a.ply").stat().st_size == head.begin + 40 * head.kind.itemsize


def test_ply_heads_that_are_refused(tmp_path):
    for text in ("not ply\n", "ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty float x\nend_header\n", "ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty list uchar int x\nend_header\n"):
        with pytest.raises(ValueError):
            R.ply_head(text.encode())


def test_empty_table_and_files(spark, tmp_path):
    S.write_ply_points(spark.createDataFrame([], "pid long, x double, y double, z double, r int, g int, b int"), f"file://{tmp_path}/e/a.ply")
    assert S.ply_points(spark, f"{tmp_path}/e").collect() == []
    S.write_files(spark.createDataFrame([("x/a.bin", b"1"), ("b.bin", b"")], "name string, content binary"), f"file://{tmp_path}/f")
    assert (tmp_path / "f/x/a.bin").read_bytes() == b"1" and (tmp_path / "f/b.bin").read_bytes() == b""
    with pytest.raises(ValueError):
        S.write_files(spark.createDataFrame([("a", b"")], "name string, content binary"), "viewfs://store/x")
    assert np.array_equal(R.spans(np.array([3, 9]), np.array([2, 1])), [3, 4, 9])
