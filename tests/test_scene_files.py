"""Scene files: written by hand or by the writers, read back."""

import json
import pickle
import struct

import numpy as np
import pytest

from pelagia.sources import scene_files as S


def test_colmap_binary(spark, tmp_path):
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<QiiQQ4d", 1, 7, 1, 640, 480, 500, 501, 320, 240))
    image = struct.pack("<idddddddi", 3, 1, 0, 0, 0, 0.1, 0.2, 0.3, 7) + b"a.png\0" + struct.pack("<Q", 2) + struct.pack("<ddqddq", 1, 2, 5, 3, 4, -1)
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 1) + image)
    point = struct.pack("<QdddBBBdQ", 5, 1.0, 2.0, 3.0, 9, 8, 7, 0.5, 1) + struct.pack("<ii", 3, 0)
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 1) + point)
    camera = S.colmap_cameras(spark, str(tmp_path)).first()
    assert (camera.model, camera.width, camera.params) == ("PINHOLE", 640, [500, 501, 320, 240])
    images = S.colmap_images(spark, str(tmp_path))
    assert images.first().name == "a.png" and images.first().points[1].pid == -1
    assert S.matched_counts(images).first().matched == 1
    points = S.colmap_points(spark, str(tmp_path))
    assert points.first().track[0].image_id == 3
    out = tmp_path / "out"
    S.write_colmap_points(points, f"file://{out}/points3D.bin")
    assert (out / "points3D.bin").read_bytes() == (tmp_path / "points3D.bin").read_bytes()


def test_colmap_text(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# a comment\n1 PINHOLE 640 480 500 501 320 240\n")
    (tmp_path / "points3D.txt").write_text("# a comment\n5 1 2 3 9 8 7 0.5 3 0\n")
    assert S.colmap_text_cameras(spark, str(tmp_path / "cameras.txt")).first().params == [500, 501, 320, 240]
    point = S.colmap_text_points(spark, str(tmp_path / "points3D.txt")).first()
    assert (point.pid, point.z, point.error, point.track_fields) == (5, 3.0, 0.5, 2)


def test_ply(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n1 2 3 4 5 6\n7 8 9 10 11 12\n")
    rows = S.ply_points(spark, str(tmp_path)).orderBy("pid").collect()
    assert [(r.x, r.b) for r in rows] == [(1, 6), (7, 12)]
    data = [(1, [1.0, 2.0, 3.0], 0.5, [0.1, 0.2, 0.3], [], [0.0, 0.5, 1.0], [1.0, 0.0, 0.0, 0.0]), (2, [float("nan"), 2.0, 3.0], 0.5, [0.1, 0.2, 0.3], [], [0.0] * 3, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, S.SPLATS)
    S.write_ply_splats(df, f"file://{tmp_path}/s/b.ply")
    back = S.ply_splats(spark, f"{tmp_path}/s").collect()
    assert len(back) == 1 and np.allclose(back[0].dc, [0.1, 0.2, 0.3]) and back[0].log_scale == [0.0, 0.5, 1.0]


def test_frames_and_what_is_not_a_frame(spark, tmp_path):
    image = np.arange(6, dtype=np.uint8).reshape(2, 3)
    (tmp_path / "f012.pkl").write_bytes(pickle.dumps({"ImagingSonar": image, "PoseSensor": np.eye(4)}))
    rows = S.sonar_frames(spark, str(tmp_path)).collect()
    assert {(r.frame, r.rng, r.az, round(r.v * 255)) for r in rows} == {(12, i, j, int(image[i, j])) for i in range(2) for j in range(3)}
    with pytest.raises(pickle.UnpicklingError):
        list(S._frame(pickle.dumps(print)))


def test_json_npz_and_archives(spark, tmp_path):
    (tmp_path / "transforms_train.json").write_text(json.dumps({"camera_angle_x": 0.7, "frames": [{"file_path": "r_0", "transform_matrix": np.arange(16.0).reshape(4, 4).tolist()}]}))
    camera = S.nerf_cameras(spark, str(tmp_path / "transforms_train.json")).first()
    assert camera.file == "r_0" and camera.c2w[:4] == [0.0, -1.0, -2.0, 3.0]
    k = np.array([[500.0, 0, 320], [0, 510, 240], [0, 0, 1]])
    c, s = np.cos(0.3), np.sin(0.3)
    r, t = np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]), np.array([1.0, 2, 3])
    (tmp_path / "npz").mkdir()
    np.savez(tmp_path / "npz" / "cameras.npz", world_mat_0=np.vstack((k @ np.column_stack((r, t)), [0, 0, 0, 1])))
    got = S.npz_cameras(spark, str(tmp_path / "npz")).first()
    assert np.allclose(np.reshape(got.k, (3, 3)), k) and np.allclose(np.reshape(got.r, (3, 3)), r) and np.allclose(got.t, t)
    files = spark.createDataFrame([("d.7z.001", 1), ("d.7z.002", 2), ("e.zip", 3)], "path string, length long")
    assert {(r.archive, len(r.parts), r.size) for r in S.archive_parts(files).collect()} == {("d.7z", 2, 3), ("e.zip", 1, 3)}
    (tmp_path / "dataverse.json").write_text(json.dumps({"data": {"latestVersion": {"files": [{"directoryLabel": "x", "dataFile": {"id": 1, "filename": "a.png", "filesize": 5, "contentType": "image/png"}}]}}}))
    assert S.dataverse_files(spark, str(tmp_path / "dataverse.json")).first().filename == "a.png"


def test_text_images_dense_maps_and_bad_images(spark, tmp_path):
    (tmp_path / "images.txt").write_text("# two lines an image\n1 1 0 0 0 0.5 0.6 0.7 2 a b.png\n1 2 5 3 4 -1\n2 1 0 0 0 0 0 0 2 c.png\n\n")
    images = S.colmap_text_images(spark, str(tmp_path)).orderBy("image_id").collect()
    assert [(r.name, len(r.points), r.t) for r in images] == [("a b.png", 2, [0.5, 0.6, 0.7]), ("c.png", 0, [0.0] * 3)]
    array = np.arange(24, dtype="<f4").reshape(3, 2, 4)  # across, down, channels
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"3&2&4&" + array.ravel(order="F").tobytes())
    got = {(r.row, r.col, r.channel): r.v for r in S.colmap_dense(spark, str(tmp_path / "d")).collect()}
    assert len(got) == 24 and all(got[d, a, c] == array[a, d, c] for a in range(3) for d in range(2) for c in range(4))
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "bad.png").write_bytes(b"no image")
    (tmp_path / "i" / "cut.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    assert [(r.width, r.error is None) for r in S.safe_images(spark, str(tmp_path / "i")).collect()] == [(None, False)] * 2


def test_the_walk_tells_the_length_of_every_image(spark):
    from pelagia import catalog_of_queries as base

    found = base.queries()["src_image_walk"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == 25 and [r.i for r in sorted(found, key=lambda r: r.relative)] == list(range(25))
    assert {r.relative.rpartition("/n")[2]: r.length for r in found} == {f"{k}.png": 33 if k % 5 else 8 for k in range(25)}
