import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException

from pointloom.functions import labels, text
from pointloom.sources import lidar, ply, sinks


def frame(root, seq, n, points, marks):
    for kind, ext, data in (("velodyne", "bin", np.asarray(points, "<f4").tobytes()), ("labels", "label", np.asarray(marks, "<u4").tobytes())):
        d = root / "sequences" / seq / kind
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{n:06d}.{ext}").write_bytes(data)


def test_frames_and_labels(spark, tmp_path):
    frame(tmp_path, "00", 3, [[1, 2, 3, 0.5], [4, 5, 6, 0.1]], [(7 << 16) | 10, (65535 << 16) | 22])
    root = lidar.sequences_root(str(tmp_path))
    assert lidar.list_sequences(root, ("velodyne", "labels")) == ["00"]
    assert lidar.list_frames(f"{root}/00/velodyne", start=1) == ["000003"]
    got = labels.unpack(lidar.read_frames(spark, root, root)).orderBy("idx").collect()
    assert [(r.seq, r.frame, r.idx, r.x, r.semantic, r.instance, r.valid) for r in got] == [("00", 3, 0, 1.0, 10, 7, True), ("00", 3, 1, 4.0, 22, 65535, True)]


def test_a_broken_frame_is_an_error_or_counted(spark, tmp_path):
    frame(tmp_path, "01", 0, [[1, 2, 3, 4]], [1, 2])
    with pytest.raises(PySparkException, match="1 points and 2 labels"):
        lidar.read_frames(spark, str(tmp_path), str(tmp_path)).collect()
    marked = lidar.read_frames(spark, str(tmp_path), str(tmp_path), "mark")
    assert lidar.skipped_frames(marked).first().skipped_frames == 1
    with pytest.raises(ValueError):
        lidar.decode_points(b"123")
    assert lidar.decode_points(b"1" * 17, strict=False).shape == (1, 4)


def test_poses_and_calibrations(spark, tmp_path):
    d = tmp_path / "00"
    d.mkdir()
    (d / "poses.txt").write_text("1 0 0 1 0 1 0 2 0 0 1 3\n1 0 0 4 0 1 0 5 0 0 1 6\n")
    (d / "calib.txt").write_text("P0: 1 2 3\nTr: " + "9 " * 12 + "\nTr: " + " ".join(map(str, range(12))) + "\n")
    assert [(r.seq, r.frame, r.m[3]) for r in lidar.read_poses(spark, str(d / "poses.txt")).orderBy("frame").collect()] == [("00", 0, 1.0), ("00", 1, 4.0)]
    assert lidar.read_tr(spark, str(d / "calib.txt")).first().m == [float(i) for i in range(12)]
    (d / "000007.txt").write_text("R_rect: 1 0 0 0 1 0 0 0 1\nTr_velo_to_cam: " + " ".join(map(str, range(12))))
    c = lidar.read_kitti_calib(spark, str(d / "000007.txt")).first()
    assert (c.frame, c.r0[0], c.tr[11]) == (7, 1.0, 11.0)
    (d / "000008.txt").write_text("Car 0 0 0 1 2 3 4 1.5 1.6 4.0 1 2 3 0.1\nDontCare -1 -1 -10 0 0 0 0 -1 -1 -1 -1000 -1000 -1000 -10\nVan x\nCar 0 0 0 1 2 3 4 a b c d e f g\n")
    b = lidar.read_kitti_labels(spark, str(d / "000008.txt")).collect()
    assert [(r.frame, r.box, r.type, r.h, r.ry) for r in b] == [(8, 0, "Car", 1.5, 0.1)]


def test_ply_round_trip_and_header(spark, tmp_path):
    p = spark.createDataFrame([(1, 0.5, 1.5, 2.5, 64, 65, 66), (0, 1.0, 2.0, 3.0, 1, 2, 3)], "idx long, x double, y double, z double, r int, g int, b int")
    ply.write_ply(p, str(tmp_path / "out.ply"))
    got = ply.read_ply(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.file, r.idx, r.x, r.y, r.z, r.instance) for r in got] == [("out.ply", 0, 1.0, 2.0, 3.0, None), ("out.ply", 1, 0.5, 1.5, 2.5, None)]
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty double x\nproperty float y\nproperty short z\nproperty float scalar_instance\nend_header\n"
    d = ply.decode(head + struct.pack("<dfhf", 1, 2, 3, 4.6) + struct.pack("<dfhf", 1, 2, -3, -1.0))
    assert d["z"].tolist() == [3.0, -3.0] and d["instance"].tolist()[0] == 5 and d["instance"].isna().tolist() == [False, True]
    a = ply.decode(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n")
    assert a[["x", "y", "z"]].values.tolist() == [[1, 2, 3]]
    for bad in (head.replace(b"double x", b"list uchar int x"), head.replace(b"binary_little_endian", b"binary_big_endian"), head.replace(b"short z", b"int64 z")):
        with pytest.raises(ValueError):
            ply.decode(bad)


def test_manifest_and_sinks(spark, tmp_path):
    (tmp_path / "m.csv").write_text("target_points,frames_used,car,tree,building,bbox_x,bbox_y,bbox_z,ply_path\n500000,3,1,2,3,1.0,2.0,3.0,a.ply\n")
    m = lidar.read_manifest(spark, str(tmp_path / "m.csv"))
    assert lidar.require_targets(m, [500000]).first().ply_path == "a.ply"
    with pytest.raises(PySparkException, match="target not in manifest"):
        lidar.require_targets(m, [1]).collect()
    df = spark.createDataFrame([(1, 0.5)], "a long, b double")
    assert sinks.fixed(df).first().b == "0.500000"
    assert sinks.markdown(df) == "| a | b |\n| --- | --- |\n| 1 | 0.500 |\n"
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().b == "0.500000"
    pts = spark.createDataFrame([(i, float(i), 0.0, 0.0, 1, 2, 3) for i in range(10)], "idx long, x double, y double, z double, r int, g int, b int")
    drawn = sinks.svg(pts, "a < b", columns=5)
    assert drawn.count("<path") == 5 and "a &lt; b" in drawn and drawn.count("#010203") == 5
    assert sinks.svg(pts.limit(0), "t").count("<path") == 0 and sinks.svg(pts.limit(1), "t").count("<path") == 1
    assert "<canvas" in sinks.preview_html(pts, "t") and len(sinks._sample(pts, 4)) == 4


def test_single_files_and_paths(spark, tmp_path):
    frame(tmp_path, "00", 3, [[1, 2, 3, 0.5], [4, 5, 6, 0.1]], [(7 << 16) | 10, (65535 << 16) | 22])
    root = str(tmp_path / "sequences" / "00")
    got = lidar.read_points(spark, f"{root}/velodyne").orderBy("idx").collect()
    assert [(r.seq, r.frame, r.idx, r.x, r.z) for r in got] == [("00", 3, 0, 1.0, 3.0), ("00", 3, 1, 4.0, 6.0)]
    marks = lidar.read_labels(spark, f"{root}/labels").orderBy("idx").collect()
    assert [r.label for r in marks] == [(7 << 16) | 10, (65535 << 16) | 22]
    (tmp_path / "sequences/00/velodyne/000004.bin").write_bytes(b"\x00" * 17)
    assert lidar.read_points(spark, f"{root}/velodyne", strict=False).where("frame = 4").count() == 1
    with pytest.raises(PySparkException):
        lidar.read_points(spark, f"{root}/velodyne").collect()
    (tmp_path / "c.csv").write_text("x,y,z,r,g,b\n1.5,2,3,4,5,6\n")
    assert tuple(lidar.read_coloured(spark, str(tmp_path / "c.csv")).first()) == (1.5, 2.0, 3.0, 4, 5, 6)
    assert lidar.resolve_path("/else/where/c.csv", str(tmp_path)) == str(tmp_path / "c.csv")
    with pytest.raises(FileNotFoundError):
        lidar.resolve_path("none.csv", str(tmp_path))


def test_texts():
    assert text.parse_targets("range:10:30:10") == [10, 20, 30] and text.parse_targets("3, 1,3") == [1, 3]
    assert [text.target_name(n) for n in (500_000, 2_000_000, 1234, 0)] == ["500k", "2M", "1234", "0M"]
    assert text.split_csv("a,,b") == ["a", "b"] and text.split_csv("a,,b", True) == ["a", "", "b"]
    assert text.parse_bool(" Yes ") and not text.parse_bool("0") and text.sanitize_filename("a b.c") == "a_b_c"
