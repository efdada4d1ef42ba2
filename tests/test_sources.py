"""Scene files: headers, strides, refusals and round trips."""

import struct

import numpy as np
import pytest

from voxelloom.sources import files
from voxelloom.sources.ply import Header
from voxelloom.sources.splat import decode


def binary_ply(path, eol, count=5):
    head = eol.join(["ply", "format binary_little_endian 1.0", f"element vertex {count}", "property float x", "property uchar opacity", "property double y", "property short extra", "end_header", ""])
    body = b"".join(struct.pack("<fBdh", i, 51 * i, i / 2, -1) for i in range(count))
    path.write_bytes(head.encode() + body)


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_binary_headers(spark, tmp_path, eol):
    binary_ply(tmp_path / "a.ply", eol)
    files.register(spark)
    got = spark.read.format("ply").option("rowsPerPartition", 2).load(str(tmp_path / "a.ply")).orderBy("splat_id").collect()
    assert [(r.splat_id, r.x, r.y, r.z) for r in got] == [(i, i, i / 2, 0) for i in range(5)]
    assert [round(r.opacity_logit, 5) for r in got] == [round(0.2 * i, 5) for i in range(5)]


def test_refusals(spark, tmp_path):
    for head in (b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty float x\nend_header\n", b"ply\nformat ascii 1.0\n"):
        with pytest.raises(ValueError):
            Header(head)
    (tmp_path / "s.splat").write_bytes(b"\0" * 31)
    with pytest.raises(Exception, match="less than one splat"):
        files.load_scene(spark, str(tmp_path / "s.splat")).count()
    with pytest.raises(ValueError):
        files.load_scene(spark, "scene.obj")


def test_splat_rows(spark, tmp_path):
    row = struct.pack("<6f", 1, 2, 3, -1, -2, -3)
    raw = b"".join(row + bytes([255, 128, 0, a]) + q for a, q in ((0, bytes(4)), (1, bytes([128, 0, 0, 0])), (128, bytes([0, 64, 0, 0])), (255, bytes([127, 0, 0, 0]))))
    (tmp_path / "a.splat").write_bytes(raw + b"x")  # a partial row at the end
    got = files.load_scene(spark, str(tmp_path / "a.splat")).orderBy("splat_id").collect()
    assert len(got) == 4 and (got[0].rot_w, got[0].rot_x) == (1, 0) and got[1].rot_w == -1 and got[2].rot_x == 1
    assert got[0].opacity_logit == -5 and got[3].opacity_logit == 5 and abs(got[2].opacity_logit) < 0.01
    assert decode(b"").num_rows == 0


@pytest.mark.parametrize("kind", ["ply", "splat"])
def test_round_trip(spark, tmp_path, kind):
    cols = [f"cast((id % {m}) / {m} as float) AS {c}" for c, m in zip("x y z scale_x scale_y scale_z rot_w rot_x rot_y rot_z opacity_logit sh_dc_r sh_dc_g sh_dc_b".split(), range(3, 17))]
    s = spark.range(1, 500).selectExpr("id AS splat_id", *cols).repartition(3)
    files.save_scene(s, str(tmp_path / kind), kind)
    back = spark.read.format(kind).load(str(tmp_path / kind))
    key = lambda df: np.array(sorted((r.x, r.y, r.z, r.scale_x, r.scale_y) for r in df.collect()))
    assert np.allclose(key(s), key(back), atol=1e-6)
    files.save_scene(s.limit(0), str(tmp_path / f"none-{kind}"), kind)


def test_calibration(spark):
    good = "a.png " + " ".join(str(i) for i in range(21))
    got = files.calibration(spark.createDataFrame([("2",), (good,), ("short 1 2",), (None,)], "value string")).collect()
    assert len(got) == 1 and got[0].k == [float(i) for i in range(9)] and got[0].t == [18.0, 19.0, 20.0]
