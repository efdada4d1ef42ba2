"""Scenes through Spark's readers, text scenes in several splits, the table function, limits and addresses."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.functions import camera as CAM
from voxelloom.operators import consensus as C
from voxelloom.operators import geometry as G
from voxelloom.sources import fetch, files, scenes
from voxelloom.sources.splat import encode


def text_ply(path, n, eol="\n", before=0):
    head = ["ply", "format ascii 1.0", *([f"element camera {before}", "property float focal"] if before else []), f"element vertex {n}", "property float x", "property uchar f_dc_0", "property double opacity", "end_header"]
    rows = [f"{i} {i % 256}  {i / 4}" if i % 7 else f" {i} nothing" for i in range(n)]
    path.write_bytes(eol.join([*head, *["1"] * before, *rows, "0 0 0", ""]).encode())


@pytest.mark.parametrize("eol, before", [("\n", 0), ("\r\n", 3)])
def test_text_scenes_are_split_by_bytes(spark, tmp_path, eol, before):
    text_ply(tmp_path / "a.ply", 3000, eol, before)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = scenes.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert sorted(r.line for r in lines.collect()) == list(range(lines.count()))
        got = files.load_scene(spark, str(tmp_path / "a.ply")).orderBy("splat_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.splat_id, r.x) for r in got] == [(i, i) for i in range(3000)]
    assert all(r.opacity_logit == (i / 4 if i % 7 else 0) and abs(r.sh_dc_r - (i % 256 / 255 if i % 7 else 0)) < 1e-6 and r.rot_w == 0 for i, r in enumerate(got))


def test_table_function(spark):
    import pyarrow as pa

    from voxelloom.sources.ply import COLUMNS

    t = pa.table({c: np.arange(3, dtype=np.float64) / 10 for c in COLUMNS})
    ply = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float z\nend_header\n" + struct.pack("<4f", 1, 2, 3, 4)
    df = spark.createDataFrame([(1, encode(t)), (2, ply), (3, None), (4, b""), (5, encode(t) + b"rest")], "name long, content binary")
    got = scenes.parsed(df, "content").orderBy("name", "splat_id").collect()
    assert [(r.name, r.splat_id) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (5, 0), (5, 1), (5, 2)]
    assert [(r.x, r.y, r.z) for r in got if r.name == 2] == [(1, 0, 2), (3, 0, 4)]
    assert scenes.parsed(df.limit(0), "content").count() == 0


def test_limits(spark, tmp_path):
    (tmp_path / "a.splat").write_bytes(bytes(320))
    assert files.load_scene(spark, str(tmp_path / "a.splat"), most=320).count() == 10
    with pytest.raises(ValueError, match="more than 319"):
        files.load_scene(spark, str(tmp_path / "a.splat"), most=319)
    by_any = scenes.binary_scene(spark, f"file://{tmp_path}/a.splat")
    assert by_any.count() == 10


def test_addresses(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            seen.append(self.path)
            code = 200 if self.path == "/good" or (self.path == "/later" and seen.count("/later") > 1) else 404 if self.path == "/none" else 503
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"x" * 100)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    (tmp_path / "f").write_bytes(b"here")
    urls = [f"{at}/good", f"{at}/later", f"{at}/none", f"{at}/busy", f"file://{tmp_path}/f", f"file://{tmp_path}/g", "nothing", None, "http://127.0.0.1:1/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i long, url string").coalesce(1)
    got = {r.i: (r.content and bytes(r.content), r.error) for r in fetch.fetched(df, tries=3, wait=0.01).collect()}
    assert got[0] == got[1] == (b"x" * 100, None) and got[4] == (b"here", None)
    assert got[2] == (None, "status 404") and got[3] == (None, "status 503") and got[5] == (None, "FileNotFoundError")
    assert got[6] == got[7] == (None, "not an address") and got[8] == (None, "ConnectionRefusedError")
    assert (seen.count("/none"), seen.count("/busy"), seen.count("/later")) == (1, 3, 2)
    small = fetch.fetched(df.where("i = 0"), most=99).first()
    assert small.content is None and small.error == "more than 99 bytes"
    server.shutdown()


def test_consensus_with_outliers(spark):
    """A third of the matches are wrong; the sampled models find the pose, number by number."""
    rng = np.random.default_rng(3)
    x3 = np.c_[rng.uniform(-2, 2, (600, 2)), rng.uniform(4, 9, 600)]
    r, t = G.rotation(np.array([0.05, -0.2, 0.03])), np.array([0.8, 0.1, -0.1])
    b = x3 @ r.T + t
    xa, xb = x3[:, :2] / x3[:, 2:], b[:, :2] / b[:, 2:]
    wrong = rng.random(600) < 0.33
    xb[wrong] += rng.uniform(0.3, 0.9, (wrong.sum(), 2)) * rng.choice([-1, 1], (wrong.sum(), 2))
    df = spark.createDataFrame([(0, 1, i, i, *map(float, (*xa[i], *xb[i]))) for i in range(600)], "img_a int, img_b int, feat_a long, feat_b long, xa double, ya double, xb double, yb double")
    rows = C.numbered(df, ["img_a", "img_b"], ["img_a", "img_b", "feat_a", "feat_b"], C.TWO)
    assert sorted(x.at for x in rows.collect()) == list(range(600))
    found = C.essentials(rows, C.blocks(rows, C.TWO), limit=1e-5)
    e = np.reshape(found.first().m, (3, 3))
    assert found.first().inliers >= (~wrong).sum() and np.median(G.sampson(e, xa[~wrong], xb[~wrong])) < 1e-12
    pnp = spark.createDataFrame([(7, i, *map(float, (*xb[i], *x3[i]))) for i in range(600)], "image_id int, point_id long, u double, v double, x double, y double, z double")
    rows = C.numbered(pnp, ["image_id"], ["image_id", "point_id"], C.SIX)
    m = np.array(C.resections(rows, C.blocks(rows, C.SIX), count=64, limit=1e-4).first().m)
    assert np.allclose(m[:9].reshape(3, 3), r, atol=1e-6) and np.allclose(m[9:], t, atol=1e-6)
    few = C.numbered(pnp.where("point_id < 3"), ["image_id"], ["image_id", "point_id"], C.SIX)
    assert C.resections(few, C.blocks(few, C.SIX), count=8).count() == 0


def test_camera_columns(spark):
    c = CAM.Camera(320, 240, 300.0, 150.0, 130.0, position=(1.0, 2.0, 3.0), forward=(0.3, -0.2, 0.9))
    r, t = CAM.view_columns([F.lit(v) for v in c.position], [F.lit(v) for v in c.forward])
    p = CAM.projection_columns(F.lit(320), F.lit(240), F.lit(300.0), F.lit(150.0), F.lit(130.0))
    flat = [*[x for row in r for x in row], *t, *[x for row in p for x in row]]
    got = np.array(list(spark.range(1).select(*[x.cast("double").alias(f"c{i}") for i, x in enumerate(flat)]).first()))
    assert np.allclose(got, np.r_[c.view()[0].ravel(), c.view()[1], c.projection().ravel()])
