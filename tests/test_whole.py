"""Steps that queries left out or replaced."""

import numpy as np
from pyspark.sql import functions as F

from voxelloom.operators import geometry as G
from voxelloom.operators import sfm


def test_seeds_are_gated_by_inliers_and_rotation(spark):
    """The number of matches alone decided, inliers and pose were not looked at."""
    rng = np.random.default_rng(5)
    r, t = G.rotation(np.array([0.002, -0.006, 0.001])), np.array([-3.0, 0.8, 0.1])
    x3 = np.c_[rng.uniform(-40, 40, (30, 2)), rng.uniform(2, 6, 30)]
    b = x3 @ r.T + t
    xa, xb = x3[:, :2] / x3[:, 2:], b[:, :2] / b[:, 2:]
    xb[:5, 1] += np.array([9.0, -9.0, 12.0, -12.0, 15.0])
    wild = rng.uniform(-500, 500, (16, 4))
    rows = [(0, 1, i, i, *map(float, (*xa[i], *xb[i]))) for i in range(30)] + [(0, 2, i, i, *map(float, wild[i])) for i in range(16)]
    rows += [(1, 2, i, i, *map(float, (*xa[i + 5], *xb[i + 5]))) for i in range(14)] + [(1, 3, i, i, 0.0, 0.0, 0.0, 0.0) for i in range(7)]
    coords = spark.createDataFrame(rows, "img_a int, img_b int, feat_a long, feat_b long, xa double, ya double, xb double, yb double")
    got = {(g.img_a, g.img_b): g for g in sfm.seed_gate(coords).collect()}
    assert {k: (g.n, g.reason) for k, g in got.items()} == {(0, 1): (30, "ok"), (0, 2): (16, "no matrix"), (1, 2): (14, "few matches")}
    assert got[0, 1].inliers == 25 and abs(got[0, 1].det - 1) < 1e-9 and got[1, 2].inliers is None
    assert sfm.seed_gate(coords.where("img_a = 0 and img_b = 1"), inside=26).first().reason == "few inliers"
    cases = [(14, 14, 1.0), (15, None, None), (15, 9, 1.0), (15, 10, None), (15, 10, -1.0), (15, 10, 1.2), (15, 10, 1.05)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n int, inliers int, det double")
    verdicts = df.orderBy("i").select(sfm.seed_verdict(F.col("n"), F.col("inliers"), F.col("det")).alias("v"))
    assert [v.v for v in verdicts.collect()] == ["few matches", "no matrix", "few inliers", "no pose", "no rotation", "no rotation", "ok"]


def test_depth_model_sees_its_whole_size(spark):
    """The query gave the model 16 x 16 pixels, and no range of depths came back."""
    from voxelloom.operators import depth as D
    from voxelloom.operators import models as M
    from voxelloom.plans import registry

    rng = np.random.default_rng(8)
    raw = [(i, w, h, rng.integers(0, 256, (h, w, 3)).astype(np.uint8)) for i, (w, h) in enumerate([(12, 8), (700, 20)])] + [(2, 4, 4, np.zeros((4, 4, 3), np.uint8))]
    df = spark.createDataFrame([(i, f"p{i}.png", w, h, 3, b.tobytes()) for i, w, h, b in raw], "image_id long, file_name string, width int, height int, n_channels int, data binary")

    def halves(x):
        assert x.shape == (1, 3, 518, 518)
        return x.mean(axis=1)[:, :259, ::2]  # a model may return another size

    got = M.estimate_depth(df, halves)
    rows = {(r.image_id, r.x, r.y): r.d for r in got.collect()}
    assert len(rows) == sum(w * h for _, w, h, _ in raw)
    for i, w, h, b in raw:
        for x, y in [(0, 0), (w - 1, h - 1), (w // 3, h // 2)]:
            sy, sx = y * 259 // h * h // 518, x * 259 // w * 2 * w // 518
            want = np.mean((b[sy, sx, ::-1] / 255 - np.array(M.MEAN)) / np.array(M.STD))
            assert abs(rows[i, x, y] - want) < 1e-12
    ranges = {r.image_id: (r.dmin, r.dmax) for r in got.select("image_id", "dmin", "dmax").distinct().collect()}
    assert ranges == {r.image_id: (r.dmin, r.dmax) for r in D.min_max(got.select("image_id", "d")).collect()} and ranges[2] == (0.0, 1.0)
    assert "518" in registry.oracle_sql()["n_depth"]


def test_import_detects_and_matches(spark, tmp_path):
    """Files were decoded only: no type was looked at, no feature sought and no pair matched."""
    from voxelloom.operators import features as K
    from voxelloom.operators import imports as I
    from voxelloom.plans.io_plans import png

    rng = np.random.default_rng(6)
    plane = rng.integers(0, 256, (60, 75, 3)).astype(np.uint8).repeat(2, 0).repeat(2, 1)
    shown = {"a.png": plane[:104, :104], "b.PNG": plane[8:112, 16:120], "other.png": rng.integers(0, 256, (104, 104, 3)).astype(np.uint8), "wide.png": plane[:90, :150]}
    for name, p in shown.items():
        (tmp_path / name).write_bytes(png(p.shape[1], p.shape[0], p.tobytes()))
    dot = png(1, 1, b"\0\0\0")
    (tmp_path / "notes.txt").write_bytes(dot)  # a picture, but no image by its type
    (tmp_path / "large.png").write_bytes(dot + bytes(200_000))
    (tmp_path / "bad.png").write_bytes(b"not a picture")
    images, features, matches = I.import_images(spark, str(tmp_path), most_bytes=200_000, most_side=110)
    ids = {r.file_name.rsplit("/", 1)[-1]: (r.image_id, r.width, r.height) for r in images.collect()}
    assert {k: v[1:] for k, v in ids.items()} == {k: (p.shape[1], p.shape[0]) for k, p in shown.items()}
    numbers = {v[0]: k for k, v in ids.items()}
    pairs = {tuple(sorted((numbers[r.img_a], numbers[r.img_b]))): r.n for r in matches.groupBy("img_a", "img_b").agg(F.count("*").alias("n")).collect()}
    assert set(pairs) == {("a.png", "b.PNG")} and pairs["a.png", "b.PNG"] >= 8  # of one scale and overlapping
    at = {(numbers[r.image_id], r.feat_id): (r.x, r.y) for r in features.collect()}
    shifts = [np.subtract(at[numbers[r.img_a], r.feat_a], at[numbers[r.img_b], r.feat_b]) for r in matches.collect()]
    sign = 1 if numbers[matches.first().img_a] == "a.png" else -1
    assert np.mean([np.array_equal(sign * s, (16.0, 8.0)) for s in shifts]) > 0.9
    # The wide one is sought in at most 110 pixels: its corners are those of nearest pixels, taken back to full size.
    one = np.float32
    w, h = int(one(150) * (one(110) / one(150))), int(one(90) * (one(110) / one(150)))
    sx, sy = ((np.arange(n, dtype=one) * (one(size) / one(n))).astype(int) for n, size in ((w, 150), (h, 90)))
    v = (shown["wide.png"][sy][:, sx].astype(int) @ np.array([77, 150, 29])) >> 8
    gray = spark.createDataFrame([(0, x, y, int(v[y, x])) for y in range(h) for x in range(w)], "image_id long, x int, y int, v int")
    want = {(r.feat_id, r.x * 150 / w, r.y * 90 / h, r.score, r.d0, r.d3) for r in K.detect(gray, w, h).collect()}
    got = {(r.feat_id, r.x, r.y, r.score, r.d0, r.d3) for r in features.where(F.col("image_id") == ids["wide.png"][0]).collect()}
    rounded = lambda rows: {(r[0], round(r[1], 9), round(r[2], 9), *r[3:]) for r in rows}
    assert len(want) > 20 and rounded(got) == rounded(want)
