"""What may not grow with the input: tables sent to every task, rows on the way, orders of one task."""

import math

import pytest
from pyspark.sql import functions as F

from voxelloom.operators import depth as D


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_are_not_broadcast(spark, tmp_path):
    # A small file, as nine rows a pixel count as one in Spark's estimate.
    spark.range(60).select((F.col("id") % 10).alias("x"), F.floor(F.col("id") / 10).alias("y"), (F.col("id") * 7 % 13).alias("v")).write.parquet(str(tmp_path / "v"))
    near = D.neighbours8(spark.read.parquet(str(tmp_path / "v")), 10, 6)
    assert "Broadcast" not in plan(near)
    at = {(r.x, r.y): r.v for r in spark.read.parquet(str(tmp_path / "v")).collect()}
    assert sorted((r.x, r.y, r.dx, r.dy, r.v) for r in near.collect()) == sorted((x, y, i, j, at[min(max(x + i, 0), 9), min(max(y + j, 0), 5)]) for x, y in at for i in (-1, 0, 1) for j in (-1, 0, 1))


def test_matching_by_blocks(spark, monkeypatch):
    import itertools
    import random

    from voxelloom.operators import match as M

    monkeypatch.setattr(M, "BLOCK", 3)  # several blocks an image, and ties across them
    rng = random.Random(4)
    rows = [(i, f, rng.randrange(8), rng.choice((0, -1, 1 << 62))) for f, i in enumerate([0] * 11 + [1] * 7 + [4] + [6] * 9)]
    rows.append(rows[3])  # a feature that is there twice
    df = spark.createDataFrame(rows, "image_id int, feat_id long, d0 long, d1 long")
    for reverse in (False, True):
        best = M.best_two(df, M.image_pairs(df.select("image_id").distinct()), ["d0", "d1"], reverse)
        assert "FlatMapGroupsInArrow" in plan(best).split("Window")[-1]  # reduced before anything is ranked
        found = {}
        for a, b in itertools.product(rows, rows):
            if a[0] < b[0]:
                d = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[2:], b[2:]))
                own, other = (b, a) if reverse else (a, b)
                found.setdefault((a[0], b[0], own[1]), []).append((d, other[1]))
        want = {k: (min(v)[1], min(v)[0], sorted(v)[1][0] if len(v) > 1 else None) for k, v in found.items()}
        assert {(r.img_a, r.img_b, r.feat): (r.match, r.best, r.second) for r in best.collect()} == want


def test_exponentials_and_logarithms_are_the_nearest_doubles(spark):
    """Next to the plane, a neighbouring double culled otherwise than the SQL (sizes 44 of 50 and others)."""
    from decimal import Decimal, localcontext

    from voxelloom.functions import splat as S

    v = (F.col("id") + 1) / 500.0
    rows = spark.range(3000).select(v.alias("v"), S.ln(v).alias("l"), S.exp(F.lit(-1.0) * v).alias("e"), S.exp(S.ln(v)).alias("back")).collect()
    with localcontext() as c:
        c.prec = 60
        near = lambda got, want: abs(Decimal(got) - want) <= Decimal("0.52") * Decimal(math.ulp(float(want)))
        assert all(near(r.e, (-Decimal(r.v)).exp()) for r in rows)
        assert all(near(r.back, Decimal(r.l).exp()) for r in rows)
        assert all(near(r.l, Decimal(r.v).ln()) for r in rows if abs(r.l) > 0.25)
    assert [r.l for r in spark.sql("select 0D v union all select 1D").select(S.ln("v").alias("l")).collect()] == [None, 0.0]
    assert [r.e for r in spark.sql("select 40D v union all select null union all select -800D").select(S.exp("v").alias("e")).collect()] == [pytest.approx(math.exp(40)), None, 0.0]


def test_clamped_sums_make_no_group_per_session(spark):
    from voxelloom.streaming.running import clamped_sum

    rows = [(s, i, i // 5, d) for s in (None, 1, 2) for i, d in enumerate([3.0, None, 4.0, -9.0, 1.0, 2.0, -1.0, 8.0, -2.0, None, 1.0, 1.5])]
    e = spark.createDataFrame(rows, "session long, at long, block int, d double")
    out = clamped_sum(e, "session", ["at"], "x", F.col("d"), -5.0, 5.0)
    assert "InPandas" not in plan(out)  # each group costs milliseconds, and a session was one
    want, x = {}, 0.0
    for s, i, _, d in rows:
        x = 0.0 if i == 0 else x
        want[s, i] = x = min(max(x + (d or 0.0), -5.0), 5.0)
    assert {(r.session, r.at): r.x for r in out.collect()} == want


def test_poses_go_to_the_matches(spark):
    """A join by image put all matches of one image in one task."""
    from voxelloom.operators import sfm

    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    poses = spark.createDataFrame([(0, one, [0.0, 0.0, 0.0]), (1, one, [-1.0, 0.0, 0.0])], sfm.POSE)
    coords = spark.createDataFrame([(0, 1, 7, 8, 0.0, 0.0, -0.2, 0.0), (0, 1, 9, 9, 0.0, 0.0, 0.2, 0.0)], "img_a int, img_b int, feat_a long, feat_b long, xa double, ya double, xb double, yb double")
    found = sfm.triangulate_pairs(coords, poses)
    assert "SortMergeJoin" not in plan(found) and plan(found).count("Broadcast") >= 2
    assert [(r.feat_a, r.feat_b, round(r.z, 9)) for r in found.collect()] == [(7, 8, 5.0)]  # the other one lies behind


def test_order_statistics_hold_no_value_by_value(spark):
    """Counting every distinct value first filled a task's memory with them."""
    from voxelloom.operators import cloud

    df = spark.range(4000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 4001 / 7.0).alias("v"))
    found = cloud.upper_median(df, ["g"], "v")
    grouped = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in line and "_v#" in line.split("]")[0]]
    assert grouped and all("_upto#" in line.split("]")[0] for line in grouped)  # only values inside the ranges asked for
    want = {g: sorted(r.v for r in df.where(F.col("g") == g).collect()) for g in range(3)}
    assert {r.g: r.median for r in found.collect()} == {g: v[len(v) // 2] for g, v in want.items()}


def test_models_meet_slices_of_a_group(spark):
    """One group's blocks were joined by its name alone, so they could all fall to one task."""
    import numpy as np

    from voxelloom.operators import consensus as C

    parts = spark.range(40).select(F.lit("a").alias("g"), F.col("id").alias("block"), *[F.array(F.col("id").cast("double")).alias(c) for c in C.TWO])
    models = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [2.0])], C.POSES)
    sums = C.over_blocks(parts, models, lambda xa, ya, xb, yb, m: m[:, 0] * xa.sum(), 2, C.TWO)
    assert "slice" in plan(sums)
    assert {r.i: r.v for r in sums.collect()} == {0: 780.0, 1: 1560.0}
    rng = np.random.default_rng(2)
    x, e = rng.normal(size=(4, 300)), rng.normal(size=(70, 9))
    want = np.stack([C.G.sampson(m.reshape(3, 3), x[:2].T, x[2:].T) < 0.05 for m in e])
    assert (C._sampson_inside(0.05)(*x, e) == want).all() and want.any() and not want.all()
    p, w = rng.normal(size=(70, 12)), rng.normal(size=(5, 300))
    want = np.stack([C.G.reprojection(m[:9].reshape(3, 3), m[9:], w[:2].T, w[2:].T) < 0.5 for m in p])
    assert (C._pose_inside(0.5)(*w, p) == want).all() and want.any() and not want.all()


def test_small_images_share_a_frame():
    """A frame an image cost a batch on the way to the JVM each; a large one is cut."""
    import numpy as np

    from voxelloom.sources import files as S

    parts = [{"image_id": i, "x": np.arange(n)} for i, n in enumerate([5] * 1000 + [S.ROWS * 2 + 3])]
    frames = list(S.gathered(iter(parts)))
    assert len(frames) <= 4 and max(map(len, frames)) < 2 * S.ROWS + 5
    assert [tuple(r) for f in frames for r in f.to_numpy()] == [(p["image_id"], k) for p in parts for k in p["x"]]
