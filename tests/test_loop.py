"""The render loop: a change draws again only what it touches, and the frame is that of the whole scene."""

import pytest
from pyspark.sql import functions as F

from voxelloom.operators import loop as L
from voxelloom.operators import raster as R
from voxelloom.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def frame(df):
    return {(r.x, r.y): tuple(round(v, 9) for v in (r.r, r.g, r.b, r.a)) for r in df.collect()}


def whole(scene):
    c = X.CAMERA
    return frame(R.composite(R.splat_pixels(R.project(scene, c), c.width, c.height)))


@pytest.mark.parametrize("tile", [7, 16])
def test_changes(spark, tile):
    scene = X.splats(spark, SF)
    loop = L.RenderLoop(X.CAMERA, tile)
    assert loop.show(None) is None and loop.show(scene.limit(0)) is None and loop.change(gone=scene.select("splat_id")) is None
    assert frame(loop.show(scene)) == whole(scene)
    one = scene.where("splat_id = 5").withColumn("x", F.col("x") + 0.4)
    now = scene.where("splat_id <> 5").unionByName(one)
    assert frame(loop.change(one)) == whole(now)
    assert loop.composited[1] < loop.composited[0]  # a part of the rows
    assert loop.change() is loop.frame and loop.look(X.CAMERA) is loop.frame and len(loop.composited) == 2
    new = scene.where("splat_id in (7, 8)").withColumn("splat_id", F.col("splat_id") + 10_000).withColumn("y", -F.col("y"))
    now = now.where("splat_id <> 9").unionByName(new)
    assert frame(loop.change(new, spark.createDataFrame([(9,), (123456,)], "splat_id long"))) == whole(now)
    assert frame(loop.change(gone=now.select("splat_id"))) == {}
