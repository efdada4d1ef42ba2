"""Training lowers the loss; compositing is monotone and independent of partitioning."""

from pyspark.sql import functions as F

from voxelloom.functions.camera import Camera
from voxelloom.operators import raster as R
from voxelloom.operators import train as T
from voxelloom.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def test_loss_falls(spark):
    c = Camera.default(24, 16, position=(0.0, 0.0, 0.0), forward=(0.0, 0.0, 1.0))
    pts = X.part_points(spark, SF).where("point_id < 40")
    target = R.composite(R.splat_pixels(R.trainer_project(T.initialise(pts).withColumn("sh_dc_r", F.lit(1.5)), c), 24, 16))
    grid = spark.range(24 * 16).select((F.col("id") % 24).cast("int").alias("x"), F.expr("cast(id div 24 as int)").alias("y"))
    target = grid.join(target, ["x", "y"], "left").select("x", "y", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in "rgb"])
    _, losses = T.train(pts, target, c, iterations=4, batch=None)
    assert losses[-1] < losses[0]


def test_compositing(spark):
    p = R.splat_pixels(R.project(X.splats(spark, SF), X.CAMERA), 64, 48).persist()
    a, b = R.composite(p.repartition(1)), R.composite(p.repartition(7))
    rounded = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.select("x", "y", "r", "g", "b", "a").collect())
    assert rounded(a) == rounded(b)
    assert a.where("a < 0 or a > 1").count() == 0
    assert R.composite(p.limit(0)).count() == 0
