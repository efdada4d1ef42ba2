"""Projection, splat-to-pixel expansion and compositing.

The splat x pixel relation is generated from each splat's screen box and cut by the falloff before any
exchange; pixels are partitioned by key, and transmittance is a product over a window, so a pixel's
blending is one sort. Rows after a pixel saturates are dropped by the same monotone product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.functions import splat as S
from voxelloom.functions.camera import Camera

SATURATED = 0.004
XYZ = ("x", "y", "z")


def _computed(df: DataFrame, *cols) -> DataFrame:
    """The columns, computed here: filters on them are not rewritten into filters on their definitions.

    Pushing a filter on a derived ellipse below its projection would repeat the whole derivation at each
    of its uses, which grows without bound; a one-row generator stops that and stays in code generation.
    """
    return df.select(F.explode(F.array(F.struct(*cols))).alias("_c")).select("_c.*")


def _camera_space(df: DataFrame, camera: Camera) -> DataFrame:
    r, t = camera.view()
    c = S.transform_point(r.tolist(), t.tolist(), [F.col(a) for a in XYZ])
    # Image x runs right and y down, as pixel rows do.
    return df.withColumns({"cam_x": c[0], "cam_y": -c[1], "depth": -c[2]})


def project(splats: DataFrame, camera: Camera) -> DataFrame:
    """Canonical splats to screen ellipses: J W C W^T J^T with 0.3 added on the diagonal."""
    df = _camera_space(splats, camera).where((F.col("depth") > camera.near) & (F.col("depth") < camera.far))
    cov = S.covariance([F.exp(f"scale_{a}") for a in XYZ], S.unit_quaternion())
    df = df.withColumns(cov)
    r = camera.view()[0].tolist()
    r[1] = [-v for v in r[1]]
    r[2] = [-v for v in r[2]]
    c = [[F.col("c00"), F.col("c01"), F.col("c02")], [F.col("c01"), F.col("c11"), F.col("c12")], [F.col("c02"), F.col("c12"), F.col("c22")]]
    w = {(i, j): sum(float(r[i][k] * r[j][m]) * c[k][m] for k in range(3) for m in range(3)) for i in range(3) for j in range(i, 3)}
    df = df.withColumns({f"w{i}{j}": e for (i, j), e in w.items()})
    f, z = camera.focal, F.col("depth")
    a, bx, by = f / z, -f * F.col("cam_x") / (z * z), -f * F.col("cam_y") / (z * z)
    df = df.withColumns({
        "screen_x": f * F.col("cam_x") / z + camera.cx, "screen_y": f * F.col("cam_y") / z + camera.cy,
        "cov00": a * a * F.col("w00") + 2 * a * bx * F.col("w02") + bx * bx * F.col("w22") + 0.3,
        "cov01": a * a * F.col("w01") + a * by * F.col("w02") + bx * a * F.col("w12") + bx * by * F.col("w22"),
        "cov11": a * a * F.col("w11") + 2 * a * by * F.col("w12") + by * by * F.col("w22") + 0.3,
    })
    colours = [S.clamp(S.sh_to_rgb(f"sh_dc_{k}"), 0.0, 1.0).alias(k) for k in "rgb"]
    return _computed(df, "splat_id", "screen_x", "screen_y", "depth", "cov00", "cov01", "cov11", *colours, S.sigmoid("opacity_logit").alias("opacity"))


def _radius():
    det = F.col("cov00") * F.col("cov11") - F.col("cov01") * F.col("cov01")
    mid = 0.5 * (F.col("cov00") + F.col("cov11"))
    return 3.0 * F.sqrt(mid + F.sqrt(F.greatest(F.lit(0.1), mid * mid - det)))


def visible(projected: DataFrame, width: int, height: int) -> DataFrame:
    """Opaque enough, a proper ellipse, and touching the screen."""
    det = F.col("cov00") * F.col("cov11") - F.col("cov01") * F.col("cov01")
    r = _radius()
    on = (F.col("screen_x") + r >= 0) & (F.col("screen_x") - r < width) & (F.col("screen_y") + r >= 0) & (F.col("screen_y") - r < height)
    return projected.where((F.col("opacity") >= 1.0 / 255.0) & (det > 0) & on)


def screen_box(projected: DataFrame, width: int, height: int) -> DataFrame:
    """Adds the clamped integer box of three deviations along the longest axis."""
    r, edge = _radius(), 1e6
    place = lambda c: S.clamp(c, -edge, edge).cast("int")
    return projected.withColumns({
        "min_x": F.greatest(F.lit(0), place(F.col("screen_x") - r)), "min_y": F.greatest(F.lit(0), place(F.col("screen_y") - r)),
        "max_x": F.least(F.lit(width - 1), place(F.col("screen_x") + r)), "max_y": F.least(F.lit(height - 1), place(F.col("screen_y") + r)),
    })


def splat_pixels(projected: DataFrame, width: int, height: int) -> DataFrame:
    """One row per splat and pixel that it colours: alpha of at least 1/255 within the falloff, at most 0.99."""
    b = screen_box(visible(projected, width, height), width, height).where("min_x <= max_x and min_y <= max_y")
    return fragments(b.withColumn("y", F.explode(F.sequence("min_y", "max_y"))).withColumn("x", F.explode(F.sequence("min_x", "max_x"))))


def fragments(b: DataFrame) -> DataFrame:
    """What ellipses with a pixel (x, y) beside them colour there."""
    det = F.col("cov00") * F.col("cov11") - F.col("cov01") * F.col("cov01")
    dx, dy = F.col("x") + 0.5 - F.col("screen_x"), F.col("y") + 0.5 - F.col("screen_y")
    power = -0.5 * (F.col("cov11") * dx * dx - 2 * F.col("cov01") * dx * dy + F.col("cov00") * dy * dy) / det
    p = _computed(b, "splat_id", "x", "y", "depth", *"rgb", "opacity", power.alias("power")).where("power <= 0 and power >= -4")
    p = p.withColumn("alpha", F.least(F.lit(0.99), F.col("opacity") * F.exp("power")))
    return p.where(F.col("alpha") >= 1.0 / 255.0).drop("power", "opacity")


def composite(pixels: DataFrame) -> DataFrame:
    """Front-to-back blending per pixel: r, g, b and coverage a in 0..1, skipping what lies behind saturation."""
    before = Window.partitionBy("x", "y").orderBy("depth", "splat_id").rowsBetween(Window.unboundedPreceding, -1)
    t = pixels.withColumn("t", F.coalesce(F.product(1.0 - F.col("alpha")).over(before), F.lit(1.0))).where(F.col("t") >= SATURATED)
    return t.groupBy("x", "y").agg(*[F.sum(F.col("alpha") * F.col("t") * F.col(c)).alias(c) for c in "rgb"], (1.0 - F.min(F.col("t") * (1.0 - F.col("alpha")))).alias("a"))


def blend_back_to_front(pixels: DataFrame) -> DataFrame:
    """Source-over blending in drawing order, farthest first: each colour is dimmed by what is drawn after it."""
    after = Window.partitionBy("x", "y").orderBy("depth", "splat_id").rowsBetween(Window.unboundedPreceding, -1)
    t = pixels.where("alpha >= 0.002").withColumn("t", F.coalesce(F.product(1.0 - F.col("alpha")).over(after), F.lit(1.0)))
    return t.groupBy("x", "y").agg(*[F.sum(F.col("alpha") * F.col("t") * F.col(c)).alias(c) for c in "rgb"], (1.0 - F.min(F.col("t") * (1.0 - F.col("alpha")))).alias("a"))


def to_bytes(image: DataFrame) -> DataFrame:
    return image.select("x", "y", *[S.trunc(S.clamp(F.col(c) * 255.0, 0.0, 255.0)).alias(c) for c in "rgba"])


def render(splats: DataFrame, camera: Camera) -> DataFrame:
    """Canonical splats to the lit pixels of a frame, as bytes."""
    return to_bytes(composite(splat_pixels(project(splats, camera), camera.width, camera.height)))


def trainer_project(splats: DataFrame, camera: Camera) -> DataFrame:
    """The trainer's isotropic ellipses and colours by sigmoid, between depths 0.1 and 100."""
    df = _camera_space(splats, camera).where((F.col("depth") > 0.1) & (F.col("depth") < 100.0))
    s = camera.focal * sum(F.exp(f"scale_{a}") for a in XYZ) / 3.0 / F.col("depth")
    cov = s * s + 0.3
    return _computed(
        df, "splat_id", (camera.focal * F.col("cam_x") / F.col("depth") + camera.cx).alias("screen_x"), (camera.focal * F.col("cam_y") / F.col("depth") + camera.cy).alias("screen_y"),
        "depth", cov.alias("cov00"), F.lit(0.0).alias("cov01"), cov.alias("cov11"), *[S.sigmoid(f"sh_dc_{k}").alias(k) for k in "rgb"], S.sigmoid("opacity_logit").alias("opacity"),
    )


def nearest_points(points: DataFrame, camera: Camera) -> DataFrame:
    """Colour of the nearest point per pixel: a depth test by ``min_by``."""
    p = _camera_space(points, camera).where((F.col("depth") > camera.near) & (F.col("depth") < camera.far))
    p = p.withColumns({"sx": camera.focal * F.col("cam_x") / F.col("depth") + camera.cx, "sy": camera.focal * F.col("cam_y") / F.col("depth") + camera.cy})
    p = p.where((F.col("sx") >= 0) & (F.col("sx") < camera.width) & (F.col("sy") >= 0) & (F.col("sy") < camera.height))
    best = F.min(F.struct("depth", "point_id"))
    return p.groupBy(F.col("sx").cast("int").alias("x"), F.col("sy").cast("int").alias("y")).agg(best.alias("m"), F.count("*").alias("n")).select("x", "y", "m.point_id", "m.depth", "n")
