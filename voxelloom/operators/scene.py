"""Scenes: bounds, camera fits, culling, depth sorting and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions import splat as S
from voxelloom.functions.camera import Camera

XYZ = ("x", "y", "z")


def pack10(splats: DataFrame) -> DataFrame:
    """Canonical splats to position, clamped colour, linear scale and opacity."""
    return splats.select(
        "splat_id", *XYZ,
        *[S.clamp(S.sh_to_rgb(f"sh_dc_{c}"), 0.0, 1.0).alias(c) for c in "rgb"],
        *[S.exp(f"scale_{a}").alias(f"scale_{a}") for a in XYZ], S.sigmoid("opacity_logit").alias("opacity"),
    )


def make_splats(points: DataFrame, scale: float, opacity: float) -> DataFrame:
    """Points (point_id, x, y, z, r, g, b) to isotropic canonical splats; missing colours are grey."""
    colours = [S.rgb_to_sh(F.coalesce(F.col(c).cast("double"), F.lit(0.5))).alias(f"sh_dc_{c}") for c in "rgb"]
    return points.select(
        F.col("point_id").alias("splat_id"), *XYZ, *[F.ln(F.lit(scale)).alias(f"scale_{a}") for a in XYZ],
        F.lit(1.0).alias("rot_w"), *[F.lit(0.0).alias(f"rot_{a}") for a in XYZ], S.logit(F.lit(opacity)).alias("opacity_logit"), *colours,
    )


def bounds(points: DataFrame) -> DataFrame:
    """Minimum, maximum, centre and extent (half the diagonal, 1 if below 0.001): one row, zeros if empty."""
    one = points.agg(*[f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in XYZ])
    one = one.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in one.columns])
    half = F.sqrt(sum((F.col(f"max_{a}") - F.col(f"min_{a}")) * (F.col(f"max_{a}") - F.col(f"min_{a}")) for a in XYZ)) / 2
    return one.select("*", *[((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2).alias(f"centre_{a}") for a in XYZ], F.when(half < 0.001, 1.0).otherwise(half).alias("extent"))


def drop_sentinels(points: DataFrame) -> DataFrame:
    """Without rows parked at the far sentinel position."""
    return points.where(F.col("x") >= -999990.0)


def fit_camera(points: DataFrame, width: int, height: int, depth_scene: bool = False) -> DataFrame:
    """Position, forward and focal length of a camera that sees the scene; one row."""
    f = 1.2 * max(width, height)
    sin = __import__("math").sin(Camera.default(width, height).fov_y() / 2)
    if depth_scene:
        return points.agg(F.count("*").alias("n")).select(*[F.lit(v).alias(k) for k, v in (("pos_x", 0.0), ("pos_y", 0.0), ("pos_z", 0.0), ("fwd_z", 1.0), ("focal", f))])
    b = bounds(drop_sentinels(points))
    d = F.greatest(F.col("extent") / sin, F.lit(0.5))
    return b.select(F.col("centre_x").alias("pos_x"), F.col("centre_y").alias("pos_y"), (F.col("centre_z") - d).alias("pos_z"), F.lit(1.0).alias("fwd_z"), F.lit(f).alias("focal"))


def fit_controls(points: DataFrame, width: int, height: int) -> DataFrame:
    """The fitted camera with yaw, pitch and move speed."""
    b = bounds(drop_sentinels(points)).select("extent")
    c = fit_camera(points, width, height).crossJoin(F.broadcast(b))  # one row each
    return c.select("pos_x", "pos_y", "pos_z", F.atan2(F.lit(0.0), -F.col("fwd_z")).alias("yaw"), F.asin(F.lit(0.0)).alias("pitch"), F.greatest(F.col("extent") * 0.05, F.lit(0.1)).alias("move_speed"))


def in_frustum(planes, scale: str = "scale_x") -> Column:
    """Visible, and within three scales of the inner side of every plane."""
    keep = F.col("opacity") > 0
    for a, b, c, d in planes:
        keep = keep & (float(a) * F.col("x") + float(b) * F.col("y") + float(c) * F.col("z") + float(d) >= -3.0 * F.col(scale))
    return keep


def view_distance(camera: Camera) -> Column:
    return sum((F.col(a) - float(p)) * float(f) for a, p, f in zip(XYZ, camera.position, camera.forward))


def sort_splats(packed: DataFrame, camera: Camera, bits: int = 32) -> DataFrame:
    """Visible splats with their depth key, farthest first; ties by splat_id. Culled rows are left out."""
    kept = packed.where(in_frustum(camera.planes())).withColumn("key", S.depth_key(F.greatest(view_distance(camera), F.lit(0.0)), bits))
    return kept.orderBy(F.desc("key"), "splat_id")


def clip_splats(packed: DataFrame, camera: Camera) -> DataFrame:
    """Clip-space centre, NDC and pixel radii of splats that can touch the screen."""
    m, p = camera.mvp(), [F.col(a) for a in XYZ]
    clip = [sum(float(m[i][j]) * p[j] for j in range(3)) + float(m[i][3]) for i in range(4)]
    c = packed.select("splat_id", "opacity", *"rgb", "scale_x", "scale_y", *[e.alias(f"clip_{k}") for e, k in zip(clip, "xyzw")]).where("clip_w > 0.001")
    radius = {k: F.greatest(F.greatest(F.col(f"scale_{k}"), F.lit(0.001)) * camera.focal / F.col("clip_w"), F.lit(0.8)) for k in "xy"}
    c = c.select("splat_id", "opacity", *"rgb", *[(F.col(f"clip_{k}") / F.col("clip_w")).alias(f"ndc_{k}") for k in XYZ], *[v.alias(f"radius_{k}") for k, v in radius.items()])
    reach = 3.0 * F.greatest(F.col("radius_x") * 2.0 / camera.width, F.col("radius_y") * 2.0 / camera.height)
    on = F.lit(True)
    for k in "xy":
        on = on & (F.col(f"ndc_{k}") + reach >= -1.0) & (F.col(f"ndc_{k}") - reach <= 1.0)
    return c.where(on & F.col("ndc_z").between(-0.1, 1.1))


def cloud_vertices(points: DataFrame, size: float = 0.01) -> DataFrame:
    """Six billboard vertices per point, the cloud centred and scaled by its largest extent."""
    b = bounds(points).select(*[f"centre_{a}" for a in XYZ], F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in XYZ], F.lit(0.01)).alias("span"))
    corners = F.array(*[F.struct(F.lit(i).alias("corner"), F.lit(u).alias("u"), F.lit(v).alias("v")) for i, (u, v) in enumerate(((-1.0, -1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, 1.0), (1.0, -1.0), (1.0, 1.0)))])
    j = points.crossJoin(F.broadcast(b))  # one row
    return j.select("point_id", *[((F.col(a) - F.col(f"centre_{a}")) / F.col("span")).alias(a) for a in XYZ], F.explode(corners).alias("o")).select("point_id", *XYZ, "o.corner", (F.col("o.u") * size).alias("u"), (F.col("o.v") * size).alias("v"))
