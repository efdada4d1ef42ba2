"""Training of splats by sign steps: every iteration is one plan, cut by a written table every few."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.functions import splat as S
from voxelloom.functions.camera import Camera
from voxelloom.operators import raster
from voxelloom.operators.cloud import mean_nearest
from voxelloom.session import written

# Steps of colour, opacity and scale, and the limits of the adaptive control.
COLOUR_STEP, OPACITY_STEP, SCALE_STEP = 0.005, 0.001, 0.0005
PRUNE, SPLIT, CAP, EVERY, BATCH = 0.01, 0.1, 5000, 50, 50


def initialise(points: DataFrame) -> DataFrame:
    """Points to splats of half the mean nearest distance, nearly opaque."""
    s = mean_nearest(points).select(F.ln(F.col("mean_nn") * 0.5).alias("s"))
    j = points.crossJoin(F.broadcast(s))  # one row
    return j.select(
        F.col("point_id").alias("splat_id"), "x", "y", "z", *[F.col("s").alias(f"scale_{a}") for a in "xyz"], F.lit(1.0).alias("rot_w"), *[F.lit(0.0).alias(f"rot_{a}") for a in "xyz"],
        F.lit(2.0).alias("opacity_logit"), *[((F.col(c) - 0.5) * 2.0).alias(f"sh_dc_{c}") for c in "rgb"],
    )


def l1(rendered: DataFrame, target: DataFrame) -> DataFrame:
    """Mean absolute difference over three channels; unlit pixels are black. One row."""
    t = target.select("x", "y", *[F.col(c).alias(f"t{c}") for c in "rgb"])
    d = sum(F.abs(F.coalesce(F.col(c), F.lit(0.0)) - F.col(f"t{c}")) for c in "rgb")
    return t.join(rendered, ["x", "y"], "left").agg((F.avg(d) / 3).alias("loss"))


def update(splats: DataFrame, rendered: DataFrame, target: DataFrame, camera: Camera, chosen=None) -> DataFrame:
    """One step of the chosen splats (a condition; all by default) from the error at their own pixel."""
    r, t = camera.view()
    c = S.transform_point(r.tolist(), t.tolist(), [F.col(a) for a in "xyz"])
    depth = -c[2]
    on = (depth > 0.1) & (F.lit(True) if chosen is None else chosen)
    place = lambda v, most: S.clamp(F.when(on, v), 0.0, float(most)).cast("int")
    z = F.when(depth > 0.1, depth)
    s = splats.withColumns({"px": place(camera.focal * c[0] / z + camera.cx, camera.width - 1), "py": place(camera.focal * -c[1] / z + camera.cy, camera.height - 1)})
    px = target.select(F.col("x").alias("px"), F.col("y").alias("py"), *[F.col(k).alias(f"t{k}") for k in "rgb"])
    lit = rendered.select(F.col("x").alias("px"), F.col("y").alias("py"), *[F.col(k).alias(f"o{k}") for k in "rgb"])
    s = s.join(px.join(lit, ["px", "py"], "left"), ["px", "py"], "left")
    err = {k: F.when(F.col(f"t{k}").isNull(), 0.0).otherwise(F.coalesce(F.col(f"o{k}"), F.lit(0.0)) - F.col(f"t{k}")) for k in "rgb"}
    total = sum(F.abs(e) for e in err.values())
    return s.withColumn("err", total).withColumns({
        **{f"sh_dc_{k}": F.col(f"sh_dc_{k}") - F.signum(e) * COLOUR_STEP for k, e in err.items()},
        "opacity_logit": F.col("opacity_logit") + F.when(F.col("err") > 0.5, OPACITY_STEP).otherwise(0.0),
        **{f"scale_{a}": F.col(f"scale_{a}") - F.when(F.col("err") > 0.3, SCALE_STEP).otherwise(0.0) for a in "xyz"},
    }).select(*splats.columns)


def prune(splats: DataFrame) -> DataFrame:
    return splats.where(S.sigmoid("opacity_logit") >= PRUNE)


def adapt(splats: DataFrame, cap: int = CAP) -> DataFrame:
    """Prunes, then splits splats of mean scale over 0.1, by splat_id, while fewer than ``cap`` remain.

    The first child keeps the id; the second gets one above all ids. How many may split is a count; which
    are among the first is a running number over the large ones only, at most ``cap`` of them.
    """
    kept = prune(splats).withColumn("mean", (F.exp("scale_x") + F.exp("scale_y") + F.exp("scale_z")) / 3.0)
    size = kept.agg(F.count("*").alias("n"), F.max("splat_id").alias("top"))
    first = kept.where(F.col("mean") > SPLIT).select("splat_id").orderBy("splat_id").limit(cap).withColumn("i", F.row_number().over(Window.orderBy("splat_id")))
    splitting = first.crossJoin(F.broadcast(size)).where(F.col("i") <= cap - F.col("n")).select("splat_id", "i", "top")  # size: one row
    j = kept.join(splitting, "splat_id", "left")
    sides = F.when(F.col("i").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(-1)))
    j = j.withColumn("side", F.explode(sides))
    small = F.ln(F.col("mean") * 0.5)
    return j.withColumns({
        "x": F.col("x") + F.col("side") * F.col("mean") * 0.5,
        "splat_id": F.when(F.col("side") == -1, F.col("top") + F.col("i")).otherwise(F.col("splat_id")),
        **{f"scale_{a}": F.when(F.col("side") == 0, F.col(f"scale_{a}")).otherwise(small) for a in "xyz"},
    }).select(*splats.columns)


def render(splats: DataFrame, camera: Camera) -> DataFrame:
    """The trainer's forward pass: colours 0..1 per lit pixel."""
    return raster.composite(raster.splat_pixels(raster.trainer_project(splats, camera), camera.width, camera.height))


def train(points: DataFrame, target: DataFrame, camera: Camera, iterations: int = 100, every: int = EVERY, batch: int | None = BATCH, seed: int = 5) -> tuple[DataFrame, list[float]]:
    """Trained splats and the loss of each iteration. ``batch``: splats updated per iteration, drawn by hash."""
    splats, losses = written(initialise(points), "train"), []
    target = written(target, "train-target")
    for i in range(iterations):
        lit = written(render(splats, camera), "train-lit")
        losses.append(l1(lit, target).first()["loss"])
        chosen = None
        if batch is not None:
            n = splats.count()
            chosen = F.pmod(F.xxhash64("splat_id", F.lit(seed), F.lit(i)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, batch / max(n, 1)))
        splats = update(splats, lit, target, camera, chosen)
        if (i + 1) % every == 0:
            splats = adapt(splats)
        splats = written(splats, "train")
    return splats, losses


def to_scene(trained: DataFrame) -> DataFrame:
    """Trained to canonical splats: the sigmoid colour becomes a harmonic coefficient."""
    return trained.withColumns({f"sh_dc_{c}": S.rgb_to_sh(S.sigmoid(f"sh_dc_{c}")) for c in "rgb"})
