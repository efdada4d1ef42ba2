"""Photo and depth-map operators: pixel tables in, splat or pixel tables out.

Pixel tables have image_id, x, y and channels; sizes are columns of a one-row-per-image table or given.
Per-image minima and maxima are one aggregate, joined back by image; with one image that join is a
broadcast of one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions import splat as S


def min_max(depth: DataFrame) -> DataFrame:
    """image_id, dmin, dmax over positive depths; (0, 1) where there is no range, and a zero maximum is 1."""
    a = depth.groupBy("image_id").agg(F.min(F.when(F.col("d") > 0, F.col("d"))).alias("lo"), F.max(F.when(F.col("d") > 0, F.col("d"))).alias("hi"))
    bad = F.col("lo").isNull() | (F.col("lo") >= F.col("hi"))
    high = F.when(bad, 1.0).otherwise(F.when(F.col("hi") == 0, 1.0).otherwise(F.col("hi")))
    return a.select("image_id", F.when(bad, 0.0).otherwise(F.col("lo")).alias("dmin"), high.alias("dmax"))


def normalised(depth: DataFrame) -> DataFrame:
    """Adds n = (d - min) / range, zero without a range."""
    span = F.col("dmax") - F.col("dmin")
    return depth.join(min_max(depth), "image_id").withColumn("n", F.when(span > 1e-6, (F.col("d") - F.col("dmin")) / F.when(span > 1e-6, span)).otherwise(0.0)).drop("dmin", "dmax")


def subsampled(df: DataFrame, step: int, width: int, height: int) -> DataFrame:
    """Pixels on the grid of every ``step``-th column and row that lies wholly inside."""
    x, y = F.col("x"), F.col("y")
    return df.where((x % step == 0) & (y % step == 0) & (F.floor(x / step) < width // step) & (F.floor(y / step) < height // step))


def valid_depth(df: DataFrame) -> DataFrame:
    """n of at least 0.01 whose distance 1 / (n + 0.01) lies between 0.01 and 100."""
    d = 1.0 / (F.col("n") + 0.01)
    return df.where(F.col("n") >= 0.01).where((d > 0.01) & (d < 100.0))


def edge_faces(depth: DataFrame, step: int, edge: float, width: int, height: int) -> DataFrame:
    """Adds n of the right and lower neighbour (``step`` away, clamped to the image) and whether the jump is an edge."""
    other = depth.select("image_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("n").alias("nn"))
    right = F.least(F.col("x") + step, F.lit(width - 1))
    below = F.least(F.col("y") + step, F.lit(height - 1))
    a = depth.withColumn("rx", right).join(other.withColumnsRenamed({"nx": "rx", "ny": "y", "nn": "n_right"}), ["image_id", "rx", "y"], "left").drop("rx")
    b = a.withColumn("by", below).join(other.withColumnsRenamed({"nx": "x", "ny": "by", "nn": "n_below"}), ["image_id", "x", "by"], "left").drop("by")
    jump = F.greatest(F.abs(F.col("n") - F.coalesce("n_right", "n")), F.abs(F.col("n") - F.coalesce("n_below", "n")))
    return b.withColumn("gradient", jump).withColumn("is_edge", jump > edge)


def unproject(df: DataFrame, step: int, width: int, height: int) -> DataFrame:
    """Packed splats of pixels with n and colours r, g, b: the depth axis is +z, x and y are mirrored."""
    f = 1.2 * max(width, height)
    d = 1.0 / (F.col("n") + 0.01)
    s = F.greatest(d * float(step) / f, F.lit(0.001))
    colours = [(F.col(c) / 255.0).alias(c) for c in "rgb"]
    return df.select(
        "image_id", (F.col("y") * width + F.col("x")).cast("long").alias("splat_id"),
        (-(F.col("x") - width / 2) * d / f + 0.0).alias("px"), (-(F.col("y") - height / 2) * d / f + 0.0).alias("py"), d.alias("pz"),
        *colours, s.alias("scale_x"), s.alias("scale_y"), (s * 0.5).alias("scale_z"), F.lit(0.9).alias("opacity"),
    )


def depth_to_splats(depth: DataFrame, pixels: DataFrame, width: int, height: int, step: int = 2, edge: float | None = None) -> DataFrame:
    """Depth map and photo to packed splats. ``edge`` drops pixels whose depth jumps by more."""
    n = normalised(depth)
    if edge is not None:
        n = edge_faces(n, step, edge, width, height).where(~F.col("is_edge"))
    kept = valid_depth(subsampled(n, step, width, height))
    return unproject(kept.join(pixels, ["image_id", "x", "y"]), step, width, height)


def grid(spark, width: int, height: int) -> DataFrame:
    """x, y of every pixel of an image, made on the executors."""
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))


def resize_nearest(df: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Target pixel x, y takes source pixel x * sw div dw, y * sh div dh."""
    (sw, sh), (dw, dh) = source, target
    g = grid(df.sparkSession, dw, dh).select("x", "y", F.floor(F.col("x") * sw / dw).cast("int").alias("sx"), F.floor(F.col("y") * sh / dh).cast("int").alias("sy"))
    return g.join(df.withColumnsRenamed({"x": "sx", "y": "sy"}), ["sx", "sy"]).drop("sx", "sy")


def downsample_gray(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Nearest source pixel by truncated scaled coordinates, as grey."""
    (sw, sh), (dw, dh) = source, target
    g = grid(pixels.sparkSession, dw, dh)
    sx = F.least((F.col("x") * F.lit(sw / dw)).cast("int"), F.lit(sw - 1))
    sy = F.least((F.col("y") * F.lit(sh / dh)).cast("int"), F.lit(sh - 1))
    g = g.select("x", "y", sx.alias("sx"), sy.alias("sy"))
    return g.join(pixels.withColumnsRenamed({"x": "sx", "y": "sy"}), ["sx", "sy"]).select("image_id", "x", "y", S.gray().alias("v"))


def to_tensor(pixels: DataFrame, standardise: bool) -> DataFrame:
    """image_id, c, x, y, v: planar channels over 0..1, or standardised for the depth model."""
    mean, std = (F.array(*[F.lit(v) for v in t]) for t in (S.MEAN, S.STD))
    t = pixels.select("image_id", "x", "y", F.posexplode(F.array("r", "g", "b")).alias("c", "raw"))
    v = F.col("raw") / 255.0
    return t.select("image_id", "c", "x", "y", ((v - mean[F.col("c")]) / std[F.col("c")] if standardise else v).alias("v"))


def from_tensor(tensor: DataFrame) -> DataFrame:
    """Pixels of a planar tensor: clamped, rounded half up, opaque."""
    byte = S.trunc(S.clamp(F.col("v"), 0.0, 1.0) * 255.0 + 0.5)
    one = [F.max(F.when(F.col("c") == i, byte)).alias(k) for i, k in enumerate("rgb")]
    return tensor.groupBy("image_id", "x", "y").agg(*one).withColumn("a", F.lit(255))


def colorize(depth: DataFrame) -> DataFrame:
    """Turbo colours, near depths at the warm end."""
    span = F.col("dmax") - F.col("dmin")
    t = S.clamp(1.0 - F.when(span > 1e-6, (F.col("d") - F.col("dmin")) / F.when(span > 1e-6, span)).otherwise(0.0), 0.0, 1.0)
    c = depth.join(min_max(depth), "image_id").select("image_id", "x", "y", t.alias("t"))
    return c.select("image_id", "x", "y", *[v.alias(k) for k, v in S.turbo(F.col("t")).items()])


def first_image(splats: DataFrame) -> DataFrame:
    """Splats of the first image that has any: the mode in which later images are not used."""
    first = splats.agg(F.min("image_id").alias("image_id"))
    return splats.join(F.broadcast(first), "image_id")  # one row


PRESETS = [("fast", 4, 0.0, False, 1, 16), ("standard", 2, 0.3, False, 1, 16), ("high", 1, 0.3, True, 2, 32)]


def presets(spark) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, subsample int, edge double, use_sr boolean, sr_scale int, sort_bits int")


def with_preset(images: DataFrame) -> DataFrame:
    """Images (with a column preset) and the settings of their presets."""
    return images.join(F.broadcast(presets(images.sparkSession)), "preset")  # three rows


def pending(images: DataFrame, done: DataFrame) -> DataFrame:
    """Images without a result."""
    return images.join(done, "image_id", "left_anti")


def super_or_original(images: DataFrame, upscaled: DataFrame, preset: str, loaded: bool) -> DataFrame:
    """The upscaled pixels under the high preset with a loaded model, else the original."""
    up = upscaled.select("image_id", F.col("data").alias("up"))
    use = F.lit(preset == "high" and loaded)
    return images.join(up, "image_id", "left").select("image_id", F.when(use, F.coalesce("up", "data")).otherwise(F.col("data")).alias("data"))


def neighbours8(values: DataFrame, width: int, height: int) -> DataFrame:
    """x, y, dx, dy, v of the 3 x 3 surroundings, clamped to the image."""
    near = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    keys = [c for c in values.columns if c not in ("x", "y")]
    # The pixel read by target (x, y) at offset o is clamp(x + dx, y + dy).
    want = values.select("x", "y").select("x", "y", F.explode(near).alias("o")).select(
        "x", "y", "o", F.least(F.greatest(F.col("x") + F.col("o.dx"), F.lit(0)), F.lit(width - 1)).alias("sx"), F.least(F.greatest(F.col("y") + F.col("o.dy"), F.lit(0)), F.lit(height - 1)).alias("sy"))
    # Spark sizes ``want`` as if it were not exploded, and would broadcast nine rows a pixel of a small table.
    return want.join(values.withColumnsRenamed({"x": "sx", "y": "sy"}).hint("merge"), ["sx", "sy"]).select("x", "y", "o.dx", "o.dy", *keys)


def surround_stats(values: DataFrame, width: int, height: int) -> DataFrame:
    """x, y, c (centre), mn, mx, avg over the eight neighbours: cross neighbours weigh twice the diagonals."""
    n = neighbours8(values, width, height)
    centre = (F.col("dx") == 0) & (F.col("dy") == 0)
    weight = F.when((F.col("dx") == 0) | (F.col("dy") == 0), 0.166666).otherwise(0.083333)
    return n.groupBy("x", "y").agg(
        F.max(F.when(centre, F.col("v"))).alias("c"), F.min(F.when(~centre, F.col("v"))).alias("mn"),
        F.max(F.when(~centre, F.col("v"))).alias("mx"), F.sum(F.when(~centre, F.col("v") * weight)).alias("avg"),
    )


def sharpen(values: DataFrame, width: int, height: int, strength: float = 0.5) -> DataFrame:
    """Contrast-adaptive sharpening of one channel in 0..1; the strength counts twice."""
    s = surround_stats(values, width, height)
    amp = F.when(F.col("mx") > 0, S.clamp(F.least(F.col("mn"), 2.0 - F.col("mx")) / F.when(F.col("mx") > 0, F.col("mx")), 0.0, 1.0)).otherwise(0.0)
    return s.select("x", "y", S.clamp(F.col("c") + (F.col("c") - F.col("avg")) * amp * strength * strength, 0.0, 1.0).alias("v"))

