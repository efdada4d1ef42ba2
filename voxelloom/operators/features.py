"""Corners and binary descriptors on grey pixel tables (image_id, x, y, v).

The segment test starts with the cheap compass test: each pixel is sent to the four centres that read it.
Its survivors alone then ask for the sixteen pixels of their circle by an equi-join.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The circle of radius 3 in order, from the top clockwise.
CIRCLE = [(0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3)]
COMPASS = (0, 4, 8, 12)
THRESHOLD, MARGIN, CELL, MOST = 25, 4, 8, 2000
ARC = 9


def circle(x: str, y: str) -> Column:
    """i, x, y of the sixteen places around a pixel, exploded."""
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col(x) + dx).alias("x"), (F.col(y) + dy).alias("y")) for i, (dx, dy) in enumerate(CIRCLE)]))


def _offsets(which) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(CIRCLE) if i in which])).alias("o")


def _compass(gray: DataFrame, centres: DataFrame) -> DataFrame:
    """centres with the four compass pixels: every pixel goes to the centres around it."""
    sent = gray.select("image_id", _offsets(COMPASS), "x", "y", F.col("v").alias("w")).select("image_id", (F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), "o.i", "w")
    near = sent.groupBy("image_id", "x", "y").agg(*[F.max(F.when(F.col("i") == i, F.col("w"))).alias(f"p{i}") for i in COMPASS])
    return centres.join(near, ["image_id", "x", "y"])


def _circle(gray: DataFrame, centres: DataFrame) -> DataFrame:
    """centres with p0..p15: they ask for their pixels, which are few against the image."""
    ask = centres.select("image_id", "x", "y", "v", _offsets(range(16))).select("image_id", "x", "y", "v", "o.i", (F.col("x") + F.col("o.dx")).alias("gx"), (F.col("y") + F.col("o.dy")).alias("gy"))
    px = gray.select("image_id", F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("v").alias("w"))
    return ask.join(px, ["image_id", "gx", "gy"]).groupBy("image_id", "x", "y", "v").agg(*[F.max(F.when(F.col("i") == i, F.col("w"))).alias(f"p{i}") for i in range(16)])


def compass_test(gray: DataFrame, width: int, height: int, t: int = THRESHOLD) -> DataFrame:
    """Centres inside the margin of whose four compass pixels three are brighter, or three darker, by t."""
    inner = gray.where(F.col("x").between(MARGIN, width - 1 - MARGIN) & F.col("y").between(MARGIN, height - 1 - MARGIN))
    c = _compass(gray, inner)
    votes = lambda test: reduce(lambda a, b: a + b, [F.when(test(F.col(f"p{i}")), 1).otherwise(0) for i in COMPASS])
    return c.where((votes(lambda p: p > F.col("v") + t) >= 3) | (votes(lambda p: p < F.col("v") - t) >= 3))


def has_arc(bits: list[Column]) -> Column:
    """Whether nine neighbours in a row, around the circle, satisfy their condition: bit arithmetic."""
    mask = reduce(lambda a, b: a + b, [F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)])
    twice = mask.cast("long") * 65537
    run = reduce(lambda a, b: a.bitwiseAND(b), [F.shiftrightunsigned(twice, i) for i in range(ARC)])
    return run.bitwiseAND(F.lit(65535)) != 0


def corners(gray: DataFrame, width: int, height: int, t: int = THRESHOLD) -> DataFrame:
    """image_id, x, y, score: the segment test; bright arcs are tried first, and the score is the least margin."""
    kept = compass_test(gray, width, height, t).select("image_id", "x", "y", "v")
    c = _circle(gray, kept)
    p = [F.col(f"p{i}") for i in range(16)]
    margins = {"bright": [q - F.col("v") - t for q in p], "dark": [F.col("v") - q - t for q in p]}
    least = {k: F.array_min(F.filter(F.array(*m), lambda d: d > 0)) for k, m in margins.items()}
    found = {k: has_arc([d > 0 for d in m]) for k, m in margins.items()}
    score = F.when(found["bright"], least["bright"]).when(found["dark"], least["dark"])
    return c.select("image_id", "x", "y", score.cast("int").alias("score")).where("score > 0")


def suppress(found: DataFrame, cell: int = CELL) -> DataFrame:
    """The best corner of each cell; of equals the first in scanning order."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "y", "x"))
    return found.groupBy("image_id", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(best.alias("b")).select("image_id", "b.x", "b.y", (-F.col("b.s")).alias("score"))


def strongest(found: DataFrame, n: int = MOST) -> DataFrame:
    """The n best corners of each image, ties in scanning order, numbered from 0 as features."""
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "y", "x")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("image_id", (F.col("r") - 1).alias("feat_id"), "x", "y", "score")


def test_pairs(n: int = 256, seed: int = 42, patch: int = 12) -> np.ndarray:
    """Offsets (x1, y1, x2, y2) of the descriptor's comparisons: normal around the centre, clamped. Self-consistent only."""
    rng = np.random.default_rng(seed)
    return np.clip(np.trunc(rng.normal(0, 15 / 5, (n, 4))), -patch, patch).astype(int)


def describe(gray: DataFrame, features: DataFrame, width: int, height: int, pairs: np.ndarray | None = None, border: int = 15) -> DataFrame:
    """Adds d0..d3, 256 comparison bits as four longs; zeros near the border.

    The comparisons are a constant table: each feature asks for the pixels of its patch by an equi-join, and
    the bits are sums of powers of two.
    """
    pairs = test_pairs() if pairs is None else pairs
    table = F.from_json(F.lit(json.dumps([dict(zip(("i", "x1", "y1", "x2", "y2"), (i, *map(int, row)))) for i, row in enumerate(pairs)])), "array<struct<i:int,x1:int,y1:int,x2:int,y2:int>>")
    inside = features.where(F.col("x").between(border, width - 1 - border) & F.col("y").between(border, height - 1 - border))
    ask = inside.select("image_id", "feat_id", "x", "y", F.explode(table).alias("t"))
    px = lambda k: gray.select("image_id", F.col("x").alias(f"gx{k}"), F.col("y").alias(f"gy{k}"), F.col("v").alias(f"v{k}"))
    for k in (1, 2):
        ask = ask.withColumns({f"gx{k}": F.col("x") + F.col(f"t.x{k}"), f"gy{k}": F.col("y") + F.col(f"t.y{k}")}).join(px(k), ["image_id", f"gx{k}", f"gy{k}"])
    bit = F.when(F.col("v1") < F.col("v2"), F.expr("shiftleft(1L, t.i % 64)")).otherwise(F.lit(0).cast("long"))
    words = ask.groupBy("image_id", "feat_id").agg(*[F.bit_or(F.when(F.floor(F.col("t.i") / 64) == w, bit)).alias(f"d{w}") for w in range(4)])
    out = features.join(words, ["image_id", "feat_id"], "left")
    return out.select(*features.columns, *[F.coalesce(f"d{w}", F.lit(0).cast("long")).alias(f"d{w}") for w in range(4)])


def detect(gray: DataFrame, width: int, height: int) -> DataFrame:
    """Corners, suppression, strongest, descriptors."""
    return describe(gray, strongest(suppress(corners(gray, width, height))), width, height)


def detect_all(gray: DataFrame) -> DataFrame:
    """As :func:`detect`, for images of any sizes: columns width and height of ``gray``."""
    w, h = F.col("width"), F.col("height")
    sizes = gray.where("x = 0 and y = 0").select("image_id", "width", "height")
    return describe(gray, strongest(suppress(corners(gray, w, h))).join(sizes, "image_id"), w, h).drop("width", "height")


def rescale(features: DataFrame, from_size: tuple[int, int], to_size: tuple[int, int]) -> DataFrame:
    return features.withColumns({"x": F.col("x") * (to_size[0] / from_size[0]), "y": F.col("y") * (to_size[1] / from_size[1])})
