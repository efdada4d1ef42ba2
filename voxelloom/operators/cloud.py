"""Point-cloud statistics and outlier filters. Quartiles and medians are order statistics at n div 4, n div 2
and 3n div 4 of the sorted values, found by counting over value ranges and ordering only the ranges that hold them."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

XYZ = ("x", "y", "z")


#: Value ranges that a group is counted in.
RANGES = 4096


def ranked_values(values: DataFrame, by: list[str], value: str, at: dict[str, Column]) -> DataFrame:
    """Order statistics: for each name, the value at a 0-based rank (an expression of ``n``) within ``by``.

    Counts of ``RANGES`` ranges between the least and the largest value tell the range of each rank; only values inside those
    ranges, counted where they are equal, are ordered. Values are read anew for each of the three, and never held by value.
    """
    same = lambda t: reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{t}_{c}")) for c in by])
    named = lambda t: [F.col(c).alias(f"_{t}_{c}") for c in by]
    every = values.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    ends = every.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).select(*named("e"), "n", "_lo", "_hi")
    part = F.nanvl((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)).cast("double"), F.lit(0.0))
    bucket = F.when(F.col("_v") >= F.col("_hi"), RANGES - 1).otherwise(F.least(F.floor(part * RANGES), F.lit(RANGES - 1))).cast("int")
    c = every.join(ends, same("e")).select(*by, "_v", "n", bucket.alias("_b"))
    w = Window.partitionBy(*by).orderBy("_b")
    sums = c.groupBy(*by, "_b").agg(F.count("*").alias("_m"), F.max("n").alias("n")).withColumn("_upto", F.sum("_m").over(w))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in at.items()])).alias("_r")
    want = sums.select(*named("w"), F.col("_b").alias("_w"), "_upto", F.col("_m").alias("_in"), ranks).where("_r.rank >= _upto - _in and _r.rank < _upto")
    held = c.join(want, same("w") & (F.col("_b") == F.col("_w"))).groupBy(*by, "_r", "_upto", "_in", "_v").agg(F.count("*").alias("_m"), F.max("n").alias("n"))
    inside = held.withColumn("_seen", F.col("_upto") - F.col("_in") + F.sum("_m").over(Window.partitionBy(*by, "_r.name").orderBy("_v")))
    pick = [F.min(F.when((F.col("_r.name") == name) & (F.col("_seen") > F.col("_r.rank")), F.col("_v"))).alias(name) for name in at]
    return inside.groupBy(*by).agg(F.max("n").alias("n"), *pick)


def quartiles(points: DataFrame, axes=XYZ) -> DataFrame:
    """axis, n, q1, q3 of each coordinate."""
    long = points.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("v")) for a in axes])).alias("s")).select("s.*")
    return ranked_values(long, ["axis"], "v", {"q1": F.floor(F.col("n") / 4), "q3": F.floor(3 * F.col("n") / 4)})


def drop_outliers(points: DataFrame, k: float = 2.0, least: int = 20) -> DataFrame:
    """Within k interquartile ranges of the quartiles on every axis; clouds of fewer points stay whole."""
    q = quartiles(points).groupBy().agg(*[F.max(F.when(F.col("axis") == a, F.col(c))).alias(f"{c}_{a}") for a in XYZ for c in ("q1", "q3")], F.max("n").alias("_n"))
    keep = F.lit(True)
    for a in XYZ:
        r = F.col(f"q3_{a}") - F.col(f"q1_{a}")
        keep = keep & F.col(a).between(F.col(f"q1_{a}") - k * r, F.col(f"q3_{a}") + k * r)
    j = points.crossJoin(F.broadcast(q))  # one row
    return j.where((F.col("_n") < least) | keep).select(*points.columns)


def depth_band(points: DataFrame) -> DataFrame:
    """Depths within three interquartile ranges, and at least 0.1."""
    q = quartiles(points, ("z",)).select(F.col("q1").alias("_a"), F.col("q3").alias("_b"))
    j = points.crossJoin(F.broadcast(q))  # one row
    r = F.col("_b") - F.col("_a")
    return j.where(F.col("z").between(F.greatest(F.col("_a") - 3 * r, F.lit(0.1)), F.col("_b") + 3 * r)).select(*points.columns)


def covariance(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Population covariance: c_xx to c_zz."""
    terms = [F.covar_pop(a, b).alias(f"c_{a}{b}") for i, a in enumerate(XYZ) for b in XYZ[i:]]
    return points.groupBy(*(by or [])).agg(F.count("*").alias("n"), *terms)


@F.pandas_udf(T.DoubleType())
def pca_ratio(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
    """Smallest over largest eigenvalue of symmetric matrices, zero where the largest is."""
    import numpy as np

    m = np.stack([np.stack(r, -1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], -2)
    e = np.linalg.eigvalsh(np.nan_to_num(m))
    return pd.Series(np.where(e[:, 2] > 0, e[:, 0] / np.where(e[:, 2] > 0, e[:, 2], 1), 0.0))


def pca(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    c = covariance(points, by)
    return c.select(*(by or []), "n", pca_ratio(*[f"c_{k}" for k in ("xx", "xy", "xz", "yy", "yz", "zz")]).alias("ratio"))


def spread(points: DataFrame) -> DataFrame:
    """Mean and deviation per axis; planar if the least deviation is under 0.15 of the largest."""
    s = points.agg(*[F.avg(a).alias(f"mean_{a}") for a in XYZ], *[F.stddev_pop(a).alias(f"std_{a}") for a in XYZ])
    std = [F.col(f"std_{a}") for a in XYZ]
    return s.withColumn("planar", F.least(*std) / F.greatest(*std) < 0.15)


def ranges(points: DataFrame) -> DataFrame:
    return points.agg(*[(F.max(a) - F.min(a)).alias(f"range_{a}") for a in XYZ])


def cloud_shape(points: DataFrame) -> DataFrame:
    """Extents of at least 0.01 per axis, and the middle one."""
    r = ranges(points).select(*[F.greatest(F.col(f"range_{a}"), F.lit(0.01)).alias(f"extent_{a}") for a in XYZ])
    return r.withColumn("median_extent", F.array_sort(F.array(*[f"extent_{a}" for a in XYZ]))[1])


def centroid_spread(points: DataFrame) -> DataFrame:
    """Centroid and root mean square distance from it: one pass of sums."""
    s = points.agg(F.count("*").alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in XYZ], *[F.var_pop(a).alias(f"v_{a}") for a in XYZ])
    return s.select("n", *[f"mean_{a}" for a in XYZ], F.sqrt(sum(F.col(f"v_{a}") for a in XYZ)).alias("rms"))


def upper_median(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value at n div 2 of the sorted values of each group."""
    return ranked_values(values, by, value, {"median": F.floor(F.col("n") / 2)})


def ray_angle(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two directions."""
    dot = sum(x * y for x, y in zip(a, b)) / F.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    return F.degrees(F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))))


def scale_ratio(tracks: DataFrame, limit: int = 500) -> DataFrame:
    """Median ratio of distances between the same points in two reconstructions, over the first pairs.

    ``tracks``: k (order), ax, ay, az, bx, by, bz. Only the first 33 tracks, which give the first 500 pairs
    and a few more, are joined; the ratio is clamped to 0.5..2 and is 1 with fewer than three pairs.
    """
    need = int((2 * limit) ** 0.5) + 2
    first = tracks.withColumn("i", F.row_number().over(Window.orderBy("k"))).where(F.col("i") <= need)
    b = first.select(*[F.col(c).alias(f"o_{c}") for c in first.columns])
    dist = lambda s: F.sqrt(sum((F.col(f"{s}{a}") - F.col(f"o_{s}{a}")) * (F.col(f"{s}{a}") - F.col(f"o_{s}{a}")) for a in XYZ))
    p = first.join(F.broadcast(b), F.col("i") < F.col("o_i")).select("i", "o_i", dist("a").alias("da"), dist("b").alias("db"))  # need rows
    p = p.orderBy("o_i", "i").limit(limit).where("da > 0.001 and db > 0.001").select(F.lit(1).alias("g"), (F.col("db") / F.col("da")).alias("ratio"))
    m = upper_median(p, ["g"], "ratio")
    return m.agg(F.coalesce(F.max(F.when(F.col("n") >= 3, F.least(F.greatest(F.col("median"), F.lit(0.5)), F.lit(2.0)))), F.lit(1.0)).alias("scale"))


def mean_nearest(points: DataFrame, first: int = 100, among: int | None = None, apart: bool = False) -> DataFrame:
    """Mean distance of each of the first points (by point_id) to the nearest other point; one row.

    ``among``: only so many first points count as others; ``apart``: points in the same place do not.
    """
    every = points.select("point_id", *XYZ)
    f = every.orderBy("point_id").limit(first).select(*[F.col(c).alias(f"f_{c}") for c in every.columns])
    others = every if among is None else every.orderBy("point_id").limit(among)
    d = F.sqrt(sum((F.col(a) - F.col(f"f_{a}")) * (F.col(a) - F.col(f"f_{a}")) for a in XYZ))
    near = others.join(F.broadcast(f), F.col("point_id") != F.col("f_point_id")).select("f_point_id", d.alias("d"))  # ``first`` rows
    return near.where(F.col("d") > 0 if apart else F.lit(True)).groupBy("f_point_id").agg(F.min("d").alias("d")).agg(F.avg("d").alias("mean_nn"))


def circular_gaps(cameras: DataFrame) -> DataFrame:
    """Distance from each camera (seq, x, y, z) to the next, the last to the first."""
    w = Window.partitionBy().orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {a: F.coalesce(F.lead(a).over(w), F.first(a).over(whole)) for a in XYZ}
    return cameras.select("seq", F.sqrt(sum((F.col(a) - nxt[a]) * (F.col(a) - nxt[a]) for a in XYZ)).alias("gap"))
