"""Descriptor matching and the view graph.

``features``: image_id, feat_id, x, y, d0.. (bit words). Descriptors compare by XOR and bit counts. Pairs of
images are a theta join on image ids only; descriptors then meet by blocks of either image, one group for
two blocks, and at once reduce to the best two per feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RATIO, MAX_DISTANCE, MIN_MATCHES = 0.75, 64, 8


def image_pairs(images: DataFrame) -> DataFrame:
    """img_a < img_b over all images."""
    a, b = images.select(F.col("image_id").alias("img_a")), images.select(F.col("image_id").alias("img_b"))
    return a.join(b, F.col("img_a") < F.col("img_b"))


#: Features of one image that a task holds at a time, of either side.
BLOCK = 8192


def _nearest(words: list[str], out: pa.Schema):
    """Of two blocks (``side`` 0 and 1): each feature's nearest two on the other side, ties to the smaller id."""

    def run(rows: pa.Table) -> pa.Table:
        left, right = (rows.filter(pc.equal(rows["side"], i)) for i in (0, 1))
        right = right.sort_by("feat")
        n, m = len(left), len(right)
        if not n or not m:
            return out.empty_table()
        bits = lambda t: [t[w].to_numpy().view(np.uint64) for w in words]
        a, b = bits(left), bits(right)
        found, chunk = [], max(1, (1 << 20) // m)
        for i in range(0, n, chunk):
            d = sum(np.bitwise_count(x[i : i + chunk, None] ^ y[None, :]).astype(np.uint16) for x, y in zip(a, b))
            for _ in range(min(2, m)):
                at = d.argmin(1)
                every = np.arange(len(d))
                found.append((i + every, at, d[every, at]))
                d[every, at] = np.iinfo(np.uint16).max
        who, at, d = (np.concatenate(x) for x in zip(*found))
        cols = [left["img_a"].take(who), left["img_b"].take(who), left["feat"].take(who), right["feat"].take(at), pa.array(d.astype(np.int32))]
        return pa.Table.from_arrays(cols, schema=out)

    return run


def best_two(features: DataFrame, pairs: DataFrame, words: list[str], reverse: bool = False) -> DataFrame:
    """img_a, img_b, feat, match, best, second: of each feature of one side, the nearest two of the other.

    Ties go to the smaller id. ``reverse`` starts from side b. Images are cut into blocks by feature, and every two blocks of a pair
    meet in one group, which compares them all and gives out two candidates a feature; candidates themselves are never rows. The two
    of each block are then ranked by a window whose limit of two Spark pushes below it.
    """
    own, other = ("img_b", "img_a") if reverse else ("img_a", "img_b")
    cuts = features.groupBy("image_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    cut = lambda k: cuts.select(F.col("image_id").alias(k), F.col("cuts").alias(f"cuts_{k}"))
    met = pairs.join(cut("img_a"), "img_a").join(cut("img_b"), "img_b")

    def side(i: int, here: str, there: str) -> DataFrame:
        f = features.select(F.col("image_id").alias(here), F.col("feat_id").alias("feat"), *words)
        part = F.pmod(F.xxhash64("feat"), F.col(f"cuts_{here}")).cast("int").alias(f"part_{here}")
        each = F.explode(F.sequence(F.lit(0), F.col(f"cuts_{there}") - 1)).alias(f"part_{there}")
        return met.join(f, here).select("img_a", "img_b", F.lit(i).alias("side"), "feat", *[F.col(w).cast("long").alias(w) for w in words], part, each)

    image, feat = features.schema["image_id"].dataType, features.schema["feat_id"].dataType
    kind = T.StructType([T.StructField("img_a", image), T.StructField("img_b", image), T.StructField("feat", feat), T.StructField("match", feat), T.StructField("distance", T.IntegerType())])
    both = side(0, own, other).unionByName(side(1, other, own))
    cand = both.groupBy("img_a", "img_b", "part_img_a", "part_img_b").applyInArrow(_nearest(words, to_arrow_schema(kind)), kind)
    ranked = cand.withColumn("r", F.row_number().over(Window.partitionBy("img_a", "img_b", "feat").orderBy("distance", "match"))).where("r <= 2")
    first = F.col("r") == 1
    return ranked.groupBy("img_a", "img_b", "feat").agg(F.max(F.when(first, F.col("match"))).alias("match"), F.max(F.when(first, F.col("distance"))).alias("best"), F.max(F.when(~first, F.col("distance"))).alias("second"))


def ratio_test(best: DataFrame, ratio: float = RATIO, most: int = MAX_DISTANCE, strict: bool = True) -> DataFrame:
    """Clearly best matches. ``strict`` needs a positive second distance; else a lone candidate passes."""
    second = F.coalesce("second", F.lit(999999))
    ok = (F.col("best") < most) & (F.col("best") < ratio * second)
    return best.where(ok & (second > 0) if strict else ok)


def match_features(features: DataFrame, words: list[str], ratio: float = RATIO, most: int = MAX_DISTANCE) -> DataFrame:
    """img_a, img_b, feat_a, feat_b, distance: ratio-tested matches that are mutual."""
    pairs = image_pairs(features.select("image_id").distinct())
    ahead = ratio_test(best_two(features, pairs, words), ratio, most).select("img_a", "img_b", F.col("feat").alias("feat_a"), F.col("match").alias("feat_b"), F.col("best").alias("distance"))
    back = ratio_test(best_two(features, pairs, words, reverse=True), ratio, most).select("img_a", "img_b", F.col("match").alias("feat_a"), F.col("feat").alias("feat_b"))
    return ahead.join(back, ["img_a", "img_b", "feat_a", "feat_b"], "left_semi")


def pair_graph(matches: DataFrame, least: int = MIN_MATCHES) -> DataFrame:
    """Edges of the view graph: pairs with enough matches."""
    return matches.groupBy("img_a", "img_b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    return pairs.unionByName(pairs.select(F.col("img_b").alias("img_a"), F.col("img_a").alias("img_b"), *[c for c in pairs.columns if c not in ("img_a", "img_b")]))


def top_by_count(pairs: DataFrame, least: int = 30, n: int = 8) -> DataFrame:
    return pairs.where(F.col("n") >= least).orderBy(F.desc("n"), "img_a", "img_b").limit(n)


def top_by_baseline(pairs: DataFrame, least: int = 20, n: int = 6) -> DataFrame:
    return pairs.where(F.col("n") >= least).orderBy(F.desc(F.abs(F.col("img_a") - F.col("img_b"))), "img_a", "img_b").limit(n)


def start_candidates(pairs: DataFrame, by_count=(30, 8), by_baseline=(20, 6)) -> DataFrame:
    """Pairs to start a reconstruction from: those with most matches, then wide baselines not among them."""
    most = top_by_count(pairs, *by_count)
    wide = top_by_baseline(pairs, *by_baseline).join(most, ["img_a", "img_b"], "left_anti")
    return most.unionByName(wide)


def frontier(pairs: DataFrame, registered: DataFrame) -> DataFrame:
    """Pairs of which exactly one image is registered."""
    a = registered.select(F.col("image_id").alias("img_a"), F.lit(True).alias("ra"))
    b = registered.select(F.col("image_id").alias("img_b"), F.lit(True).alias("rb"))
    j = pairs.join(a, "img_a", "left").join(b, "img_b", "left")
    return j.where(F.col("ra").isNull() != F.col("rb").isNull()).select(*pairs.columns)


def gather(matches: DataFrame, features: DataFrame) -> DataFrame:
    """Matches with the coordinates of both features."""
    a = features.select(F.col("image_id").alias("img_a"), F.col("feat_id").alias("feat_a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = features.select(F.col("image_id").alias("img_b"), F.col("feat_id").alias("feat_b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    return matches.join(a, ["img_a", "feat_a"]).join(b, ["img_b", "feat_b"])


def normalise(coords: DataFrame, fx: float, cx: float, cy: float) -> DataFrame:
    """Pixel coordinates to rays; the one focal length serves both axes."""
    centre = {"x": cx, "y": cy}
    return coords.withColumns({c: (F.col(c) - centre[c[0]]) / fx for c in coords.columns if c in ("xa", "ya", "xb", "yb", "x", "y")})


def correspondences(matches: DataFrame, observations: DataFrame, points: DataFrame, features: DataFrame) -> DataFrame:
    """Features of not yet registered images that match a feature with a point: image_id, feat_id, point and both coordinates."""
    both = matches.select("img_a", "feat_a", "img_b", "feat_b").unionByName(matches.select(F.col("img_b").alias("img_a"), F.col("feat_b").alias("feat_a"), F.col("img_a").alias("img_b"), F.col("feat_a").alias("feat_b")))
    seen = observations.select(F.col("image_id").alias("img_a"), F.col("feat_id").alias("feat_a"), "point_id")
    known = observations.select("image_id").distinct()
    new = both.join(seen, ["img_a", "feat_a"]).select(F.col("img_b").alias("image_id"), F.col("feat_b").alias("feat_id"), "point_id").join(known, "image_id", "left_anti")
    one = new.groupBy("image_id", "feat_id").agg(F.min("point_id").alias("point_id"))
    at = features.select("image_id", "feat_id", F.col("x").alias("u"), F.col("y").alias("v"))
    return one.join(points.select("point_id", "x", "y", "z"), "point_id").join(at, ["image_id", "feat_id"])


def correspondence_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("image_id").agg(F.count("*").alias("n"))


def unregistered(images: DataFrame, registered: DataFrame) -> DataFrame:
    return images.join(registered, "image_id", "left_anti")


def untriangulated(matches: DataFrame, observations: DataFrame) -> DataFrame:
    """Matches neither of whose features has a point."""
    o = observations.select("image_id", "feat_id")
    a = o.withColumnsRenamed({"image_id": "img_a", "feat_id": "feat_a"})
    b = o.withColumnsRenamed({"image_id": "img_b", "feat_id": "feat_b"})
    return matches.join(a, ["img_a", "feat_a"], "left_anti").join(b, ["img_b", "feat_b"], "left_anti")


def add_observations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new observations; the first writer of an (image, feature) keeps it, then the smaller point."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    return both.groupBy("image_id", "feat_id").agg(F.min(F.struct("age", "point_id")).alias("m")).select("image_id", "feat_id", "m.point_id")
