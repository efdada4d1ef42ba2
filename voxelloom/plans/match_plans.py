"""Queries of descriptor matching and the view graph. The pair graph uses a ratio of 0.9, as the fixtures are weak."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions import splat as S
from voxelloom.operators import match as M
from voxelloom.plans import fixtures as X
from voxelloom.plans.registry import query

RATIO = 0.9


def _matches(spark, sf):
    return M.match_features(X.features(spark, sf), X.WORDS, RATIO)


def _pairs(spark, sf):
    return M.pair_graph(_matches(spark, sf))


@query("SELECT a.feat_id AS fa, b.feat_id AS fb, bit_count(xor(a.d0, b.d0)) + bit_count(xor(a.d1, b.d1)) AS d FROM feat a JOIN feat b ON b.feat_id = a.feat_id + 1", ints="fa fb d")
def f_hamming(spark, sf):
    f = X.features(spark, sf)
    a, b = f.select((F.col("feat_id") + 1).alias("k"), F.col("feat_id").alias("fa"), F.col("d0").alias("a0"), F.col("d1").alias("a1")), f.select(F.col("feat_id").alias("k"), F.col("feat_id").alias("fb"), F.col("d0").alias("b0"), F.col("d1").alias("b1"))
    return a.join(b, "k").select("fa", "fb", S.hamming(["a0", "a1"], ["b0", "b1"]).alias("d"))


@query("SELECT a.image_id AS img_a, b.image_id AS img_b FROM (SELECT DISTINCT image_id FROM feat) a JOIN (SELECT DISTINCT image_id FROM feat) b ON a.image_id < b.image_id", ints="img_a img_b")
def j_pairs(spark, sf):
    return M.image_pairs(X.images(spark, sf))


BEST = {"ints": "img_a img_b feat match best second"}


@query("SELECT img_a, img_b, feat, match, best, second FROM ahead", **BEST)
def j_hamming(spark, sf):
    return M.best_two(X.features(spark, sf), M.image_pairs(X.images(spark, sf)), X.WORDS)


@query("SELECT img_a, img_b, feat, match, best, second FROM back", **BEST)
def j_hamming_gpu(spark, sf):
    return M.best_two(X.features(spark, sf), M.image_pairs(X.images(spark, sf)), X.WORDS, reverse=True)


@query("SELECT img_a, img_b, count(*) AS n, sum(best) AS best, sum(second) AS second FROM ahead GROUP BY ALL", ints="img_a img_b n best second")
def w_best2(spark, sf):
    b = M.best_two(X.features(spark, sf), M.image_pairs(X.images(spark, sf)), X.WORDS)
    return b.groupBy("img_a", "img_b").agg(F.count("*").alias("n"), F.sum("best").alias("best"), F.sum("second").alias("second"))


@query("SELECT img_a, img_b, feat, match, best FROM ahead WHERE best < 64 AND best < 0.75 * coalesce(second, 999999)", ints="img_a img_b feat match best")
def flt_ratio(spark, sf):
    return M.ratio_test(M.best_two(X.features(spark, sf), M.image_pairs(X.images(spark, sf)), X.WORDS), 0.75, strict=False)


@query("SELECT img_a, img_b, feat, match, best FROM ahead WHERE best < 64 AND best < 0.9 * coalesce(second, 999999) AND coalesce(second, 999999) > 0", ints="img_a img_b feat match best")
def flt_ratio_gpu(spark, sf):
    return M.ratio_test(M.best_two(X.features(spark, sf), M.image_pairs(X.images(spark, sf)), X.WORDS), RATIO)


MATCH = {"ints": "img_a img_b feat_a feat_b distance"}


@query("SELECT * FROM mt", **MATCH)
def j_match(spark, sf):
    return _matches(spark, sf)


@query("SELECT a.img_a, a.img_b, a.feat AS feat_a, a.match AS feat_b, a.best AS distance FROM ahead a JOIN back b ON a.img_a = b.img_a AND a.img_b = b.img_b AND a.feat = b.match AND a.match = b.feat WHERE a.best < 64 AND b.best < 64", **MATCH)
def j_cross(spark, sf):
    return M.match_features(X.features(spark, sf), X.WORDS, 1e6)


@query("SELECT img_a, img_b, n FROM pairs", ints="img_a img_b n")
def flt_pair8(spark, sf):
    return _pairs(spark, sf)


@query("SELECT img_a, img_b, n FROM pairs UNION ALL SELECT img_b, img_a, n FROM pairs", ints="img_a img_b n")
def j_sym(spark, sf):
    return M.symmetric(_pairs(spark, sf))


@query("SELECT img_a, img_b, n, row_number() OVER (ORDER BY n DESC, img_a, img_b) AS place FROM pairs", ints="img_a img_b n place")
def s_pairs(spark, sf):
    from pyspark.sql import Window

    return _pairs(spark, sf).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "img_a", "img_b")))


TOP8 = "SELECT img_a, img_b, n FROM pairs WHERE n >= 10 ORDER BY n DESC, img_a, img_b LIMIT 8"
TOP6 = "SELECT img_a, img_b, n FROM pairs WHERE n >= 8 ORDER BY abs(img_a - img_b) DESC, img_a, img_b LIMIT 6"
EDGE = {"ints": "img_a img_b n"}


@query(TOP8, **EDGE)
def s_top8(spark, sf):
    return M.top_by_count(_pairs(spark, sf), 10, 8)


@query(TOP6, **EDGE)
def s_top6(spark, sf):
    return M.top_by_baseline(_pairs(spark, sf), 8, 6)


ANTI = f"SELECT t.* FROM ({TOP6}) t LEFT JOIN ({TOP8}) e ON t.img_a = e.img_a AND t.img_b = e.img_b WHERE e.img_a IS NULL"


@query(ANTI, **EDGE)
def j_anti_pair(spark, sf):
    p = _pairs(spark, sf)
    return M.top_by_baseline(p, 8, 6).join(M.top_by_count(p, 10, 8), ["img_a", "img_b"], "left_anti")


@query(f"SELECT img_a, img_b FROM ({TOP6}) EXCEPT SELECT img_a, img_b FROM ({TOP8})", ints="img_a img_b")
def u_except(spark, sf):
    p, keys = _pairs(spark, sf), ["img_a", "img_b"]
    return M.top_by_baseline(p, 8, 6).select(*keys).exceptAll(M.top_by_count(p, 10, 8).select(*keys))


@query(f"({TOP8}) UNION ALL ({ANTI})", **EDGE)
def u_concat(spark, sf):
    return M.start_candidates(_pairs(spark, sf), (10, 8), (8, 6))


@query("SELECT img_a, img_b, n FROM pairs WHERE (img_a < 3) <> (img_b < 3)", **EDGE)
def j_frontier(spark, sf):
    i = X.images(spark, sf)
    return M.frontier(_pairs(spark, sf), i.where("image_id < 3"))


GATHER = "SELECT img_a, img_b, feat_a, feat_b, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM mt JOIN feat a ON a.image_id = img_a AND a.feat_id = feat_a JOIN feat b ON b.image_id = img_b AND b.feat_id = feat_b"
COORD = {"ints": "img_a img_b feat_a feat_b", "reals": "xa ya xb yb"}


@query(GATHER, **COORD)
def j_gather(spark, sf):
    return M.gather(_matches(spark, sf), X.features(spark, sf))


@query(f"SELECT img_a, img_b, feat_a, feat_b, (xa - 320) / 500 AS xa, (ya - 240) / 500 AS ya, (xb - 320) / 500 AS xb, (yb - 240) / 500 AS yb FROM ({GATHER})", **COORD)
def normalise(spark, sf):
    return M.normalise(M.gather(_matches(spark, sf), X.features(spark, sf)), 500.0, 320.0, 240.0)


_E = [[0.1, -0.9, 0.2], [0.8, 0.05, -0.4], [-0.3, 0.5, 0.02]]


def _sampson_sql(table):
    return (
        "n * n / (e0 * e0 + e1 * e1 + t0 * t0 + t1 * t1 + 1e-10) FROM (SELECT *, xb * e0 + yb * e1 + (-0.3 * xa + 0.5 * ya + 0.02) AS n FROM (SELECT *, 0.1 * xa - 0.9 * ya + 0.2 AS e0, 0.8 * xa + 0.05 * ya - 0.4 AS e1, "
        f"0.1 * xb + 0.8 * yb - 0.3 AS t0, -0.9 * xb + 0.05 * yb + 0.5 AS t1 FROM ({table})))"
    )


_NORM = f"SELECT img_a, img_b, feat_a, feat_b, (xa - 320) / 500 AS xa, (ya - 240) / 500 AS ya, (xb - 320) / 500 AS xb, (yb - 240) / 500 AS yb FROM ({GATHER})"


@query("SELECT img_a, img_b, feat_a, feat_b, error FROM (SELECT *, " + _sampson_sql(_NORM).replace(" FROM ", " AS error FROM ", 1) + ")", ints="img_a img_b feat_a feat_b", reals="error")
def m_sampson(spark, sf):
    g = M.normalise(M.gather(_matches(spark, sf), X.features(spark, sf)), 500.0, 320.0, 240.0)
    return g.withColumn("error", S.sampson(_E, *[F.col(c) for c in ("xa", "ya", "xb", "yb")]))


@query("SELECT img_a, img_b, count(*) FILTER (WHERE error < 0.1) AS inliers FROM (SELECT *, " + _sampson_sql(_NORM).replace(" FROM ", " AS error FROM ", 1) + ") GROUP BY ALL", ints="img_a img_b inliers")
def agg_e_inl(spark, sf):
    g = M.normalise(M.gather(_matches(spark, sf), X.features(spark, sf)), 500.0, 320.0, 240.0)
    return g.groupBy("img_a", "img_b").agg(F.count_if(S.sampson(_E, *[F.col(c) for c in ("xa", "ya", "xb", "yb")]) < 0.1).alias("inliers"))


NEWOBS = "SELECT fb AS feat_id, ib AS image_id, min(point_id) AS point_id FROM (SELECT img_a AS ia, feat_a AS fa, img_b AS ib, feat_b AS fb FROM mt UNION ALL SELECT img_b, feat_b, img_a, feat_a FROM mt) m JOIN obs ON obs.image_id = ia AND obs.feat_id = fa WHERE ib NOT IN (SELECT image_id FROM obs) GROUP BY fb, ib"
FOUND = f"SELECT q.image_id, q.feat_id, q.point_id, p.x, p.y, p.z, f.x AS u, f.y AS v FROM ({NEWOBS}) q JOIN ppts p ON p.point_id = q.point_id JOIN feat f ON f.image_id = q.image_id AND f.feat_id = q.feat_id"


def _observations(spark, sf):
    """Of three registered images, the features left of x = 480 have points."""
    return X.features(spark, sf).where((F.col("image_id") < 3) & (F.col("x") < 480)).select("image_id", "feat_id", (F.col("feat_id") * 3).alias("point_id"))


def _found(spark, sf):
    return M.correspondences(_matches(spark, sf), _observations(spark, sf), X.part_points(spark, sf), X.features(spark, sf))


@query(FOUND, ints="image_id feat_id point_id", reals="x y z u v")
def j_2d3d(spark, sf):
    return _found(spark, sf)


@query(f"SELECT image_id, count(*) AS n FROM ({FOUND}) GROUP BY image_id", ints="image_id n")
def j_corr(spark, sf):
    return M.correspondence_counts(_found(spark, sf))


@query("SELECT DISTINCT image_id FROM feat WHERE image_id >= 3", ints="image_id")
def j_anti_unreg(spark, sf):
    i = X.images(spark, sf)
    return M.unregistered(i, i.where("image_id < 3"))


@query("SELECT mt.* FROM mt WHERE NOT EXISTS (SELECT 1 FROM obs WHERE image_id = img_a AND feat_id = feat_a) AND NOT EXISTS (SELECT 1 FROM obs WHERE image_id = img_b AND feat_id = feat_b)", **MATCH)
def j_anti_retri(spark, sf):
    return M.untriangulated(_matches(spark, sf), _observations(spark, sf))


@query("SELECT image_id, feat_id, coalesce(max(point_id) FILTER (WHERE age = 0), min(point_id) FILTER (WHERE age = 1)) AS point_id FROM (SELECT *, 0 AS age FROM obs UNION ALL SELECT image_id, feat_id, feat_id + 7, 1 FROM feat WHERE image_id < 5) GROUP BY image_id, feat_id", ints="image_id feat_id point_id")
def j_upsert(spark, sf):
    new = X.features(spark, sf).where("image_id < 5").select("image_id", "feat_id", (F.col("feat_id") + 7).alias("point_id"))
    return M.add_observations(_observations(spark, sf), new)


@query("SELECT DISTINCT image_id FROM (SELECT img_a AS image_id FROM pairs UNION SELECT img_b FROM pairs)", ints="image_id")
def u_visited(spark, sf):
    p = _pairs(spark, sf)
    return p.select(F.col("img_a").alias("image_id")).union(p.select("img_b")).distinct()


@query("SELECT img_a, arg_min(img_b, (-n, img_b)) AS img_b, max(n) AS n FROM pairs GROUP BY img_a", ints="img_a img_b n")
def s_argmax(spark, sf):
    best = F.min(F.struct((-F.col("n")).alias("m"), "img_b"))
    return _pairs(spark, sf).groupBy("img_a").agg(best.alias("b")).select("img_a", "b.img_b", (-F.col("b.m")).alias("n"))


@query("SELECT image_id, feat_id, x * 1.5 AS x, y * 2.25 AS y FROM feat", ints="image_id feat_id", reals="x y")
def f_scale(spark, sf):
    from voxelloom.operators.features import rescale

    return rescale(X.features(spark, sf), (640, 480), (960, 1080))
