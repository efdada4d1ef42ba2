"""Queries of the photo and depth-map path."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions import splat as S
from voxelloom.operators import depth as D
from voxelloom.plans import fixtures as X
from voxelloom.plans.registry import query

W = X.WIDTH
N = "1.0::DOUBLE / (n + 0.01::DOUBLE)"
VALID = f"n >= 0.01::DOUBLE AND {N} > 0.01::DOUBLE AND {N} < 100"
GRID = "x % {s} = 0 AND y % {s} = 0 AND x // {s} < w // {s} AND y // {s} < h // {s}"


def _splat_sql(source: str, step: int) -> str:
    d, f = N, "(1.2::DOUBLE * greatest(w, h))"
    s = f"greatest({d} * {step}.0::DOUBLE / {f}, 0.001::DOUBLE)"
    return (
        f"SELECT q.image_id, q.y * w + q.x AS splat_id, -(q.x - w / 2) * ({d}) / {f} AS px, -(q.y - h / 2) * ({d}) / {f} AS py, {d} AS pz, "
        f"r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b, {s} AS scale_x, {s} AS scale_y, {s} * 0.5 AS scale_z, 0.9::DOUBLE AS opacity "
        f"FROM ({source}) q JOIN px ON px.x = q.x AND px.y = q.y JOIN size ON true"
    )


SPLAT = {"ints": "image_id splat_id", "reals": "px py pz r g b scale_x scale_y scale_z opacity"}
KEPT = f"SELECT nd.* FROM nd JOIN size ON true WHERE {GRID} AND {VALID}"


@query("SELECT dmin, dmax FROM mm", reals="dmin dmax")
def agg_minmax(spark, sf):
    return D.min_max(X.depth(spark, sf))


@query("SELECT 0 AS image_id, dmin, dmax, dmax - dmin AS span FROM mm", ints="image_id", reals="dmin dmax span")
def agg_minmax_drv(spark, sf):
    return D.min_max(X.depth(spark, sf)).withColumn("span", F.col("dmax") - F.col("dmin"))


@query(f"SELECT x, y, n FROM nd WHERE {VALID}", ints="x y", reals="n")
def flt_depth(spark, sf):
    return D.valid_depth(D.normalised(X.depth(spark, sf)))


@query(f"SELECT x, y, d FROM depth JOIN size ON true WHERE {GRID.format(s=3)}", ints="x y", reals="d")
def flt_subsample(spark, sf):
    return D.subsampled(X.depth(spark, sf), 3, W, X.height(spark, sf))


@query(_splat_sql(f"SELECT * FROM nd WHERE {VALID}", 1), **SPLAT)
def unproject(spark, sf):
    n = D.valid_depth(D.normalised(X.depth(spark, sf)))
    return D.unproject(n.join(X.pixels(spark, sf), ["image_id", "x", "y"]), 1, W, X.height(spark, sf))


@query(_splat_sql(KEPT.format(s=2), 2), **SPLAT)
def unproject_api(spark, sf):
    return D.depth_to_splats(X.depth(spark, sf), X.pixels(spark, sf), W, X.height(spark, sf), 2)


EDGE = "SELECT c.image_id, c.x, c.y, c.d, c.n, greatest(abs(c.n - coalesce(e.n, c.n)), abs(c.n - coalesce(s.n, c.n))) AS gradient FROM nd c JOIN size ON true LEFT JOIN nd e ON e.x = least(c.x + 2, w - 1) AND e.y = c.y LEFT JOIN nd s ON s.x = c.x AND s.y = least(c.y + 2, h - 1)"


@query(f"SELECT x, y, gradient, gradient > 0.3 AS is_edge FROM ({EDGE})", ints="x y", reals="gradient", other="is_edge")
def j_stencil(spark, sf):
    return D.edge_faces(D.normalised(X.depth(spark, sf)), 2, 0.3, W, X.height(spark, sf))


@query(f"SELECT count(*) AS n FROM nd JOIN size ON true WHERE {GRID.format(s=2)} AND {VALID}", ints="n")
def agg_count(spark, sf):
    return D.depth_to_splats(X.depth(spark, sf), X.pixels(spark, sf), W, X.height(spark, sf), 2).agg(F.count("*").alias("n"))


@query("SELECT t.x, t.y, d FROM (SELECT i % 64 AS x, i // 64 AS y, (i % 64) * w // 64 AS sx, (i // 64) * h // 48 AS sy FROM range(3072) g(i) JOIN size ON true) t JOIN depth ON depth.x = sx AND depth.y = sy", ints="x y", reals="d")
def j_resize(spark, sf):
    return D.resize_nearest(X.depth(spark, sf), (W, X.height(spark, sf)), (64, 48))


@query("SELECT t.x, t.y, (77 * r + 150 * g + 29 * b) >> 8 AS v FROM (SELECT i % 64 AS x, i // 64 AS y, least(CAST(trunc((i % 64) * (w / 64)) AS BIGINT), w - 1) AS sx, least(CAST(trunc((i // 64) * (h / 48)) AS BIGINT), h - 1) AS sy FROM range(3072) g(i) JOIN size ON true) t JOIN px ON px.x = sx AND px.y = sy", ints="x y v")
def j_down(spark, sf):
    return D.downsample_gray(X.pixels(spark, sf), (W, X.height(spark, sf)), (64, 48))


@query("SELECT x, y, (77 * r + 150 * g + 29 * b) >> 8 AS v FROM px", ints="x y v")
def gray(spark, sf):
    return X.pixels(spark, sf).select("x", "y", S.gray().alias("v"))


_TENSOR = "SELECT x, y, 0 AS c, r AS raw FROM px UNION ALL SELECT x, y, 1, g FROM px UNION ALL SELECT x, y, 2, b FROM px"


@query(
    "SELECT t.x, t.y, c, (raw / 255.0::DOUBLE - CASE c WHEN 0 THEN 0.485::DOUBLE WHEN 1 THEN 0.456::DOUBLE ELSE 0.406::DOUBLE END) / CASE c WHEN 0 THEN 0.229::DOUBLE WHEN 1 THEN 0.224::DOUBLE ELSE 0.225::DOUBLE END AS v "
    "FROM (SELECT i % 70 AS x, i // 70 AS y, (i % 70) * w // 70 AS sx, (i // 70) * h // 70 AS sy FROM range(4900) g(i) JOIN size ON true) t JOIN (SELECT x AS ux, y AS uy, c, raw FROM (" + _TENSOR + ")) u ON ux = sx AND uy = sy",
    ints="x y c", reals="v",
)
def nchw_in(spark, sf):
    return D.to_tensor(D.resize_nearest(X.pixels(spark, sf), (W, X.height(spark, sf)), (70, 70)), standardise=True)


@query(f"SELECT x, y, c, raw / 255.0::DOUBLE AS v FROM ({_TENSOR})", ints="x y c", reals="v")
def nchw_sr(spark, sf):
    return D.to_tensor(X.pixels(spark, sf), standardise=False)


@query(
    "SELECT x, y, max(k) FILTER (WHERE c = 0) AS r, max(k) FILTER (WHERE c = 1) AS g, max(k) FILTER (WHERE c = 2) AS b, 255 AS a FROM "
    f"(SELECT x, y, c, CAST(trunc(least(greatest(raw / 255.0::DOUBLE * 1.5 - 0.2, 0), 1) * 255 + 0.5) AS BIGINT) AS k FROM ({_TENSOR})) GROUP BY x, y",
    ints="x y r g b a",
)
def rgba_out(spark, sf):
    t = D.to_tensor(X.pixels(spark, sf), standardise=False).withColumn("v", F.col("v") * 1.5 - 0.2)
    return D.from_tensor(t)


@query("SELECT x, y, r + g * 256 + b * 65536 + a * 16777216::BIGINT AS rgba, r, g, b, a FROM px", ints="x y rgba r g b a")
def rgba_pack(spark, sf):
    p = X.pixels(spark, sf).select("x", "y", S.pack_rgba().alias("rgba"))
    return p.select("x", "y", "rgba", *[c.alias(k) for c, k in zip(S.unpack_rgba("rgba"), "rgba")])


def _turbo_sql() -> str:
    def poly(c):
        out = f"{c[5]:.8f}::DOUBLE"
        for k in reversed(c[:5]):
            out = f"({out}) * t + ({k:.8f}::DOUBLE)"
        return out

    cols = ", ".join(f"CAST(trunc(least(greatest({poly(c)}, 0), 1) * 255) AS BIGINT) AS {k}" for k, c in S.TURBO.items())
    return f"SELECT x, y, {cols} FROM (SELECT x, y, least(greatest(1 - n, 0), 1) AS t FROM nd)"


@query(_turbo_sql(), ints="x y r g b")
def turbo(spark, sf):
    return D.colorize(X.depth(spark, sf))


@query("SELECT count(*) AS n, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM (" + _turbo_sql() + ")", ints="n r g b")
def turbo_show(spark, sf):
    return D.colorize(X.depth(spark, sf)).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "rgb"])


NEAR = "SELECT c.x, c.y, dx, dy, s.v FROM px9 c JOIN (VALUES (-1), (0), (1)) h(dx) ON true JOIN (VALUES (-1), (0), (1)) k(dy) ON true JOIN size ON true JOIN px9 s ON s.x = least(greatest(c.x + dx, 0), w - 1) AND s.y = least(greatest(c.y + dy, 0), h - 1)".replace("px9", "(SELECT x, y, v / 255.0::DOUBLE AS v FROM gray)")
STATS = f"SELECT x, y, max(v) FILTER (WHERE dx = 0 AND dy = 0) AS c, min(v) FILTER (WHERE dx <> 0 OR dy <> 0) AS mn, max(v) FILTER (WHERE dx <> 0 OR dy <> 0) AS mx, sum(v * CASE WHEN dx = 0 OR dy = 0 THEN 0.166666::DOUBLE ELSE 0.083333::DOUBLE END) FILTER (WHERE dx <> 0 OR dy <> 0) AS avg FROM ({NEAR}) GROUP BY x, y"


def _unit_gray(spark, sf):
    return X.gray(spark, sf).select("x", "y", (F.col("v") / 255.0).alias("v"))


@query(NEAR, ints="x y dx dy", reals="v")
def j_nbr8(spark, sf):
    return D.neighbours8(_unit_gray(spark, sf), W, X.height(spark, sf))


@query(STATS, ints="x y", reals="c mn mx avg")
def agg_cas(spark, sf):
    return D.surround_stats(_unit_gray(spark, sf), W, X.height(spark, sf))


@query(f"SELECT x, y, least(greatest(c + (c - avg) * CASE WHEN mx > 0 THEN least(greatest(least(mn, 2 - mx) / mx, 0), 1) ELSE 0 END * 0.25, 0), 1) AS v FROM ({STATS})", ints="x y", reals="v")
def r_cas(spark, sf):
    return D.sharpen(_unit_gray(spark, sf), W, X.height(spark, sf))


@query("SELECT image_id, preset, subsample, edge, use_sr, sr_scale, sort_bits FROM (SELECT DISTINCT image_id FROM feat) JOIN (VALUES (0, 'fast', 4, 0.0, false, 1, 16), (1, 'standard', 2, 0.3, false, 1, 16), (2, 'high', 1, 0.3, true, 2, 32)) t(i, preset, subsample, edge, use_sr, sr_scale, sort_bits) ON image_id % 3 = i", ints="image_id subsample sr_scale sort_bits", reals="edge", other="preset use_sr")
def n_preset(spark, sf):
    """The settings of every image by the preset that it is processed with."""
    names = F.array(*[F.lit(n) for n in ("fast", "standard", "high")])
    chosen = X.images(spark, sf).withColumn("preset", F.get(names, F.col("image_id") % 3))
    return D.with_preset(chosen)


@query("SELECT image_id FROM (SELECT DISTINCT image_id FROM feat) WHERE image_id % 3 <> 0", ints="image_id")
def n_batch(spark, sf):
    i = X.images(spark, sf)
    return D.pending(i, i.where(F.col("image_id") % 3 == 0))


@query("SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 'up' || image_id ELSE 'own' || image_id END AS data FROM (SELECT DISTINCT image_id FROM feat)", ints="image_id", other="data")
def n_srgate(spark, sf):
    i = X.images(spark, sf).withColumn("data", F.concat(F.lit("own"), "image_id"))
    up = i.where(F.col("image_id") % 2 == 0).select("image_id", F.concat(F.lit("up"), "image_id").alias("data"))
    return D.super_or_original(i, up, "high", True)


@query("SELECT image_id, count(*) AS n FROM (SELECT 1 + event_id % 3 AS image_id FROM events) WHERE image_id = 1 GROUP BY image_id", ints="image_id n")
def n_first(spark, sf):
    from voxelloom.session import table

    rows = table(spark, sf, "events").select((1 + F.col("event_id") % 3).alias("image_id"))
    return D.first_image(rows).groupBy("image_id").agg(F.count("*").alias("n"))
