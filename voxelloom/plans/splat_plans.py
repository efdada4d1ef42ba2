"""Queries of splat algebra, cameras, culling, sorting and rendering."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from voxelloom.functions import camera as CAM
from voxelloom.functions import splat as S
from voxelloom.functions.camera import Camera
from voxelloom.operators import loop as L
from voxelloom.operators import raster as R
from voxelloom.operators import scene as O
from voxelloom.plans import fixtures as X
from voxelloom.plans.registry import query

C, VW, VH = X.CAMERA, 64, 48
P10 = "x y z r g b scale_x scale_y scale_z opacity"


@query("SELECT splat_id, 1 / (1 + exp(-opacity_logit)) AS opacity FROM spl", ints="splat_id", reals="opacity")
def act_opacity(spark, sf):
    return X.splats(spark, sf).select("splat_id", S.sigmoid("opacity_logit").alias("opacity"))


@query("SELECT splat_id, exp(scale_x) AS sx, exp(scale_y) AS sy, exp(scale_z) AS sz FROM spl", ints="splat_id", reals="sx sy sz")
def act_scale(spark, sf):
    return X.splats(spark, sf).select("splat_id", *[F.exp(f"scale_{a}").alias(f"s{a}") for a in "xyz"])


@query("SELECT splat_id, 0.5 + 0.28209479::DOUBLE * sh_dc_r AS r, 0.5 + 0.28209479::DOUBLE * sh_dc_g AS g, 0.5 + 0.28209479::DOUBLE * sh_dc_b AS b FROM spl", ints="splat_id", reals="r g b")
def act_color(spark, sf):
    return X.splats(spark, sf).select("splat_id", *[S.sh_to_rgb(f"sh_dc_{c}").alias(c) for c in "rgb"])


@query("SELECT splat_id, qw, qx, qy, qz FROM cov", ints="splat_id", reals="qw qx qy qz")
def act_rot(spark, sf):
    return X.splats(spark, sf).select("splat_id", *[c.alias(f"q{k}") for k, c in zip("wxyz", S.unit_quaternion())])


@query("SELECT splat_id, c00, c01, c02, c11, c12, c22 FROM cov6", ints="splat_id", reals="c00 c01 c02 c11 c12 c22")
def cov3d(spark, sf):
    cov = S.covariance([F.exp(f"scale_{a}") for a in "xyz"], S.unit_quaternion())
    return X.splats(spark, sf).select("splat_id", *[c.alias(k) for k, c in cov.items()])


MADE = "SELECT point_id AS splat_id, x, y, z, ln({s}::DOUBLE) AS scale_x, ln({o}::DOUBLE / (1 - {o}::DOUBLE)) AS opacity_logit, (r - 0.5) / 0.28209479::DOUBLE AS sh_dc_r, (g - 0.5) / 0.28209479::DOUBLE AS sh_dc_g, (b - 0.5) / 0.28209479::DOUBLE AS sh_dc_b FROM ppts"
MADE_COLS = {"ints": "splat_id", "reals": "x y z scale_x opacity_logit sh_dc_r sh_dc_g sh_dc_b"}


@query(MADE.format(s=0.25, o=0.6), **MADE_COLS)
def mk_splat(spark, sf):
    return O.make_splats(X.part_points(spark, sf), 0.25, 0.6)


@query(MADE.format(s=0.01, o=0.8), **MADE_COLS)
def pc_to_splat(spark, sf):
    return O.make_splats(X.part_points(spark, sf), 0.01, 0.8)


@query("SELECT splat_id, " + ", ".join(P10.split()) + " FROM packed", ints="splat_id", reals=P10)
def snk_pack10(spark, sf):
    return O.pack10(X.splats(spark, sf))


def _bounds_sql(t):
    return (
        f"SELECT *, (min_x + max_x) / 2 AS centre_x, (min_y + max_y) / 2 AS centre_y, (min_z + max_z) / 2 AS centre_z, CASE WHEN half < 0.001 THEN 1 ELSE half END AS extent FROM (SELECT *, "
        f"sqrt((max_x - min_x) * (max_x - min_x) + (max_y - min_y) * (max_y - min_y) + (max_z - min_z) * (max_z - min_z)) / 2 AS half FROM (SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM {t}))"
    )


BOUNDS = "min_x min_y min_z max_x max_y max_z centre_x centre_y centre_z extent"


@query(_bounds_sql("spl"), reals=BOUNDS)
def agg_bounds(spark, sf):
    return O.bounds(X.splats(spark, sf))


@query(_bounds_sql("pts"), reals=BOUNDS)
def agg_bounds_pc(spark, sf):
    return O.bounds(X.points(spark, sf))


@query("SELECT count(*) AS n, min(x) AS min_x, max(z) AS max_z, ln(0.02::DOUBLE) AS scale_x FROM ppts", ints="n", reals="min_x max_z scale_x")
def scene_from_pc(spark, sf):
    s = O.make_splats(X.part_points(spark, sf), 0.02, 0.8)
    return s.agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("z").alias("max_z"), F.max("scale_x").alias("scale_x"))


@query("SELECT splat_id, x FROM (SELECT splat_id, CASE WHEN splat_id % 50 = 3 THEN -999999 ELSE x END AS x FROM spl) WHERE x >= -999990", ints="splat_id", reals="x")
def flt_sentinel(spark, sf):
    s = X.splats(spark, sf).withColumn("x", F.when(F.col("splat_id") % 50 == 3, -999999.0).otherwise(F.col("x")))
    return O.drop_sentinels(s).select("splat_id", "x")


_SIN = math.sin(Camera.default(VW, VH).fov_y() / 2)


@query(f"SELECT centre_x AS pos_x, centre_y AS pos_y, centre_z - greatest(extent / {_SIN!r}::DOUBLE, 0.5) AS pos_z, 1 AS fwd_z, 76.8::DOUBLE AS focal FROM ({_bounds_sql('spl')})", reals="pos_x pos_y pos_z fwd_z focal")
def fit_cam(spark, sf):
    return O.fit_camera(X.splats(spark, sf), VW, VH)


@query(f"SELECT centre_x AS pos_x, centre_y AS pos_y, centre_z - greatest(extent / {_SIN!r}::DOUBLE, 0.5) AS pos_z, atan2(0.0::DOUBLE, -1.0::DOUBLE) AS yaw, 0 AS pitch, greatest(0.05::DOUBLE * extent, 0.1) AS move_speed FROM ({_bounds_sql('spl')})", reals="pos_x pos_y pos_z yaw pitch move_speed")
def fit_ctrl(spark, sf):
    return O.fit_controls(X.splats(spark, sf), VW, VH)


def _frame_cameras(spark, sf):
    """A camera for every frame event: where it is and looks, and its size and focal length by its number."""
    e = F.col("frame_id")
    return X.frames(spark, sf).withColumn("px", F.col("px") * F.sqrt(F.lit(2.0))).select("frame_id", *FR_POSE, (320 + e % 7 * 40).alias("w"), (240 + e % 5 * 30).alias("h"), (300.0 + e % 11 * 25).alias("focal"))


FR_POSE = ("px", "py", "pz", "fx", "fy", "fz")
_CAMS = "SELECT * REPLACE (px * sqrt(2) AS px), sqrt(fx * fx + fy * fy + fz * fz) AS len, 320 + frame_id % 7 * 40 AS w, 240 + frame_id % 5 * 30 AS h, 300.0::DOUBLE + frame_id % 11 * 25 AS focal FROM frames"
#: Right is up x backward, up is backward x right; both for an upright camera, with backward = -forward / length.
_AXES = f"SELECT *, b2 / rl AS r0, 0::DOUBLE AS r1, -b0 / rl AS r2 FROM (SELECT *, sqrt(b0 * b0 + b2 * b2) AS rl FROM (SELECT *, -fx / len AS b0, -fy / len AS b1, -fz / len AS b2 FROM ({_CAMS})))"
_VIEW = f"SELECT frame_id, r0, r2, u0, u1, u2, b0, b1, b2, -(r0 * px + r2 * pz) AS t0, -(u0 * px + u1 * py + u2 * pz) AS t1, -(b0 * px + b1 * py + b2 * pz) AS t2 FROM (SELECT *, b1 * r2 AS u0, b2 * r0 - b0 * r2 AS u1, -b1 * r0 AS u2 FROM ({_AXES}))"


@query(_VIEW, ints="frame_id", reals="r0 r2 u0 u1 u2 b0 b1 b2 t0 t1 t2")
def view_mtx(spark, sf):
    c = _frame_cameras(spark, sf)
    r, t = CAM.view_columns([F.col(k) for k in FR_POSE[:3]], [F.col(k) for k in FR_POSE[3:]])
    names = ("r0", "r1", "r2", "u0", "u1", "u2", "b0", "b1", "b2")
    return c.select("frame_id", *[v.alias(k) for v, k in zip([x for row in r for x in row], names)], *[v.alias(f"t{i}") for i, v in enumerate(t)])


@query(f"SELECT frame_id, 2 * focal / w AS a, 2 * focal / h AS b, 1 - 2 * (w / 2.5::DOUBLE) / w AS c, 2 * (h / 1.5::DOUBLE) / h - 1 AS d, -1000.1::DOUBLE / 999.9::DOUBLE AS e, -200.0::DOUBLE / 999.9::DOUBLE AS f FROM ({_CAMS})", ints="frame_id", reals="a b c d e f")
def proj_mtx(spark, sf):
    c = _frame_cameras(spark, sf)
    m = CAM.projection_columns(F.col("w"), F.col("h"), F.col("focal"), F.col("w") / 2.5, F.col("h") / 1.5)
    return c.select("frame_id", *[m[i][j].alias(k) for k, (i, j) in zip("abcdef", ((0, 0), (1, 1), (0, 2), (1, 2), (2, 2), (2, 3)))])


@query(f"SELECT frame_id, 2 * focal / h / (w / h) AS a, 2 * focal / h AS b, 100 / (0.1::DOUBLE - 100) AS c, 10 / (0.1::DOUBLE - 100) AS d FROM ({_CAMS})", ints="frame_id", reals="a b c d")
def proj_gpu(spark, sf):
    c = _frame_cameras(spark, sf)
    m = CAM.perspective_columns(2 * F.atan(F.col("h") / (2 * F.col("focal"))), F.col("w") / F.col("h"), 0.1, 100.0)
    return c.select("frame_id", *[m[i][j].alias(k) for k, (i, j) in zip("abcd", ((0, 0), (1, 1), (2, 2), (2, 3)))])


@query(
    "SELECT frame_id, cos(a) / tan(pi() / 8) * 0.75::DOUBLE AS m00, cos(p) / tan(pi() / 8) AS m11, 0 AS m03, (100 * d - 1) / 99.99::DOUBLE AS m23, d AS m33 "
    "FROM (SELECT frame_id, frame_id % 63 / 10.0::DOUBLE AS a, frame_id % 29 / 10.0::DOUBLE - 1.4 AS p, 1 + frame_id % 13 AS d FROM frames)",
    ints="frame_id", reals="m00 m11 m03 m23 m33",
)
def orbit(spark, sf):
    """A camera on a sphere for every frame; the last column is where the origin lands in clip space."""
    e = F.col("frame_id")
    m = CAM.orbit_columns(e % 63 / 10.0, e % 29 / 10.0 - 1.4, 1 + e % 13, F.lit(4 / 3))
    return X.frames(spark, sf).select("frame_id", *[m[i][j].alias(f"m{i}{j}") for i, j in ((0, 0), (1, 1), (0, 3), (2, 3), (3, 3))])


@query("SELECT 0 AS camera_id, 1.2::DOUBLE * greatest(w, h) AS fx, w / 2 AS cx, h / 2 AS cy, 3 AS pos_z, -1 AS fwd_z FROM size", ints="camera_id", reals="fx cx cy pos_z fwd_z")
def cam_default(spark, sf):
    c = Camera.default(X.WIDTH, X.height(spark, sf))
    return spark.createDataFrame([(0, c.focal, c.cx, c.cy, c.position[2], c.forward[2])], "camera_id int, fx double, cx double, cy double, pos_z double, fwd_z double")


_PLANES = C.planes()
_CULL = " AND ".join(f"{a!r}::DOUBLE * x + {b!r}::DOUBLE * y + {c!r}::DOUBLE * z + {d!r}::DOUBLE >= -3 * scale_x" for a, b, c, d in _PLANES.tolist())


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE {a!r}::DOUBLE * x + {b!r}::DOUBLE * y + {c!r}::DOUBLE * z + {d!r}::DOUBLE >= 0) AS p{i}" for i, (a, b, c, d) in enumerate(_PLANES.tolist())) + " FROM packed", ints="p0 p1 p2 p3 p4 p5")
def planes(spark, sf):
    inside = [float(a) * F.col("x") + float(b) * F.col("y") + float(c) * F.col("z") + float(d) >= 0 for a, b, c, d in _PLANES]
    return O.pack10(X.splats(spark, sf)).agg(*[F.count(F.when(p, 1)).alias(f"p{i}") for i, p in enumerate(inside)])


@query(f"SELECT splat_id, z FROM packed WHERE opacity > 0 AND {_CULL}", ints="splat_id", reals="z")
def flt_frustum(spark, sf):
    return O.pack10(X.splats(spark, sf)).where(O.in_frustum(_PLANES)).select("splat_id", "z")


@query("SELECT splat_id, CAST(trunc(least(z * 500, 65534)) AS BIGINT) AS k16, CAST(trunc(least(z * 10000, 2147483647)) AS BIGINT) AS k32 FROM packed", ints="splat_id k16 k32")
def quant_depth(spark, sf):
    return O.pack10(X.splats(spark, sf)).select("splat_id", S.depth_key(F.col("z"), 16).alias("k16"), S.depth_key(F.col("z"), 32).alias("k32"))


def _sorted_sql(scale, top):
    return f"SELECT splat_id, CAST(trunc(least(greatest(z, 0) * {scale}, {top})) AS BIGINT) AS key FROM packed WHERE opacity > 0 AND {_CULL}"


def _ranked(sql):
    return f"SELECT *, row_number() OVER (ORDER BY key DESC, splat_id) AS place FROM ({sql})"


def _place(df):
    """The position of each row in sorted order, for the comparison only: it needs one task."""
    from pyspark.sql import Window

    return df.withColumn("place", F.row_number().over(Window.orderBy(F.desc("key"), "splat_id")))


@query(_ranked(_sorted_sql(10000, 2147483647)), ints="splat_id key place")
def s_radix32(spark, sf):
    return _place(O.sort_splats(O.pack10(X.splats(spark, sf)), C, 32))


@query(_ranked(_sorted_sql(500, 65534)), ints="splat_id key place")
def s_radix16(spark, sf):
    return _place(O.sort_splats(O.pack10(X.splats(spark, sf)), C, 16))


@query(_sorted_sql(10000, 2147483647), ints="splat_id key")
def s_sort(spark, sf):
    return O.sort_splats(O.pack10(X.splats(spark, sf)), C)


@query(_sorted_sql(500, 65534), ints="splat_id key")
def s_cullkey(spark, sf):
    p = O.pack10(X.splats(spark, sf)).where(O.in_frustum(_PLANES))
    return p.withColumn("key", S.depth_key(F.greatest(O.view_distance(C), F.lit(0.0)), 16))


_M = C.mvp().tolist()
_CLIP = "SELECT *, " + ", ".join(f"{r[0]!r}::DOUBLE * x + {r[1]!r}::DOUBLE * y + {r[2]!r}::DOUBLE * z + {r[3]!r}::DOUBLE AS c{k}" for r, k in zip(_M, "xyzw")) + " FROM packed"
_NDC = f"SELECT splat_id, cx / cw AS ndc_x, cy / cw AS ndc_y, cz / cw AS ndc_z, greatest(greatest(scale_x, 0.001) * 76.8::DOUBLE / cw, 0.8) AS radius_x, greatest(greatest(scale_y, 0.001) * 76.8::DOUBLE / cw, 0.8) AS radius_y FROM ({_CLIP}) WHERE cw > 0.001"
_ON = f"SELECT * FROM (SELECT *, 3 * greatest(radius_x * 2 / 64, radius_y * 2 / 48) AS reach FROM ({_NDC})) WHERE ndc_x + reach >= -1 AND ndc_x - reach <= 1 AND ndc_y + reach >= -1 AND ndc_y - reach <= 1 AND ndc_z BETWEEN -0.1 AND 1.1"


@query(_ON, ints="splat_id", reals="ndc_x ndc_y ndc_z radius_x radius_y")
def vs_splat(spark, sf):
    return O.clip_splats(O.pack10(X.splats(spark, sf)), C)


@query(f"SELECT count(*) AS n, min(splat_id) AS first_id, max(ndc_z) AS far_z FROM ({_ON})", ints="n first_id", reals="far_z")
def flt_ndc(spark, sf):
    return O.clip_splats(O.pack10(X.splats(spark, sf)), C).agg(F.count("*").alias("n"), F.min("splat_id").alias("first_id"), F.max("ndc_z").alias("far_z"))


_CLOUD = "SELECT point_id, (x - (lx + hx) / 2) / span AS x, (y - (ly + hy) / 2) / span AS y, (z - (lz + hz) / 2) / span AS z FROM ppts, (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z), 0.01) AS span FROM ppts)"
_CORNERS = "(VALUES (0, -1.0, -1.0), (1, 1.0, -1.0), (2, -1.0, 1.0), (3, -1.0, 1.0), (4, 1.0, -1.0), (5, 1.0, 1.0)) k(corner, u, v)"


@query(f"SELECT point_id, corner, x, y, z, u * 0.01 AS u, v * 0.01 AS v FROM ({_CLOUD}) JOIN {_CORNERS} ON true", ints="point_id corner", reals="x y z u v")
def snk_cloud(spark, sf):
    return O.cloud_vertices(X.part_points(spark, sf))


@query(f"SELECT point_id, corner, x + u * 0.02 AS vx, y + v * 0.02 AS vy FROM ({_CLOUD}) JOIN {_CORNERS} ON true", ints="point_id corner", reals="vx vy")
def vs_cloud(spark, sf):
    v = O.cloud_vertices(X.part_points(spark, sf), 0.02)
    return v.select("point_id", "corner", (F.col("x") + F.col("u")).alias("vx"), (F.col("y") + F.col("v")).alias("vy"))


PROJ = "screen_x screen_y depth cov00 cov01 cov11 r g b opacity"


@query("SELECT splat_id, " + PROJ.replace(" ", ", ") + " FROM proj", ints="splat_id", reals=PROJ)
def project2d(spark, sf):
    return R.project(X.splats(spark, sf), C)


@query("SELECT splat_id, z AS depth FROM spl WHERE z > 3.81 AND z < 3.83", ints="splat_id", reals="depth")
def flt_near(spark, sf):
    c = Camera.default(64, 48, position=(0.0, 0.0, 0.0), forward=(0.0, 0.0, 1.0), near=3.81, far=3.83)
    return R.project(X.splats(spark, sf), c).select("splat_id", "depth")


@query("SELECT splat_id, screen_x, screen_y FROM vis", ints="splat_id", reals="screen_x screen_y")
def flt_visible(spark, sf):
    return R.visible(R.project(X.splats(spark, sf), C), VW, VH)


@query("SELECT splat_id, min_x, min_y, max_x, max_y FROM box", ints="splat_id min_x min_y max_x max_y")
def screen_box(spark, sf):
    return R.screen_box(R.visible(R.project(X.splats(spark, sf), C), VW, VH), VW, VH)


def _frag(spark, sf):
    return R.splat_pixels(R.project(X.splats(spark, sf), C), VW, VH)


@query("SELECT splat_id, x, y, alpha FROM frag", ints="splat_id x y", reals="alpha")
def j_splat_px(spark, sf):
    return _frag(spark, sf)


@query("SELECT splat_id, count(*) AS n FROM frag WHERE alpha >= 0.002 GROUP BY splat_id", ints="splat_id n")
def flt_frag(spark, sf):
    return _frag(spark, sf).where("alpha >= 0.002").groupBy("splat_id").agg(F.count("*").alias("n"))


@query("SELECT * FROM image", ints="x y", reals="r g b a")
def w_alpha(spark, sf):
    return R.composite(_frag(spark, sf))


_CHAIN = ("spl", "cov", "cov6", "proj", "rad", "vis", "box", "frag", "image")
for _n in _CHAIN[1:]:  # the same picture of the changed scene
    X.CTE[f"{_n}_b"] = re.sub(rf"\b(FROM|JOIN) ({'|'.join(_CHAIN)})\b", r"\1 \2_b", X.CTE[_n])
X.CTE["spl_b"] = "SELECT * REPLACE (CASE WHEN splat_id % 37 = 0 THEN x + 0.3 ELSE x END AS x, CASE WHEN splat_id % 37 = 0 THEN sh_dc_r + 0.5 ELSE sh_dc_r END AS sh_dc_r) FROM spl WHERE splat_id % 53 <> 1"


def _changes(spark, sf):
    s = X.splats(spark, sf)
    put = s.where("splat_id % 37 = 0 and splat_id % 53 <> 1").withColumns({"x": F.col("x") + 0.3, "sh_dc_r": F.col("sh_dc_r") + 0.5})
    return s, put, s.where("splat_id % 53 = 1").select("splat_id")


@query("SELECT * FROM image_b", ints="x y", reals="r g b a")
def r_changed(spark, sf):
    """The frame after a change, of which only dirty tiles were drawn again."""
    s, put, gone = _changes(spark, sf)
    loop = L.RenderLoop(C)
    loop.show(s)
    return loop.change(put, gone)


@query("SELECT 0 AS version, count(*) AS lit, sum(r) AS r, sum(a) AS a FROM image UNION ALL SELECT 1, count(*), sum(r), sum(a) FROM image_b UNION ALL SELECT 2, count(*), sum(r), sum(a) FROM image_b", ints="version lit", reals="r a")
def r_loop(spark, sf):
    """Frames of a loop: nothing to show, a scene, a change, and no change."""
    s, put, gone = _changes(spark, sf)
    loop, out = L.RenderLoop(C), []
    loop.show(s.limit(0))
    for f in (lambda: loop.show(s), lambda: loop.change(put, gone), lambda: loop.look(C)):
        out.append(f().agg(F.count("*").alias("lit"), F.round(F.sum("r"), 6).alias("r"), F.round(F.sum("a"), 6).alias("a")).first())
    return spark.createDataFrame([(i, *r) for i, r in enumerate(out)], "version int, lit long, r double, a double")


@query("SELECT x, y, sum(alpha * t * r) AS r, sum(alpha * t * g) AS g, sum(alpha * t * b) AS b, 1 - min(t * (1 - alpha)) AS a FROM (SELECT *, coalesce(product(1 - alpha) OVER (PARTITION BY x, y ORDER BY depth, splat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS t FROM frag WHERE alpha >= 0.002) GROUP BY x, y", ints="x y", reals="r g b a")
def w_blend(spark, sf):
    return R.blend_back_to_front(_frag(spark, sf))


_ISO = f"SELECT splat_id, 76.8::DOUBLE * -x / z + 32 AS screen_x, 76.8::DOUBLE * -y / z + 24 AS screen_y, z AS depth, s * s + 0.3::DOUBLE AS cov, 1 / (1 + exp(-sh_dc_r)) AS r, 1 / (1 + exp(-opacity_logit)) AS opacity FROM (SELECT *, 76.8::DOUBLE * (exp(scale_x) + exp(scale_y) + exp(scale_z)) / 3 / z AS s FROM spl WHERE z > 0.1 AND z < 100)"
_ISOB = f"SELECT *, greatest(0, CAST(trunc(screen_x - rad) AS BIGINT)) AS min_x, greatest(0, CAST(trunc(screen_y - rad) AS BIGINT)) AS min_y, least(63, CAST(trunc(screen_x + rad) AS BIGINT)) AS max_x, least(47, CAST(trunc(screen_y + rad) AS BIGINT)) AS max_y FROM (SELECT *, 3 * sqrt(cov + sqrt(0.1::DOUBLE)) AS rad FROM ({_ISO})) WHERE opacity >= 1.0::DOUBLE / 255 AND screen_x + rad >= 0 AND screen_x - rad < 64 AND screen_y + rad >= 0 AND screen_y - rad < 48"
_ISOF = f"SELECT splat_id, x, y, depth, r, least(0.99::DOUBLE, opacity * exp(p)) AS alpha FROM (SELECT *, -0.5 * ((x + 0.5 - screen_x) * (x + 0.5 - screen_x) + (y + 0.5 - screen_y) * (y + 0.5 - screen_y)) / cov AS p FROM ({_ISOB}) JOIN range(64) h(x) ON x BETWEEN min_x AND max_x JOIN range(48) v(y) ON y BETWEEN min_y AND max_y) WHERE p >= -4 AND least(0.99::DOUBLE, opacity * exp(p)) >= 1.0::DOUBLE / 255"


@query(f"SELECT x, y, sum(alpha * t * r) AS r, 1 - min(t * (1 - alpha)) AS a FROM (SELECT *, coalesce(product(1 - alpha) OVER (PARTITION BY x, y ORDER BY depth, splat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS t FROM ({_ISOF})) WHERE t >= 0.004 GROUP BY x, y", ints="x y", reals="r a")
def w_alpha_tr(spark, sf):
    return R.composite(R.splat_pixels(R.trainer_project(X.splats(spark, sf), C), VW, VH))


@query("SELECT x, y, " + ", ".join(f"CAST(trunc(least(greatest({c} * 255, 0), 255)) AS BIGINT) AS {c}" for c in "rgba") + " FROM image", ints="x y r g b a")
def snk_frame(spark, sf):
    return R.render(X.splats(spark, sf), C)


@query("SELECT count(*) AS lit, sum(CAST(trunc(r * 255) AS BIGINT)) AS red FROM image", ints="lit red")
def r_frame(spark, sf):
    return R.render(X.splats(spark, sf), C).agg(F.count("*").alias("lit"), F.sum("r").alias("red"))


@query("SELECT splat_id, depth, row_number() OVER (ORDER BY depth, splat_id) AS place FROM vis", ints="splat_id place", reals="depth")
def s_front(spark, sf):
    from pyspark.sql import Window

    v = R.visible(R.project(X.splats(spark, sf), C), VW, VH)
    return v.withColumn("place", F.row_number().over(Window.orderBy("depth", "splat_id")))


@query("SELECT CAST(trunc(sx) AS BIGINT) AS x, CAST(trunc(sy) AS BIGINT) AS y, arg_min(point_id, (z, point_id)) AS point_id, min(z) AS depth, count(*) AS n FROM (SELECT *, 76.8::DOUBLE * -x / z + 32 AS sx, 76.8::DOUBLE * -y / z + 24 AS sy FROM ppts WHERE z > 0.1 AND z < 1000) WHERE sx >= 0 AND sx < 64 AND sy >= 0 AND sy < 48 GROUP BY 1, 2", ints="x y point_id n", reals="depth")
def r_cloud(spark, sf):
    return R.nearest_points(X.part_points(spark, sf), C)


@query("SELECT splat_id, " + ", ".join(P10.split()) + " FROM packed", ints="splat_id", reals=P10)
def j_permute(spark, sf):
    p = O.pack10(X.splats(spark, sf))
    order = O.sort_splats(p, C).select("splat_id")
    rest = p.join(order, "splat_id", "left_anti")
    return p.join(order.unionByName(rest.select("splat_id")), "splat_id")


@query("SELECT splat_id, cos(p) * sin(w) AS fx, sin(p) AS fy, -cos(p) * cos(w) AS fz FROM (SELECT splat_id, splat_id % 63 / 10.0::DOUBLE AS w, splat_id % 29 / 10.0::DOUBLE - 1.4::DOUBLE AS p FROM spl)", ints="splat_id", reals="fx fy fz")
def yaw_pitch(spark, sf):
    i = F.col("splat_id")
    return X.splats(spark, sf).select("splat_id", *[c.alias(f"f{k}") for k, c in zip("xyz", S.yaw_pitch_forward(i % 63 / 10.0, i % 29 / 10.0 - 1.4))])


_R = [[0.8, -0.6, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0]]
_T = [0.5, -1.0, 2.0]


@query("SELECT point_id, 0.8 * x - 0.6 * y + 0.5 AS cx, 0.6 * x + 0.8 * y - 1.0 AS cy, z + 2.0 AS cz FROM ppts", ints="point_id", reals="cx cy cz")
def xform(spark, sf):
    return X.part_points(spark, sf).select("point_id", *[c.alias(f"c{k}") for k, c in zip("xyz", S.transform_point(_R, _T, [F.col(a) for a in "xyz"]))])


@query("SELECT point_id, -(0.8 * x + 0.6 * y) AS cx, 0.6 * x - 0.8 * y AS cy, -z AS cz FROM ppts", ints="point_id", reals="cx cy cz")
def centre(spark, sf):
    return X.part_points(spark, sf).select("point_id", *[c.alias(f"c{k}") for k, c in zip("xyz", S.camera_centre(_R, [F.col(a) for a in "xyz"]))])


def _turn(a):
    """Rotation about z by the column's angle."""
    c, s = F.cos(a), F.sin(a)
    return [[c, -s, F.lit(0.0)], [s, c, F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]


@query("SELECT point_id, 0 AS ax, 0 AS ay, point_id % 31 / 10.0::DOUBLE AS az FROM ppts", ints="point_id", reals="ax ay az")
def aa_from_R(spark, sf):
    return X.part_points(spark, sf).select("point_id", *[c.alias(f"a{k}") for k, c in zip("xyz", S.angle_axis(_turn(F.col("point_id") % 31 / 10.0)))])


@query("SELECT point_id, cos(a) AS r00, -sin(a) AS r01, sin(a) AS r10, cos(a) AS r11, 1 AS r22 FROM (SELECT point_id, point_id % 31 / 10.0::DOUBLE AS a FROM ppts)", ints="point_id", reals="r00 r01 r10 r11 r22")
def R_from_aa(spark, sf):
    r = S.rotation_from_angle_axis([F.lit(0.0), F.lit(0.0), F.col("point_id") % 31 / 10.0])
    return X.part_points(spark, sf).select("point_id", r[0][0].alias("r00"), r[0][1].alias("r01"), r[1][0].alias("r10"), r[1][1].alias("r11"), r[2][2].alias("r22"))


@query("SELECT splat_id, c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02) AS det FROM (SELECT splat_id, c00 * 1e4 AS c00, c01 * 1e4 AS c01, c02 * 1e4 AS c02, c11 * 1e4 AS c11, c12 * 1e4 AS c12, c22 * 1e4 AS c22 FROM cov6)", ints="splat_id", reals="det")
def det3(spark, sf):
    c = S.covariance([F.exp(f"scale_{a}") * 100.0 for a in "xyz"], S.unit_quaternion())
    m = [[c["c00"], c["c01"], c["c02"]], [c["c01"], c["c11"], c["c12"]], [c["c02"], c["c12"], c["c22"]]]
    return X.splats(spark, sf).select("splat_id", S.det3(m).alias("det"))


@query("SELECT point_id, (d * f - 0.25) / det AS i00, (0.5 * 0.25 - 0.5 * f) / det AS i01, (a * d - 0.25) / det AS i22 FROM (SELECT *, a * (d * f - 0.25) - 0.5 * (0.5 * f - 0.25 * 0.5) + 0.25 * (0.25 - 0.25 * d) AS det FROM (SELECT point_id, x * x + 3 AS a, y * y + 4 AS d, z + 5 AS f FROM ppts))", ints="point_id", reals="i00 i01 i22")
def m_inv3(spark, sf):
    v = S.symmetric_inverse3(F.col("x") * F.col("x") + 3, F.lit(0.5), F.lit(0.25), F.col("y") * F.col("y") + 4, F.lit(0.5), F.col("z") + 5)
    return X.part_points(spark, sf).select("point_id", v[0].alias("i00"), v[1].alias("i01"), v[5].alias("i22"))


@query("SELECT point_id, coalesce(r / 255.0::DOUBLE, 1) AS r, coalesce(b / 255.0::DOUBLE, 1) AS b FROM (SELECT point_id, least(greatest(CAST(trunc(x * 100) AS BIGINT), 0), 99) AS px, least(greatest(CAST(trunc(z * 10) AS BIGINT), 0), 99) AS py FROM ppts) q LEFT JOIN (SELECT x AS ux, y AS uy, r, b FROM px) u ON ux = q.px AND uy = q.py", ints="point_id", reals="r b")
def pix_color(spark, sf):
    p = X.part_points(spark, sf).select("point_id", S.clamp(F.col("x") * 100, 0.0, 99.0).cast("int").alias("x"), S.clamp(F.col("z") * 10, 0.0, 99.0).cast("int").alias("y"))
    return p.join(X.pixels(spark, sf).select("x", "y", "r", "b"), ["x", "y"], "left").select("point_id", *[F.coalesce(F.col(c) / 255.0, F.lit(1.0)).alias(c) for c in "rb"])
