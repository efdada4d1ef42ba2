"""Queries of point-cloud statistics, geometry filters and bundle sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions import splat as S
from voxelloom.operators import cloud as P
from voxelloom.plans import fixtures as X
from voxelloom.plans.registry import query

XYZ = ("x", "y", "z")


def _q(axis, t="pts"):
    return f"(SELECT list_sort(list({axis}))[len(list({axis})) // 4 + 1] AS q1{axis}, list_sort(list({axis}))[3 * len(list({axis})) // 4 + 1] AS q3{axis}, count(*) AS n{axis} FROM {t})"


_KEEP = " AND ".join(f"{a} BETWEEN q1{a} - 2 * (q3{a} - q1{a}) AND q3{a} + 2 * (q3{a} - q1{a})" for a in XYZ)


@query("SELECT point_id, x, y, z FROM pts, " + ", ".join(_q(a) for a in XYZ) + f" WHERE nx < 20 OR ({_KEEP})", ints="point_id", reals="x y z")
def flt_iqr2(spark, sf):
    return P.drop_outliers(X.points(spark, sf))


@query(f"SELECT point_id, z FROM pts, {_q('z')} WHERE z BETWEEN greatest(q1z - 3 * (q3z - q1z), 0.1) AND q3z + 3 * (q3z - q1z)", ints="point_id", reals="z")
def flt_iqr3z(spark, sf):
    return P.depth_band(X.points(spark, sf))


COV = "c_xx c_xy c_xz c_yy c_yz c_zz"


@query("SELECT count(*) AS n, " + ", ".join(f"covar_pop({k[2]}, {k[3]}) AS {k}" for k in COV.split()) + " FROM pts", ints="n", reals=COV)
def agg_cov(spark, sf):
    return P.covariance(X.points(spark, sf))


#: Eigenvalues of a symmetric matrix (c_xx to c_zz) in closed form: e1 >= e2 >= e3.
def eigen_sql(table: str) -> str:
    q = f"SELECT *, (c_xx + c_yy + c_zz) / 3 AS q_, c_xy * c_xy + c_xz * c_xz + c_yz * c_yz AS off_ FROM ({table})"
    p_ = f"SELECT *, sqrt(((c_xx - q_) ** 2 + (c_yy - q_) ** 2 + (c_zz - q_) ** 2 + 2 * off_) / 6) AS p_ FROM ({q})"
    det = "(c_xx - q_) * ((c_yy - q_) * (c_zz - q_) - c_yz * c_yz) - c_xy * (c_xy * (c_zz - q_) - c_yz * c_xz) + c_xz * (c_xy * c_yz - (c_yy - q_) * c_xz)"
    f_ = f"SELECT *, CASE WHEN p_ > 0 THEN acos(least(greatest(({det}) / (2 * p_ ** 3), -1), 1)) / 3 ELSE 0 END AS f_ FROM ({p_})"
    return f"SELECT *, q_ + 2 * p_ * cos(f_) AS e1, q_ + 2 * p_ * cos(f_ - 2 * pi() / 3) AS e2, q_ + 2 * p_ * cos(f_ + 2 * pi() / 3) AS e3 FROM ({f_})"


@query("SELECT n, CASE WHEN e1 > 0 THEN e3 / e1 ELSE 0 END AS ratio FROM (" + eigen_sql("SELECT count(*) AS n, " + ", ".join(f"covar_pop({k[2]}, {k[3]}) AS {k}" for k in COV.split()) + " FROM pts") + ")", ints="n", reals="ratio")
def agg_pca(spark, sf):
    return P.pca(X.points(spark, sf))


@query("SELECT *, least(std_x, std_y, std_z) / greatest(std_x, std_y, std_z) < 0.15 AS planar FROM (SELECT " + ", ".join(f"avg({a}) AS mean_{a}, stddev_pop({a}) AS std_{a}" for a in XYZ) + " FROM pts)", reals="mean_x mean_y mean_z std_x std_y std_z", other="planar")
def agg_std(spark, sf):
    return P.spread(X.points(spark, sf))


@query("SELECT " + ", ".join(f"max({a}) - min({a}) AS range_{a}" for a in XYZ) + " FROM pts", reals="range_x range_y range_z")
def agg_range(spark, sf):
    return P.ranges(X.points(spark, sf))


SHAPE = "SELECT *, list_sort([extent_x, extent_y, extent_z])[2] AS median_extent FROM (SELECT " + ", ".join(f"greatest(max({a}) - min({a}), 0.01) AS extent_{a}" for a in XYZ) + " FROM pts)"


@query(SHAPE, reals="extent_x extent_y extent_z median_extent")
def agg_cloud(spark, sf):
    return P.cloud_shape(X.points(spark, sf))


@query(f"SELECT median_extent FROM ({SHAPE})", reals="median_extent")
def s_median3(spark, sf):
    return P.cloud_shape(X.points(spark, sf)).select("median_extent")


@query("SELECT count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y, avg(z) AS mean_z, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rms FROM pts", ints="n", reals="mean_x mean_y mean_z rms")
def agg_gt(spark, sf):
    return P.centroid_spread(X.points(spark, sf))


@query("SELECT CAST(y AS BIGINT) // 10 AS g, count(*) AS n, list_sort(list(x))[count(*) // 2 + 1] AS median FROM (SELECT x, trunc(y) AS y FROM pts) GROUP BY 1", ints="g n", reals="median")
def agg_median(spark, sf):
    return P.upper_median(X.points(spark, sf).withColumn("g", F.expr("cast(y as bigint) div 10")), ["g"], "x")


_TRACK = "SELECT point_id AS k, x AS ax, y AS ay, z AS az, 1.25 * x + 1 AS bx, 1.25 * y + 0.001 * (point_id % 7) AS by_, 1.25 * z AS bz FROM ppts"


@query(
    "SELECT CASE WHEN count(*) >= 3 THEN least(greatest(list_sort(list(db / da))[count(*) // 2 + 1], 0.5), 2) ELSE 1 END AS scale FROM "
    "(SELECT sqrt((a.ax - b.ax) ** 2 + (a.ay - b.ay) ** 2 + (a.az - b.az) ** 2) AS da, sqrt((a.bx - b.bx) ** 2 + (a.by_ - b.by_) ** 2 + (a.bz - b.bz) ** 2) AS db "
    f"FROM (SELECT *, row_number() OVER (ORDER BY k) AS i FROM ({_TRACK}) QUALIFY i <= 33) a JOIN (SELECT *, row_number() OVER (ORDER BY k) AS i FROM ({_TRACK}) QUALIFY i <= 33) b ON a.i < b.i ORDER BY b.i, a.i LIMIT 500) WHERE da > 0.001 AND db > 0.001",
    reals="scale",
)
def agg_scale(spark, sf):
    p = X.part_points(spark, sf)
    return P.scale_ratio(p.select(F.col("point_id").alias("k"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), (1.25 * F.col("x") + 1).alias("bx"), (1.25 * F.col("y") + 0.001 * (F.col("point_id") % 7)).alias("by"), (1.25 * F.col("z")).alias("bz")))


NN = "SELECT avg(d) AS mean_nn FROM (SELECT min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS d FROM (SELECT * FROM ppts ORDER BY point_id LIMIT 100) a JOIN ppts b ON a.point_id <> b.point_id GROUP BY a.point_id)"


@query(NN, reals="mean_nn")
def j_knn1(spark, sf):
    return P.mean_nearest(X.part_points(spark, sf))


@query("SELECT avg(d) AS mean_nn FROM (SELECT min(d) AS d FROM (SELECT a.point_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM (SELECT * FROM ppts ORDER BY point_id LIMIT 200) a JOIN (SELECT * FROM ppts ORDER BY point_id LIMIT 500) b ON a.point_id <> b.point_id) WHERE d > 0 GROUP BY point_id)", reals="mean_nn")
def j_knn1_depth(spark, sf):
    return P.mean_nearest(X.part_points(spark, sf), 200, 500, apart=True)


@query("SELECT seq, sqrt((x - nx) ** 2 + (y - ny) ** 2 + (z - nz) ** 2) AS gap FROM (SELECT point_id AS seq, x, y, z, " + ", ".join(f"coalesce(lead({a}) OVER (ORDER BY point_id), first_value({a}) OVER (ORDER BY point_id)) AS n{a}" for a in XYZ) + " FROM ppts)", ints="seq", reals="gap")
def w_seqdist(spark, sf):
    return P.circular_gaps(X.part_points(spark, sf).withColumnRenamed("point_id", "seq"))


# A second camera a unit to the right: points are seen from both.
_TWO = "SELECT point_id, x, y, z, x / z AS ua, y / z AS va, (x - 1) / z AS ub, y / z AS vb FROM ppts"


def _seen(spark, sf):
    z = F.col("z")
    return X.part_points(spark, sf).select("point_id", *XYZ, (F.col("x") / z).alias("ua"), (F.col("y") / z).alias("va"), ((F.col("x") - 1) / z).alias("ub"), (F.col("y") / z).alias("vb"))


@query("SELECT point_id, z, 0.9 * z - 0.3 * x AS zb FROM ppts WHERE z > 0 AND 0.9 * z - 0.3 * x > 4", ints="point_id", reals="z zb")
def flt_cheiral(spark, sf):
    p = X.part_points(spark, sf).withColumn("zb", 0.9 * F.col("z") - 0.3 * F.col("x"))
    return p.where((F.col("z") > 0) & (F.col("zb") > 4))


@query("SELECT point_id, angle FROM (SELECT point_id, degrees(acos(least(greatest((x * (x - 1) + y * y + z * z) / sqrt((x * x + y * y + z * z) * ((x - 1) * (x - 1) + y * y + z * z)), -1), 1))) AS angle FROM ppts) WHERE angle >= 12", ints="point_id", reals="angle")
def flt_angle(spark, sf):
    p = X.part_points(spark, sf)
    a, b = [F.col(c) for c in XYZ], [F.col("x") - 1, F.col("y"), F.col("z")]
    return p.withColumn("angle", P.ray_angle(a, b)).where("angle >= 12")


_ERR = "SELECT point_id, CASE WHEN z >= 1e-4 THEN sqrt((ua + 0.01 * (point_id % 5) - x / z) ** 2 + (va - y / z) ** 2) END AS error FROM (" + _TWO + ")"


def _errors(spark, sf):
    s, z = _seen(spark, sf), F.col("z")
    du, dv = F.col("ua") + 0.01 * (F.col("point_id") % 5) - F.col("x") / z, F.col("va") - F.col("y") / z
    return s.select("point_id", F.when(z >= 1e-4, F.sqrt(du * du + dv * dv)).alias("error"))


@query(_ERR, ints="point_id", reals="error")
def m_reproj(spark, sf):
    return _errors(spark, sf)


@query(f"SELECT avg(error * error) AS mse FROM ({_ERR})", reals="mse")
def m_rperr(spark, sf):
    return _errors(spark, sf).agg(F.avg(F.col("error") * F.col("error")).alias("mse"))


@query(f"SELECT sqrt(sum(error * error) / (2 * count(*))) AS rms FROM ({_ERR})", reals="rms")
def agg_rms(spark, sf):
    return _errors(spark, sf).agg(F.sqrt(F.sum(F.col("error") * F.col("error")) / (2 * F.count("*"))).alias("rms"))


@query(f"SELECT point_id, error FROM ({_ERR}) WHERE error <= 0.025", ints="point_id", reals="error")
def flt_reproj(spark, sf):
    return _errors(spark, sf).where("error <= 0.025")


@query(f"SELECT pose, count(*) FILTER (WHERE (error + pose * 0.01) ** 2 < 0.005) AS inliers FROM ({_ERR}) JOIN range(8) h(pose) ON true GROUP BY pose", ints="pose inliers")
def agg_p_inl(spark, sf):
    e = _errors(spark, sf).select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pose"), "error")
    return e.groupBy("pose").agg(F.count_if(F.pow(F.col("error") + F.col("pose") * 0.01, 2) < 0.005).alias("inliers"))


@query("SELECT cand, count(*) FILTER (WHERE z * s > 0 AND (z - 3.82) * t > 0) AS front FROM (SELECT * FROM ppts ORDER BY point_id LIMIT 50) JOIN (VALUES (0, 1, 1), (1, 1, -1), (2, -1, 1), (3, -1, -1)) k(cand, s, t) ON true GROUP BY cand", ints="cand front")
def agg_front(spark, sf):
    c = F.array(*[F.struct(F.lit(i).alias("cand"), F.lit(s).alias("s"), F.lit(t).alias("t")) for i, (s, t) in enumerate(((1, 1), (1, -1), (-1, 1), (-1, -1)))])
    p = X.part_points(spark, sf).orderBy("point_id").limit(50).select("z", F.explode(c).alias("k")).select("z", "k.*")
    return p.groupBy("cand").agg(F.count_if((F.col("z") * F.col("s") > 0) & ((F.col("z") - 3.82) * F.col("t") > 0)).alias("front"))


_OBS = "SELECT point_id % 6 AS cam, point_id, z AS depth, 0.01 * (point_id % 5) AS ru, 0.02 * (point_id % 3) AS rv, x, y FROM ppts"


def _observed(spark, sf):
    i = F.col("point_id")
    return X.part_points(spark, sf).select((i % 6).alias("cam"), "point_id", F.col("z").alias("depth"), (0.01 * (i % 5)).alias("ru"), (0.02 * (i % 3)).alias("rv"), "x", "y")


def _jacobian():
    """Residual derivatives by camera translation: the last three of the six pose columns."""
    z = F.col("depth")
    return [1 / z, -F.col("x") / (z * z), -F.col("y") / (z * z)]


@query(f"SELECT point_id, ru, rv, 1 / depth AS j00, -x / (depth * depth) AS j02, -y / (depth * depth) AS j12 FROM ({_OBS})", ints="point_id", reals="ru rv j00 j02 j12")
def m_ba_j(spark, sf):
    a, b, c = _jacobian()
    return _observed(spark, sf).select("point_id", "ru", "rv", a.alias("j00"), b.alias("j02"), c.alias("j12"))


@query(f"SELECT cam, count(*) AS n, sum(1 / (depth * depth)) AS u00, sum(-x / depth ** 3) AS u02, sum((x * x + y * y) / depth ** 4) AS u22, sum(ru / depth) AS g0, sum(-(ru * x + rv * y) / (depth * depth)) AS g2 FROM ({_OBS}) GROUP BY cam", ints="cam n", reals="u00 u02 u22 g0 g2")
def agg_ba(spark, sf):
    a, b, c = _jacobian()
    return _observed(spark, sf).groupBy("cam").agg(F.count("*").alias("n"), F.sum(a * a).alias("u00"), F.sum(a * b).alias("u02"), F.sum(b * b + c * c).alias("u22"), F.sum(a * F.col("ru")).alias("g0"), F.sum(b * F.col("ru") + c * F.col("rv")).alias("g2"))


# Closed-form triangulation of the two views: rays (ua, va, 1) from 0 and (ub, vb, 1) from (1, 0, 0).
@query(f"SELECT point_id, ua / (ua - ub) AS x, (va + vb) / 2 / (ua - ub) AS y, 1 / (ua - ub) AS z FROM ({_TWO}) WHERE abs(ua - ub) > 1e-10", ints="point_id", reals="x y z")
def m_tri_gpu(spark, sf):
    from voxelloom.operators.sfm import triangulate_closed

    t = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    return triangulate_closed(_seen(spark, sf), (t, [0.0, 0.0, 0.0]), (t, [-1.0, 0.0, 0.0])).select("point_id", *XYZ)


@query("SELECT image_id, inliers, CASE WHEN inliers < 4 THEN 'few inliers' WHEN abs(det - 1) > 0.3 THEN 'not a rotation' WHEN dist > 20 * med THEN 'too far' WHEN err * 500 > 32 THEN 'reprojection' ELSE 'ok' END AS reason FROM (SELECT *, (SELECT list_sort(list(dist))[count(*) // 2 + 1] FROM g) AS med FROM g)".replace("FROM g", "FROM (SELECT label AS image_id, count(*) % 11 AS inliers, 1.0::DOUBLE + label / 20.0::DOUBLE AS det, CASE WHEN label = 4 THEN 100.0 ELSE 1.0 + label END::DOUBLE AS dist, label / 100.0::DOUBLE AS err FROM embeddings GROUP BY label)"), ints="image_id inliers", other="reason")
def gate_cam(spark, sf):
    from voxelloom.operators.sfm import camera_gate
    from voxelloom.session import table

    g = table(spark, sf, "embeddings").groupBy(F.col("label").alias("image_id")).agg((F.count("*") % 11).alias("inliers"))
    i = F.col("image_id")
    g = g.select("image_id", "inliers", (1.0 + i / 20.0).alias("det"), F.when(i == 4, 100.0).otherwise(1.0 + i).alias("distance"), (i / 100.0).alias("median_error"))
    return camera_gate(g, 500.0)


@query("SELECT point_id, k.pose AS image_id, CASE k.pose WHEN 0 THEN 0.8 * x - 0.6 * y ELSE x END AS cx FROM ppts JOIN (VALUES (0), (1)) k(pose) ON true", ints="point_id image_id", reals="cx")
def compose(spark, sf):
    from voxelloom.operators.sfm import compose_pose

    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    turn = [0.8, -0.6, 0.0, 0.6, 0.8, 0.0, 0.0, 0.0, 1.0]
    rel = spark.createDataFrame([(0, turn, [0.0, 0.0, 0.0]), (1, one, [0.0, 0.0, 0.0])], "image_id int, r array<double>, t array<double>")
    base = spark.createDataFrame([(one, [0.0, 0.0, 0.0])], "rk array<double>, tk array<double>")
    poses = compose_pose(rel.crossJoin(base))
    p = X.part_points(spark, sf).select("point_id", *XYZ).crossJoin(F.broadcast(poses))  # two poses
    r = [[F.col("r")[3 * i + j] for j in range(3)] for i in range(3)]
    return p.select("point_id", "image_id", S.transform_point(r, [F.col("t")[i] for i in range(3)], [F.col(a) for a in XYZ])[0].alias("cx"))


@query("SELECT point_id, x * 0.8 - y * 0.6 + 0.5 AS u, x * 0.6 + y * 0.8 - 1 AS v, z + 2 AS w FROM ppts", ints="point_id", reals="u v w")
def P_mtx(spark, sf):
    p = [[0.8, -0.6, 0.0, 0.5], [0.6, 0.8, 0.0, -1.0], [0.0, 0.0, 1.0, 2.0]]
    m = F.array(*[F.array(*[F.lit(v) for v in row]) for row in p])
    one = X.part_points(spark, sf).withColumn("m", m)
    return one.select("point_id", *[(m[i][0] * F.col("x") + m[i][1] * F.col("y") + m[i][2] * F.col("z") + m[i][3]).alias(k) for i, k in enumerate("uvw")])
