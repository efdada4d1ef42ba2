"""Queries of the small dense solvers: one matrix per point of ``part``, in batches inside tasks; SQL has closed forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxelloom.functions import splat as S
from voxelloom.operators import consensus as C
from voxelloom.operators import geometry as G
from voxelloom.operators import linalg as A
from voxelloom.plans import fixtures as X
from voxelloom.plans.cloud_plans import eigen_sql
from voxelloom.plans.registry import query
from voxelloom.plans.sfm_plans import CAMERAS, _flat, _poses_sql, _seen_points, _values, scene, true_pose


def _each(spark, sf, f, out: str):
    """point_id and what ``f`` gives for the points (n x 3) of a batch: an array of n rows."""

    def run(frames):
        for pdf in frames:
            found = np.asarray(f(pdf[["x", "y", "z"]].to_numpy()), float).reshape(len(pdf), -1)
            yield pd.DataFrame({"point_id": pdf["point_id"], **{c: found[:, i] for i, c in enumerate(out.split())}})

    return X.part_points(spark, sf).select("point_id", "x", "y", "z").mapInPandas(run, "point_id long, " + ", ".join(f"{c} double" for c in out.split()))


def _matrices(p: np.ndarray) -> np.ndarray:
    """Symmetric 3 x 3 matrices of points."""
    x, y, z = p.T
    one = np.ones(len(p))
    return np.stack([np.stack(r, 1) for r in ((4 + x, y, one), (y, 5 + z, x), (one, x, 6 * one))], 1)


def _symmetric() -> list:
    x, y, z = (F.col(a) for a in "xyz")
    one = F.lit(1.0)
    return [[4 + x, y, one], [y, 5 + z, x], [one, x, 6 * one]]


def _square() -> list:
    x, y, z = (F.col(a) for a in "xyz")
    return [[1 + x, y, z], [-y, F.lit(3.0), x], [F.lit(0.5), -z, 2 - y]]


def _solution(df, at, names):
    return df.select("point_id", *[F.get("s", F.lit(i)).alias(c) for i, c in zip(at, names.split())])


_M = "SELECT point_id, x, y, z, 4 + x AS c_xx, y AS c_xy, 1::DOUBLE AS c_xz, 5 + z AS c_yy, x AS c_yz, 6::DOUBLE AS c_zz FROM ppts"
_DET = "(c_xx * (c_yy * c_zz - c_yz * c_yz) - c_xy * (c_xy * c_zz - c_yz * c_xz) + c_xz * (c_xy * c_yz - c_yy * c_xz))"


def _cramer(p, q, r):
    return (
        f"({p} * (c_yy * c_zz - c_yz * c_yz) - c_xy * ({q} * c_zz - c_yz * {r}) + c_xz * ({q} * c_yz - c_yy * {r})) / {_DET} AS s0, "
        f"(c_xx * ({q} * c_zz - c_yz * {r}) - {p} * (c_xy * c_zz - c_yz * c_xz) + c_xz * (c_xy * {r} - {q} * c_xz)) / {_DET} AS s1, "
        f"(c_xx * (c_yy * {r} - {q} * c_yz) - c_xy * (c_xy * {r} - {q} * c_xz) + {p} * (c_xy * c_yz - c_yy * c_xz)) / {_DET} AS s2"
    )


SOLVED = {"ints": "point_id", "reals": "s0 s1 s2"}


@query(f"SELECT point_id, {_cramer('x / 3', 'y / 3', 'z / 3')} FROM ({_M})", **SOLVED)
def m_gauss(spark, sf):
    b = [F.col(a) / 3 for a in "xyz"]
    return _solution(A.solved(X.part_points(spark, sf), A.augmented(_symmetric(), b), 3, "s"), range(3), "s0 s1 s2")


def _six(p: np.ndarray) -> np.ndarray:
    """The matrix twice, the second time for twice the point."""
    a = np.zeros((len(p), 6, 6))
    a[:, :3, :3] = a[:, 3:, 3:] = _matrices(p)
    return a


@query(f"SELECT point_id, s0, s1, s2, 2 * s0 AS s3, 2 * s2 AS s5 FROM (SELECT point_id, {_cramer('x / 3', 'y / 3', 'z / 3')} FROM ({_M}))", ints="point_id", reals="s0 s1 s2 s3 s5")
def m_gauss6(spark, sf):
    m, zero = _symmetric(), [F.lit(0.0)] * 3
    six = [[*r, *zero] for r in m] + [[*zero, *r] for r in m]
    b = [F.col(a) * k / 3 for k in (1, 2) for a in "xyz"]
    return _solution(A.solved(X.part_points(spark, sf), A.augmented(six, b), 6, "s"), (0, 1, 2, 3, 5), "s0 s1 s2 s3 s5")


@query(f"SELECT point_id, {_cramer('1::DOUBLE / 3', 'y / 3', '2::DOUBLE / 3')} FROM ({_M})", **SOLVED)
def m_dense(spark, sf):
    b = [F.lit(1 / 3), F.col("y") / 3, F.lit(2 / 3)]
    return _solution(A.solved(X.part_points(spark, sf), A.augmented(_symmetric(), b), 3, "s", 1e-15), range(3), "s0 s1 s2")


EIGEN = {"ints": "point_id", "reals": "e1 e2 e3"}


@query(f"SELECT point_id, e1, e2, e3 FROM ({eigen_sql(_M)})", **EIGEN)
def m_eig3(spark, sf):
    return A.eigenvalues3(X.part_points(spark, sf), _symmetric()).select("point_id", "e1", "e2", "e3")


@query(f"SELECT point_id, e1 + e2 + e3 AS total, e1 AS most, e3 AS least FROM ({eigen_sql(_M)})", ints="point_id", reals="total most least")
def m_eigN(spark, sf):
    """Eigenvalues of the 6 x 6 matrix, of which each comes twice."""
    six = lambda p: np.linalg.eigh(_six(p))[0]
    return _each(spark, sf, lambda p: np.stack([six(p).sum(1) / 2, six(p)[:, -1], six(p)[:, 0]], 1), "total most least")


_GRAM = "SELECT point_id, " + ", ".join(f"{'(' + ' + '.join(f'm{k}{i} * m{k}{j}' for k in range(3)) + ')'} AS c_{a}{b}" for i, a in enumerate("xyz") for j, b in list(enumerate("xyz"))[i:]) + f", {'m00 * (m11 * m22 - m12 * m21) - m01 * (m10 * m22 - m12 * m20) + m02 * (m10 * m21 - m11 * m20)'} AS det FROM (SELECT point_id, 1 + x AS m00, y AS m01, z AS m02, -y AS m10, 3::DOUBLE AS m11, x AS m12, 0.5::DOUBLE AS m20, -z AS m21, 2 - y AS m22 FROM ppts)"


def _general(p: np.ndarray) -> np.ndarray:
    x, y, z = p.T
    one = np.ones(len(p))
    return np.stack([np.stack(r, 1) for r in ((1 + x, y, z), (-y, 3 * one, x), (0.5 * one, -z, 2 - y))], 1)


@query(f"SELECT point_id, sqrt(e1) AS s0, sqrt(e2) AS s1, det / (sqrt(e1) * sqrt(e2)) AS s2 FROM ({eigen_sql(_GRAM)})", **SOLVED)
def m_svd3(spark, sf):
    """Singular values of proper rotations: the last one has the sign of the determinant."""
    m = _square()
    e = A.eigenvalues3(X.part_points(spark, sf), A.product(A.transposed(m), m))
    s0, s1 = F.sqrt("e1"), F.sqrt("e2")
    return e.select("point_id", s0.alias("s0"), s1.alias("s1"), (A.determinant3(m) / (s0 * s1)).alias("s2"))


_CROSS = "SELECT point_id, abs(n0) / l AS v0, abs(n1) / l AS v1, abs(n2) / l AS v2 FROM (SELECT *, sqrt(n0 * n0 + n1 * n1 + n2 * n2) AS l FROM (SELECT point_id, y * 1 - z * 2 AS n0, z * 1 - x * 1 AS n1, x * 2 - y * 1 AS n2 FROM ppts))"
NULL = {"ints": "point_id", "reals": "v0 v1 v2"}


@query(_CROSS, **NULL)
def m_null(spark, sf):
    """The direction (without its sign) at right angles to the point and to (1, 2, 1)."""
    n = A.cross([F.col(a) for a in "xyz"], [F.lit(v) for v in (1.0, 2.0, 1.0)])
    return X.part_points(spark, sf).select("point_id", *[(F.abs(v) / F.sqrt(A.dot(n, n))).alias(f"v{i}") for i, v in enumerate(n)])


@query(_CROSS, **NULL)
def m_jac1(spark, sf):
    """The eigenvector of the smallest eigenvalue of a symmetric matrix of rank two."""
    p, q = [F.col(a) for a in "xyz"], (1.0, 2.0, 1.0)
    m = [[p[i] * p[j] + q[i] * q[j] for j in range(3)] for i in range(3)]
    e = A.eigenvector3(A.eigenvalues3(X.part_points(spark, sf), m), m, "e3", "v")
    return e.select("point_id", *[F.abs(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(3)])


@query("SELECT CAST(x * 10 AS BIGINT) % 7 AS g, regr_slope(z, y) AS slope, regr_intercept(z, y) AS base FROM ppts GROUP BY 1", ints="g", reals="slope base")
def m_lsq(spark, sf):
    """A line per group from its summed normal equations."""
    p = X.part_points(spark, sf).withColumn("g", F.round(F.col("x") * 10).cast("long") % 7)
    s = p.groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum("z").alias("sz"), F.sum(F.col("y") * F.col("z")).alias("syz"))

    def run(frames):
        for pdf in frames:
            a = np.stack([pdf[["n", "sy"]].to_numpy(float), pdf[["sy", "syy"]].to_numpy(float)], 1)
            found = np.array([np.linalg.lstsq(m, b, rcond=None)[0] for m, b in zip(a, pdf[["sz", "syz"]].to_numpy(float))]).reshape(-1, 2)
            yield pd.DataFrame({"g": pdf["g"], "slope": found[:, 1], "base": found[:, 0]})

    return s.mapInPandas(run, "g long, slope double, base double")


AXIS = {"ints": "point_id", "reals": "a0 a1 a2"}


@query("SELECT point_id, x / 3 AS a0, y / 3 AS a1, z / 10 AS a2 FROM ppts", **AXIS)
def m_aa(spark, sf):
    """Angle-axis vectors to rotations and back."""
    return _each(spark, sf, lambda p: [G.angle_axis(G.rotation(v / (3, 3, 10))) for v in p], "a0 a1 a2")


_ROD = "SELECT point_id, cos(t) + kx * kx * (1 - cos(t)) AS r00, kx * ky * (1 - cos(t)) - kz * sin(t) AS r01, kz * ky * (1 - cos(t)) + kx * sin(t) AS r21 FROM (SELECT point_id, x / t AS kx, y / t AS ky, z / t AS kz, t FROM (SELECT *, sqrt(x * x + y * y + z * z) AS t FROM ppts))"


@query(_ROD, ints="point_id", reals="r00 r01 r21")
def m_aainv(spark, sf):
    return _each(spark, sf, lambda p: [G.rotation(v).ravel()[[0, 1, 7]] for v in p], "r00 r01 r21")


_GS = "SELECT point_id, a0, a1, a2, b0 / bl AS b0, (a1 * b2 - a2 * b1) / bl AS n0 FROM (SELECT *, sqrt(b0 * b0 + b1 * b1 + b2 * b2) AS bl FROM (SELECT point_id, a0, a1, a2, m0 - d * a0 AS b0, m1 - d * a1 AS b1, m2 - d * a2 AS b2 FROM (SELECT *, m0 * a0 + m1 * a1 + m2 * a2 AS d FROM (SELECT point_id, -y AS m0, 3 AS m1, x AS m2, (1 + x) / l AS a0, y / l AS a1, z / l AS a2 FROM (SELECT *, sqrt((1 + x) ** 2 + y * y + z * z) AS l FROM ppts)))))"


@query(_GS, ints="point_id", reals="a0 a1 a2 b0 n0")
def m_gs(spark, sf):
    return _each(spark, sf, lambda p: [G.orthonormal(a).ravel()[[0, 1, 2, 3, 6]] for a in _general(p)], "a0 a1 a2 b0 n0")


@query("SELECT point_id, (1 + x) * (4 + x) + y * y + z AS m00, (1 + x) * y + y * (5 + z) + z * x AS m01, 0.5 - z * x + (2 - y) * 6 AS m22, 0.5::DOUBLE AS t02 FROM ppts", ints="point_id", reals="m00 m01 m22 t02")
def mat_mul(spark, sf):
    """Products of two matrices, and an entry of the first one turned."""
    m, t = A.product(_square(), _symmetric()), A.transposed(_square())
    return X.part_points(spark, sf).select("point_id", m[0][0].alias("m00"), m[0][1].alias("m01"), m[2][2].alias("m22"), t[0][2].alias("t02"))


@query("SELECT point_id, 1 + x AS t00, -y AS t01, 0.5 AS t02, y AS t10, z AS t20 FROM ppts", ints="point_id", reals="t00 t01 t02 t10 t20")
def mat_t(spark, sf):
    t = A.transposed(_square())
    return X.part_points(spark, sf).select("point_id", *[t[i][j].alias(f"t{i}{j}") for i, j in ((0, 0), (0, 1), (0, 2), (1, 0), (2, 0))])


@query("SELECT cx, cy, sqrt(2) / avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS scale FROM ppts, (SELECT avg(x) AS cx, avg(y) AS cy FROM ppts) GROUP BY cx, cy", reals="cx cy scale")
def agg_hartley(spark, sf):
    """Centroid, and the scale to a mean distance of the square root of two."""
    p = X.part_points(spark, sf)
    c = p.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    return p.crossJoin(F.broadcast(c)).groupBy("cx", "cy").agg((F.lit(2.0**0.5) / F.avg(d)).alias("scale"))  # one row


@query("SELECT feat_id, i, ((CASE WHEN i < 2 THEN d0 ELSE d1 END) >> (32 * (i % 2))) & 4294967295 AS word FROM feat JOIN range(4) g(i) ON true", ints="feat_id i word")
def f_pack(spark, sf):
    """Descriptors as little-endian words of 32 bits."""

    def run(frames):
        for pdf in frames:
            words = np.ascontiguousarray(pdf[["d0", "d1"]].to_numpy(np.int64)).astype("<i8").view("<u4").reshape(-1, 4)
            yield pd.DataFrame({"feat_id": np.repeat(pdf["feat_id"].to_numpy(), 4), "i": np.tile(np.arange(4), len(pdf)), "word": words.ravel().astype(np.int64)})

    return X.features(spark, sf).select("feat_id", "d0", "d1").mapInPandas(run, "feat_id long, i int, word long")


@query(_poses_sql(1.0), ints="image_id k", reals="v")
def m_procr(spark, sf):
    """Rigid fit of each camera's points to where it sees them, from sums alone."""
    pts, poses, _, _ = scene(spark, sf)
    r = [[F.col("r")[3 * i + j] for j in range(3)] for i in range(3)]
    c = S.transform_point(r, [F.col("t")[i] for i in range(3)], [F.col(a) for a in "xyz"])
    pairs = pts.crossJoin(F.broadcast(poses)).select("image_id", "x", "y", "z", *[v.alias(k) for v, k in zip(c, "uvw")])  # five poses
    return _values(_flat(C.rigid_fits(pairs, ["image_id"])), "image_id", F.col("image_id").cast("string"))


@query(_poses_sql(1.0), ints="image_id k", reals="v")
def m_gn(spark, sf):
    """Refinement of poses that are a little off, one system per camera and round."""
    turn, shift = G.rotation(np.array([0.02, -0.01, 0.03])), np.array([0.05, -0.04, 0.03])
    off = [(str(i), 0, [*(turn @ r).ravel().tolist(), *(t + shift).tolist()]) for i in range(CAMERAS) for r, t in [true_pose(i)]]
    return _values(C.refine(_seen_points(spark, sf)[2], spark.createDataFrame(off, C.POSES), rounds=30), "image_id")
