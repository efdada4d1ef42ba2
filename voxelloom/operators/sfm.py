"""Structure from motion: relations stay in Spark; only poses, one row per camera, come to the driver.

Matches are triangulated row by row with both poses beside them; relative poses and resections come from tables of
hypotheses (:mod:`.consensus`), so no pair and no camera is one group. Points, tracks and observations are written
tables between rounds. Every round adds all cameras that pass the gate at once, which parallelises what
a one-by-one loop does and may register more cameras per round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions import splat as S
from voxelloom.operators import cloud, consensus, match
from voxelloom.operators import geometry as G
from voxelloom.session import discard, written

POSE = "image_id int, r array<double>, t array<double>"
MIN_ANGLE = 3.0


def _m(name: str) -> list[list[Column]]:
    return [[F.col(name)[3 * i + j] for j in range(3)] for i in range(3)]


def _v(name: str) -> list[Column]:
    return [F.col(name)[i] for i in range(3)]


def compose_pose(rows: DataFrame, inverse: bool = False) -> DataFrame:
    """r, t of a relative pose put after a known one (rk, tk): R Rk, R tk + t; ``inverse`` turns the relative pose first."""
    r, t = _m("r"), _v("t")
    if inverse:
        r, t = [[r[j][i] for j in range(3)] for i in range(3)], S.camera_centre(r, t)
    rk, tk = _m("rk"), _v("tk")
    prod = F.array(*[r[i][0] * rk[0][j] + r[i][1] * rk[1][j] + r[i][2] * rk[2][j] for i in range(3) for j in range(3)])
    moved = F.array(*S.transform_point(r, t, tk))
    return rows.select("image_id", prod.alias("r"), moved.alias("t"))


def camera_gate(rows: DataFrame, fx: float, px: float = 32.0) -> DataFrame:
    """Adds a reason per candidate camera (inliers, det, distance, median_error): ``ok`` or why not."""
    med = cloud.upper_median(rows.select(F.lit(1).alias("g"), "distance"), ["g"], "distance").select("median")
    j = rows.crossJoin(F.broadcast(med))  # one row
    why = F.when(F.col("inliers") < 4, "few inliers").when(F.abs(F.col("det") - 1) > 0.3, "not a rotation").when(F.col("distance") > 20 * F.col("median"), "too far").when(F.col("median_error") * fx > px, "reprojection").otherwise("ok")
    return j.select(*rows.columns, why.alias("reason"))


def triangulate_closed(rows: DataFrame, a: tuple, b: tuple) -> DataFrame:
    """x, y, z from ua, va, ub, vb by the normal equations of the two rays, as column expressions."""
    eq = []
    for (r, t), u, v in ((a, "ua", "va"), (b, "ub", "vb")):
        for k, c in ((0, u), (1, v)):
            eq.append(([r[k][i] - F.col(c) * r[2][i] for i in range(3)], F.col(c) * t[2] - t[k]))
    h = {(i, j): sum(e[i] * e[j] for e, _ in eq) for i in range(3) for j in range(i, 3)}
    g = [sum(e[i] * rhs for e, rhs in eq) for i in range(3)]
    named = rows.withColumns({f"_h{i}{j}": c for (i, j), c in h.items()} | {f"_g{i}": c for i, c in enumerate(g)})
    n = S.symmetric_inverse3(*[F.col(f"_h{k}") for k in ("00", "01", "02", "11", "12", "22")])
    inv = [[n[0], n[1], n[2]], [n[1], n[3], n[4]], [n[2], n[4], n[5]]]
    xyz = {k: inv[i][0] * F.col("_g0") + inv[i][1] * F.col("_g1") + inv[i][2] * F.col("_g2") for i, k in enumerate("xyz")}
    out = named.withColumns(xyz)
    return out.drop(*[c for c in out.columns if c.startswith(("_h", "_g"))])


FOUND = "img_a int, img_b int, feat_a long, feat_b long, x double, y double, z double"


def _triangulated(batches):
    """Rows of matches with the pose of either camera: points in front of both and at an angle."""
    for rows in batches:
        if not len(rows):
            continue
        flat = lambda c, *shape: rows[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape)
        ra, rb, ta, tb = flat("r_a", 3, 3), flat("r_b", 3, 3), flat("t_a", 3), flat("t_b", 3)
        at = lambda *cs: np.stack([rows[c].to_numpy(zero_copy_only=False) for c in cs], 1)
        x = G.triangulate(at("xa", "ya"), at("xb", "yb"), np.concatenate([ra, ta[:, :, None]], 2), np.concatenate([rb, tb[:, :, None]], 2))
        da, db = x + np.einsum("nji,nj->ni", ra, ta), x + np.einsum("nji,nj->ni", rb, tb)  # from each centre, -R^T t
        cos = np.sum(da * db, 1) / np.maximum(np.linalg.norm(da, axis=1) * np.linalg.norm(db, axis=1), 1e-12)
        deep = lambda r, t: np.sum(x * r[:, 2], 1) + t[:, 2] > 0
        ok = np.isfinite(x).all(1) & deep(ra, ta) & deep(rb, tb) & (np.degrees(np.arccos(np.clip(cos, -1, 1))) >= MIN_ANGLE)
        keys = ["img_a", "img_b", "feat_a", "feat_b"]
        yield pa.RecordBatch.from_arrays([*[rows[c] for c in keys], *[pa.array(x[:, i]) for i in range(3)]], names=[*keys, *"xyz"]).filter(pa.array(ok))


def triangulate_pairs(coords: DataFrame, poses: DataFrame) -> DataFrame:
    """img_a, img_b, feat_a, feat_b, x, y, z for matches between posed images, in front of both and at an angle.

    No grouping: poses go to the matches, since a join by image would put all matches of one in one task.
    """
    pose = lambda s: F.broadcast(poses.select(F.col("image_id").alias(f"img_{s}"), F.col("r").alias(f"r_{s}"), F.col("t").alias(f"t_{s}")))  # noqa: E731  one row a camera
    j = coords.join(pose("a"), "img_a").join(pose("b"), "img_b")
    return j.mapInArrow(_triangulated, FOUND)


def tracks(tri: DataFrame) -> tuple[DataFrame, DataFrame]:
    """points (point_id, x, y, z) and observations (image_id, feat_id, point_id) of triangulated matches.

    Matches that share a feature are not merged; a feature keeps its first point.
    """
    t = tri.withColumn("point_id", F.xxhash64("img_a", "img_b", "feat_a", "feat_b"))
    obs = t.select(F.col("img_a").alias("image_id"), F.col("feat_a").alias("feat_id"), "point_id").unionByName(t.select(F.col("img_b").alias("image_id"), F.col("feat_b").alias("feat_id"), "point_id"))
    return t.select("point_id", "x", "y", "z"), obs.groupBy("image_id", "feat_id").agg(F.min("point_id").alias("point_id"))


def reconstruct_known(coords: DataFrame, poses: DataFrame) -> DataFrame:
    """Points of calibrated cameras: all pairs triangulated, outliers dropped where there are more than 20."""
    points, _ = tracks(written(triangulate_pairs(coords, poses), "tri"))
    return cloud.drop_outliers(points)


def _pairs_of(found: DataFrame) -> DataFrame:
    """img_a, img_b from the group's name."""
    ab = F.split("g", ":")
    return found.select(ab[0].cast("int").alias("img_a"), ab[1].cast("int").alias("img_b"), *[c for c in found.columns if c != "g"])


def _pose_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"r": F.slice("m", 1, 9), "t": F.slice("m", 10, 3)}).drop("m")


def start_pairs(coords: DataFrame, samples: int = 256) -> DataFrame:
    """img_a, img_b, r, t, inliers, score: relative pose and shape of the triangulated inliers of each candidate pair, all in parallel."""
    rows = consensus.numbered(coords, ["img_a", "img_b"], ["img_a", "img_b", "feat_a", "feat_b"], consensus.TWO)
    parts = consensus.blocks(rows, consensus.TWO)
    found = consensus.essentials(rows, parts, samples)
    poses = _pose_columns(_pairs_of(consensus.relative_poses(parts, found).drop("inliers")))
    e = _pairs_of(found.select("g", F.col("m").alias("e"), "inliers"))
    here = written(poses.join(e, ["img_a", "img_b"]), "starts")
    close = coords.join(F.broadcast(here), ["img_a", "img_b"]).where(S.sampson(_m("e"), *[F.col(c) for c in consensus.TWO]) < 0.01)  # one row a pair
    one = [F.array(*[F.lit(float(v)) for v in x]) for x in (np.eye(3).ravel(), np.zeros(3))]
    posed = close.select("img_a", "img_b", "feat_a", "feat_b", *consensus.TWO, one[0].alias("r_a"), one[1].alias("t_a"), F.col("r").alias("r_b"), F.col("t").alias("t_b"))
    points = written(posed.mapInArrow(_triangulated, FOUND), "start-points")
    by = ["img_a", "img_b"]
    q = cloud.ranked_values(points, by, "z", {"q1": F.floor(F.col("n") / 4), "q3": F.floor(3 * F.col("n") / 4)}).where("n >= 10")
    r = F.col("q3") - F.col("q1")
    inner = points.join(F.broadcast(q.select(*by, "q1", "q3")), by).where(F.col("z").between(F.greatest(F.col("q1") - 3 * r, F.lit(0.1)), F.col("q3") + 3 * r))
    shape = cloud.pca(inner, by).select(*by, F.when(F.col("n") >= 10, F.col("ratio")).otherwise(0.0).alias("score"))
    return here.join(shape, by).select(*by, "r", "t", "inliers", "score")


def seed_verdict(n: Column, inliers: Column, det: Column, least: int = 15, inside: int = 10, off: float = 0.1) -> Column:
    """Why a pair can not seed a camera, in the order of the steps, or ``ok``. ``inliers`` and ``det`` are null where there is no matrix or pose."""
    steps = [(n < least, "few matches"), (inliers.isNull(), "no matrix"), (inliers < inside, "few inliers"), (det.isNull(), "no pose"), (F.abs(det - 1) > off, "no rotation")]
    return F.coalesce(*[F.when(bad, why) for bad, why in steps], F.lit("ok"))


def seed_gate(coords: DataFrame, least: int = 15, inside: int = 10, samples: int = 256, limit: float = 0.01) -> DataFrame:
    """img_a, img_b, n, inliers, det, reason of each edge of the view graph, which may seed a camera where the reason is ``ok``.

    Pairs with enough matches get an essential matrix from samples; those with enough inliers a pose, from the inliers alone.
    """
    by, cols = ["img_a", "img_b"], consensus.TWO
    pairs = written(match.pair_graph(coords), "seed-pairs")
    many = coords.join(F.broadcast(pairs.where(F.col("n") >= least).select(*by)), by, "left_semi")  # one row a pair, as below
    rows = consensus.numbered(many, by, [*by, "feat_a", "feat_b"], cols)
    found = consensus.essentials(rows, consensus.blocks(rows, cols), samples, limit)
    good = found.where(F.col("inliers") >= inside).select("g", "m")
    close = rows.join(F.broadcast(good), "g").where(S.sampson(_m("m"), *[F.col(c) for c in cols]) < limit)
    posed = _pairs_of(consensus.relative_poses(consensus.blocks(close, cols), good).select("g", S.det3(_m("m")).alias("det")))
    out = pairs.join(F.broadcast(_pairs_of(found.select("g", "inliers"))), by, "left").join(F.broadcast(posed), by, "left")
    return out.select(*by, "n", "inliers", "det", seed_verdict(*[F.col(c) for c in ("n", "inliers", "det")], least, inside).alias("reason"))


def resect(found: DataFrame, samples: int = 1024) -> DataFrame:
    """Pose per image from 2D-3D correspondences (image_id, u, v, x, y, z), with the gate's measures."""
    rows = consensus.numbered(found, ["image_id"], ["image_id"], consensus.SIX)
    poses = consensus.resections(rows, consensus.blocks(rows, consensus.SIX), samples)
    both = _pose_columns(poses.join(consensus.errors(rows, poses), "g")).withColumn("image_id", F.col("g").cast("int"))
    r, t = _m("r"), _v("t")
    det = sum(r[0][i] * (r[1][(i + 1) % 3] * r[2][(i + 2) % 3] - r[1][(i + 2) % 3] * r[2][(i + 1) % 3]) for i in range(3))
    far = F.sqrt(sum(c * c for c in S.camera_centre(r, t)))
    return both.select("image_id", "r", "t", F.col("inliers").cast("int").alias("inliers"), det.alias("det"), far.alias("distance"), F.least("median", F.lit(1e6)).alias("median_error"))


#: Cameras up to which the reduced system is solved as one matrix (384 x 384); beyond, by conjugate gradients.
DENSE = 64
#: Numbers of a block: 6 x 6 of the pair; and of a camera's own: gradient, undamped 6 x 6, squared error.
_OWN = 79


def gradients_step(blocks: DataFrame, own: dict[int, np.ndarray], lam: float, held: int, tolerance: float = 1e-12) -> dict[int, np.ndarray]:
    """Each camera's step from the table of blocks, by conjugate gradients preconditioned with the cameras' own blocks.

    A product with the system is a pass over the blocks, which are only there for cameras that share points, and a sum of six numbers a
    camera. The driver holds vectors of that size, never the matrix. ``held``: the camera that stays.
    """
    ids = [c for c in sorted(own) if c != held]
    extra = {c: lam * np.diag(own[c][42:78].reshape(6, 6)) + 1e-12 for c in ids}
    inverse = {c: np.linalg.pinv(own[c][:36].reshape(6, 6) + np.diag(extra[c])) for c in ids}

    def times(x: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        def run(frames):
            for pdf in frames:
                pdf = pdf[pdf["a"].isin(x) & pdf["b"].isin(x)]
                if len(pdf):
                    m = np.stack(pdf["s"].to_numpy())[:, :36].reshape(-1, 6, 6)
                    y = np.einsum("nij,nj->ni", m, np.stack([x[b] for b in pdf["b"]]))
                    yield pd.DataFrame({"a": pdf["a"], **{f"y{i}": y[:, i] for i in range(6)}})

        rows = blocks.mapInPandas(run, "a int, " + ", ".join(f"y{i} double" for i in range(6))).groupBy("a").agg(*[F.sum(f"y{i}") for i in range(6)]).collect()
        found = {r[0]: np.array(r[1:]) for r in rows}
        return {c: found.get(c, np.zeros(6)) + extra[c] * x[c] for c in ids}

    dot = lambda u, v: sum(float(u[c] @ v[c]) for c in ids)
    x, r = {c: np.zeros(6) for c in ids}, {c: -own[c][36:42] for c in ids}
    z = {c: inverse[c] @ r[c] for c in ids}
    p, rz = z, dot(r, z)
    first = rz
    for _ in range(6 * len(ids)):
        if not rz > tolerance * tolerance * first:
            break
        q = times(p)
        a = rz / dot(p, q)
        x, r = {c: x[c] + a * p[c] for c in ids}, {c: r[c] - a * q[c] for c in ids}
        z = {c: inverse[c] @ r[c] for c in ids}
        rz, before = dot(r, z), rz
        p = {c: z[c] + rz / before * p[c] for c in ids}
    return x | {held: np.zeros(6)}


def bundle_adjust(poses: DataFrame, points: DataFrame, observations: DataFrame, rounds: int = 15, damping: float = 10.0, diagonal: bool = False, dense: int = DENSE) -> tuple[DataFrame, DataFrame, list[float]]:
    """Levenberg-Marquardt over poses, points and observations (image_id, point_id, u, v); the first pose is held.

    A point lies with its own observations in one row, and is eliminated there; batches of points add up their
    6 x 6 blocks per pair of cameras before Spark does. That table of blocks is solved at the driver for up to ``dense``
    cameras, by :func:`gradients_step` beyond. ``diagonal`` keeps blocks of single cameras alone. Rejected steps
    raise the damping and are tried again. ``POSE`` order: angle-axis, t.
    """
    return _adjust(poses, points, observations, rounds, damping, diagonal, dense)


def reduced_system(poses: DataFrame, points: DataFrame, observations: DataFrame, damping: float = 0.0) -> DataFrame:
    """a, b, s: the 6 x 6 blocks (and for a camera itself what stands after them) of the system of cameras that is left when points are eliminated."""
    return _adjust(poses, points, observations, -1, damping, False, 0)


def _adjust(poses: DataFrame, points: DataFrame, observations: DataFrame, rounds: int, damping: float, diagonal: bool, dense: int):
    cams = {r["image_id"]: np.r_[G.angle_axis(np.reshape(r["r"], (3, 3))), r["t"]] for r in poses.collect()}
    ids = sorted(cams)
    seen = observations.where(F.col("image_id").isin(ids)).groupBy("point_id").agg(*[F.collect_list(c).alias(c) for c in ("image_id", "u", "v")])
    base = written(seen.join(points, "point_id").select("point_id", "image_id", "u", "v", "x", "y", "z"), "ba")
    points = points.select("point_id", "x", "y", "z")

    def jacobians(rows: pa.RecordBatch, now: dict):
        """Of every observation in a batch: its point and camera, error (2), and derivatives by camera (2 x 6) and point (2 x 3)."""
        n = rows["image_id"].value_lengths().to_numpy()
        flat = lambda c: rows[c].flatten().to_numpy(zero_copy_only=False)
        pt, u, v = np.repeat(np.arange(len(n)), n), flat("u"), flat("v")
        c = np.searchsorted(ids, flat("image_id"))
        p = np.stack([now[k] for k in ids])
        r = np.stack([G.rotation(q[:3]) for q in p])
        dr = np.stack([[(G.rotation(q[:3] + h) - G.rotation(q[:3] - h)) / 2e-4 for h in 1e-4 * np.eye(3)] for q in p])
        x = np.stack([rows[k].to_numpy(zero_copy_only=False) for k in "xyz"], 1)[pt]
        y = (r[c] @ x[:, :, None])[:, :, 0] + p[c, 3:]
        z = np.maximum(y[:, 2], 1e-6)
        e = y[:, :2] / z[:, None] - np.stack([u, v], 1)
        d = np.zeros((len(c), 2, 3))
        d[:, 0, 0] = d[:, 1, 1] = 1 / z
        d[:, :, 2] = -y[:, :2] / z[:, None] ** 2
        turned = (dr.reshape(-1, 9, 3)[c] @ x[:, :, None])[:, :, 0].reshape(-1, 3, 3)  # by turn, then by axis
        jc = np.concatenate([d @ np.swapaxes(turned, 1, 2), d], axis=2)
        return n, pt, c, e, jc, d @ r[c]

    def per_point(values: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sums of each point's observations, which lie together; a point has one at least."""
        return np.add.reduceat(values, np.cumsum(n) - n)

    def summed(values: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys that occur, in order, and the sums of their values."""
        order = np.argsort(key, kind="stable")
        found, first = np.unique(key[order], return_index=True)
        return found, np.add.reduceat(values[order], first)

    def inverse(jp: np.ndarray, n: np.ndarray, lam: float) -> np.ndarray:
        """Of each point's damped 3 x 3: by cofactors, and as a pseudo-inverse where it is nearly singular."""
        v = per_point(np.swapaxes(jp, 1, 2) @ jp, n)
        v = v + lam * v * np.eye(3) + 1e-12 * np.eye(3)
        i, j, k = v[:, 0], v[:, 1], v[:, 2]
        adj = np.stack([np.cross(j, k), np.cross(k, i), np.cross(i, j)], 2)
        det = np.sum(i * adj[:, :, 0], 1)
        poor = ~(np.abs(det) > 1e-9 * np.abs(v).max((1, 2)) ** 3)
        out = adj / np.where(poor, 1, det)[:, None, None]
        if poor.any():
            out[poor] = np.linalg.pinv(v[poor])
        return out

    def eliminate(now: dict, lam: float):
        def run(batches):
            for rows in batches:
                if not len(rows):
                    continue
                n, pt, c, e, jc, jp = jacobians(rows, now)
                vi = inverse(jp, n, lam)
                gp = per_point((np.swapaxes(jp, 1, 2) @ e[:, :, None])[:, :, 0], n)
                w = np.swapaxes(jc, 1, 2) @ jp
                wv, k = w @ vi[pt], len(ids)
                full, g = (np.swapaxes(jc, 1, 2) @ jc).reshape(-1, 36), (np.swapaxes(jc, 1, 2) @ e[:, :, None] - wv @ gp[pt][:, :, None])[:, :, 0]
                of, own = summed(np.c_[full, g, full, (e * e).sum(1)], c)
                i = np.repeat(np.arange(len(c)), n[pt])  # every two observations of a point
                j = np.arange(len(i)) - np.repeat(np.cumsum(n[pt]) - n[pt], n[pt]) + (np.cumsum(n) - n)[pt][i]
                if diagonal:
                    i = j = np.arange(len(c))
                key = c[i] * k + c[j]
                order = np.argsort(key, kind="stable")
                pair, at = np.unique(key[order], return_inverse=True)
                through = np.zeros((len(pair), 36))
                for q in range(0, len(order), 2048):  # few enough products to stay in the cache
                    o, of_pair = order[q : q + 2048], at[q : q + 2048]
                    here, first = np.unique(of_pair, return_index=True)
                    through[here] += np.add.reduceat((wv[i[o]] @ np.swapaxes(w[j[o]], 1, 2)).reshape(-1, 36), first)
                out = np.zeros((len(pair), 79))
                out[:, :36] = -through
                a, b = pair // k, pair % k
                out[a == b] += own[np.searchsorted(of, a[a == b])]
                sums = pa.array(out.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[pa.array(np.asarray(ids)[q], pa.int32()) for q in (a, b)], sums], names=["a", "b", "s"])

        return run

    def move(now: dict, step: dict, lam: float):
        def run(batches):
            for rows in batches:
                if not len(rows):
                    continue
                n, _, c, e, jc, jp = jacobians(rows, now)
                e = e + (jc @ np.stack([step[k] for k in ids])[c][:, :, None])[:, :, 0]
                d = -(inverse(jp, n, lam) @ per_point((np.swapaxes(jp, 1, 2) @ e[:, :, None])[:, :, 0], n)[:, :, None])[:, :, 0]
                at = [pa.array(rows[k].to_numpy(zero_copy_only=False) + d[:, i]) for i, k in enumerate("xyz")]
                yield pa.RecordBatch.from_arrays([*[rows[k] for k in ("point_id", "image_id", "u", "v")], *at], names=rows.schema.names)

        return run

    schema, history = base.schema, []

    def system(df: DataFrame, now: dict, lam: float) -> tuple[DataFrame, dict[int, np.ndarray], float]:
        """The blocks, each camera's own one, and the squared error."""
        part = df.mapInArrow(eliminate(now, lam), "a int, b int, s array<double>")
        sums = part.groupBy("a", "b").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(_OWN)]).alias("s"))
        blocks = written(sums, "ba-blocks")
        own = {r["a"]: np.array(r["s"]) for r in blocks.where("a = b").collect()}  # one row a camera
        return blocks, own, sum(v[78] for v in own.values())

    def steps(blocks: DataFrame, own: dict[int, np.ndarray], lam: float) -> dict[int, np.ndarray]:
        zero = np.zeros(_OWN)
        if len(ids) > dense:
            return gradients_step(blocks, {c: own.get(c, zero) for c in ids}, lam, ids[0])
        m, g = np.zeros((6 * len(ids), 6 * len(ids))), np.concatenate([own.get(c, zero)[36:42] for c in ids])
        for r in blocks.collect():  # at most ``dense`` squared
            i, k = 6 * ids.index(r["a"]), 6 * ids.index(r["b"])
            m[i : i + 6, k : k + 6] += np.reshape(r["s"][:36], (6, 6))
        m += np.diag(np.concatenate([lam * np.diag(own.get(c, zero)[42:78].reshape(6, 6)) for c in ids])) + 1e-12 * np.eye(len(m))
        d = np.zeros(len(m))
        d[6:] = -np.linalg.lstsq(m[6:, 6:], g[6:], rcond=None)[0]
        return {c: d[6 * i : 6 * i + 6] for i, c in enumerate(ids)}

    lam, count = damping, base.agg(F.coalesce(F.sum(F.size("u")), F.lit(0))).first()[0]
    blocks, own, total = system(base, cams, lam)
    if rounds < 0:
        return blocks
    history.append(float(np.sqrt(total / max(2 * count, 1))))
    for _ in range(rounds):
        step = steps(blocks, own, lam)
        new = {c: cams[c] + step[c] for c in ids}
        moved = written(base.mapInArrow(move(cams, step, lam), schema), "ba")
        again = system(moved, new, max(lam / 3, 1e-6))
        discard(blocks)
        if np.isfinite(again[2]) and again[2] < total:
            done = abs(history[-1] - np.sqrt(again[2] / max(2 * count, 1))) < 1e-7
            base, cams, lam, (blocks, own, total) = moved, new, max(lam / 3, 1e-6), again
            history.append(float(np.sqrt(total / max(2 * count, 1))))
            if done:
                break
        else:
            discard(moved, again[0])
            lam *= 10
            if lam > 1e12:
                break
            blocks, own, total = system(base, cams, lam)
    spark = poses.sparkSession
    out = spark.createDataFrame([(c, G.rotation(p[:3]).ravel().tolist(), p[3:].tolist()) for c, p in sorted(cams.items())], POSE)
    fresh = base.select("point_id", *[F.col(a).alias(f"n_{a}") for a in "xyz"])
    pts = points.join(fresh, "point_id", "left").select("point_id", *[F.coalesce(f"n_{a}", a).alias(a) for a in "xyz"])
    return out, pts, history


def grow(coords: DataFrame, features: DataFrame, poses: DataFrame, rounds: int = 20, fx: float = 500.0, least: int = 6, adjust: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registers camera after camera from posed ones: poses, points, observations.

    ``features`` are normalised. Each round resects all images with enough correspondences, keeps those that
    pass the gate, and triangulates what became visible.
    """
    poses = written(poses, "poses")
    points, obs = (written(d, "grow") for d in tracks(triangulate_pairs(coords, poses)))
    for _ in range(rounds):
        found = match.correspondences(coords, obs, points, features).join(poses.select("image_id"), "image_id", "left_anti")
        enough = match.correspondence_counts(found).where(F.col("n") >= least).select("image_id")
        new = camera_gate(resect(found.join(enough, "image_id")), fx).where("reason = 'ok'").select("image_id", "r", "t")
        new = written(new, "poses-new")
        if new.isEmpty():
            break
        poses = written(poses.unionByName(new), "poses")
        more = triangulate_pairs(match.untriangulated(coords, obs), poses)
        p2, o2 = tracks(more)
        points, obs = written(points.unionByName(p2).dropDuplicates(["point_id"]), "points"), written(match.add_observations(obs, o2), "obs")
        if adjust:
            seen = obs.join(features.select("image_id", "feat_id", F.col("x").alias("u"), F.col("y").alias("v")), ["image_id", "feat_id"]).join(poses.select("image_id"), "image_id")
            poses, points, _ = bundle_adjust(poses, points, seen.select("image_id", "point_id", "u", "v"), adjust)
            points = written(points, "points")
    return poses, points, obs


def reconstruct_hybrid(coords: DataFrame, features: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two or more known poses, the rest by resection, without adjustment."""
    return grow(coords, features, known, adjust=0)


def reconstruct(coords: DataFrame, features: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From matches alone: the best-shaped starting pair fixes the frame, then growth and outlier removal."""
    pairs = coords.groupBy("img_a", "img_b").agg(F.count("*").alias("n"))
    starts = start_pairs(coords.join(match.start_candidates(pairs).select("img_a", "img_b"), ["img_a", "img_b"]))
    best = starts.orderBy(F.desc(F.round("score", 9)), "img_a", "img_b").first()  # scores of one shape differ by rounding alone
    if best is None:
        raise ValueError("no pair of images can start the reconstruction")
    one = np.eye(3).ravel().tolist()
    poses = coords.sparkSession.createDataFrame([(best["img_a"], one, [0.0] * 3), (best["img_b"], list(best["r"]), list(best["t"]))], POSE)
    poses, points, obs = grow(coords, features, poses, **options)
    return poses, cloud.drop_outliers(points), obs


