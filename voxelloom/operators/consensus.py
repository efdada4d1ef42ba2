"""Two-view and resection solvers as tables: hypotheses are rows, inliers are counted over blocks of matches, refits are sums of moments.

No pair of images and no camera is one group. Matches are numbered in an order of hashes, packed into blocks of ``BLOCK`` rows, and dealt out
as such; samples are rows of (group, sample, place) that fetch their matches by number. Models of a group, one row, meet its blocks. What
comes to the driver is one row per pair or camera.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators import cloud
from voxelloom.operators import geometry as G
from voxelloom.session import written
from voxelloom.streaming.running import ranged, running

BLOCK = 4096
#: Blocks of a group that its models are sent to together.
SLICE = 16
#: Models that are held against a block at a time.
MODELS = 32
TWO, SIX = ("xa", "ya", "xb", "yb"), ("u", "v", "x", "y", "z")
POSES = "g string, s int, m array<double>"


def numbered(rows: DataFrame, by: list[str], key: list[str], cols: tuple[str, ...], seed: int = 42) -> DataFrame:
    """g (the group's name), at (0, 1, ... in an order of hashes) and ``cols``; written."""
    g = F.concat_ws(":", *[F.col(c).cast("string") for c in by])
    named = rows.select(g.alias("g"), F.xxhash64(*key, *cols, F.lit(seed)).alias("h"), *cols)
    order = ["h", *cols]
    return written(running(ranged(named, "g", order), "g", order, sums={"n": F.lit(1.0)}).select("g", (F.col("n") - 1).cast("long").alias("at"), *cols), "numbered")


def blocks(rows: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """g, block and an array of at most ``BLOCK`` values per column; written."""
    packed = rows.groupBy("g", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.collect_list(F.struct(*cols)).alias("rows"))
    return written(packed.select("g", "block", *[F.col(f"rows.{c}").alias(c) for c in cols]), "blocks")


def samples(rows: DataFrame, cols: tuple[str, ...], count: int, size: int, seed: int = 42) -> DataFrame:
    """g, s, and per column an array of ``size`` values: ``count`` samples of distinct rows of each group that has enough.

    Rows lie in an order of hashes, so rows at even distances are as good as drawn ones, and are distinct.
    """
    n = rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= size)
    hyp = n.select("g", "n", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("s"))
    draw = lambda k, m: F.pmod(F.xxhash64("g", "s", F.lit(seed), F.lit(k)), m)
    step = 1 + draw(1, F.greatest(F.lit(1).cast("long"), F.floor((F.col("n") - 1) / (size - 1))))
    hyp = hyp.select("g", "n", "s", draw(0, F.col("n")).alias("a"), step.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k"))
    hyp = hyp.select("g", "s", "k", ((F.col("a") + F.col("k") * F.col("b")) % F.col("n")).alias("at"))
    found = hyp.join(rows, ["g", "at"]).groupBy("g", "s").agg(F.array_sort(F.collect_list(F.struct("k", *cols))).alias("x"))
    # Samples are few bytes and much work, so tasks are dealt by number, not by size.
    return found.select("g", "s", *[F.col(f"x.{c}").alias(c) for c in cols]).repartition(rows.sparkSession.sparkContext.defaultParallelism, "g", "s")


def _of(pdf: pd.DataFrame, cols) -> list[np.ndarray]:
    return [np.stack(pdf[c].to_numpy()) for c in cols]


def over_blocks(parts: DataFrame, models: DataFrame, f: Callable, width: int, cols: tuple[str, ...]) -> DataFrame:
    """g, i, v: sums over a group's blocks of ``f(columns, models)``, an array of ``width`` values. ``models``: g, s, m.

    Models go out to every ``SLICE`` blocks of their group, so that a group, of which there may be few, is not the share of one task.
    """
    every = models.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("s", "m"))).alias("models")).select("g", F.col("models.m").alias("models"))
    sliced = parts.withColumn("slice", F.expr(f"block div {SLICE}"))
    every = sliced.select("g", "slice").distinct().join(every, "g")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in frames:
            for r in pdf.to_dict("records"):
                v = np.asarray(f(*[np.asarray(r[c]) for c in cols], np.stack(r["models"])), float).ravel()
                sums[r["g"]] = sums[r["g"]] + v if r["g"] in sums else v
            if len(sums) > 256:
                yield pd.DataFrame({"g": list(sums), "v": [v.tolist() for v in sums.values()]})
                sums = {}
        yield pd.DataFrame({"g": list(sums), "v": [v.tolist() for v in sums.values()]})

    sums = sliced.join(every, ["g", "slice"]).select("g", *cols, "models").mapInPandas(run, "g string, v array<double>").select("g", F.posexplode("v").alias("i", "v"))
    return sums.where(F.col("i") < width).groupBy("g", "i").agg(F.sum("v").alias("v"))


def best(parts: DataFrame, models: DataFrame, inside: Callable, count: int, cols: tuple[str, ...]) -> DataFrame:
    """g, s, m, inliers: the model of each group that most rows are inside of, the first of equal ones."""
    order = models.withColumn("i", F.expr("row_number() OVER (PARTITION BY g ORDER BY s) - 1"))  # at most ``count`` rows a group
    found = over_blocks(parts, models, lambda *a: inside(*a).sum(1), count, cols)
    top = found.groupBy("g").agg(F.max_by("i", F.struct("v", -F.col("i"))).alias("i"), F.max("v").cast("long").alias("inliers"))
    return order.join(top, ["g", "i"]).select("g", "s", "m", "inliers")


def _sampson_inside(limit: float) -> Callable:
    def some(a, b, both, models):
        m = models.reshape(-1, 3, 3)
        n = models @ both
        ea, eb = (np.tensordot(m[:, :2], a, (2, 0)), np.tensordot(m[:, :, :2], b, (1, 0)))
        return n * n / (ea[:, 0] ** 2 + ea[:, 1] ** 2 + eb[:, 0] ** 2 + eb[:, 1] ** 2 + 1e-10) < limit

    def inside(xa, ya, xb, yb, models):
        a, b = np.stack([xa, ya, np.ones(len(xa))]), np.stack([xb, yb, np.ones(len(xb))])
        both = (b[:, None] * a[None]).reshape(9, -1)
        return np.concatenate([some(a, b, both, models[i : i + MODELS]) for i in range(0, len(models), MODELS)])

    return inside


def _moments(xa, ya, xb, yb, ok) -> np.ndarray:
    """Sum of the outer products of the eight-point rows: all that the solver needs, normalisation included."""
    one = np.ones(int(ok.sum()))
    a, b = np.stack([xa[ok], ya[ok], one], 1), np.stack([xb[ok], yb[ok], one], 1)
    m = (b[:, :, None] * a[:, None, :]).reshape(-1, 9)
    return m.T @ m


def eight_point_of_moments(m: np.ndarray) -> np.ndarray | None:
    """Essential-like matrix of unit norm and rank two from the 9 x 9 moments of eight matches or more."""
    n = m[8, 8]
    if n < 8:
        return None

    def scaling(mean: np.ndarray, square: float) -> np.ndarray:
        s = np.sqrt(2 / max(square - mean @ mean, 1e-24))
        return np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1]])

    ta = scaling(m[8, 6:8] / n, (m[6, 6] + m[7, 7]) / n)
    tb = scaling(m[8, [2, 5]] / n, (m[2, 2] + m[5, 5]) / n)
    k = np.kron(tb, ta)
    e = tb.T @ np.linalg.eigh(k @ m @ k.T)[1][:, 0].reshape(3, 3) @ ta
    u, s, vt = np.linalg.svd(e)
    e = u @ np.diag([s[0], s[1], 0]) @ vt
    size = np.linalg.norm(e)
    return e / size if size > 1e-12 else None


def _solved(sums: DataFrame, width: int, f: Callable) -> DataFrame:
    """g, s (1), m from summed moments, one row a group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [(g, f(np.asarray(v))) for g, v in zip(pdf["g"], pdf["v"])]
            yield pd.DataFrame([(g, 1, m.ravel().tolist()) for g, m in found if m is not None], columns=["g", "s", "m"])

    rows = sums.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x")).select("g", F.col("x.v").alias("v"))
    return rows.mapInPandas(run, POSES)


def eight_points(parts: DataFrame, models: DataFrame | None = None, limit: float = 0.01) -> DataFrame:
    """g, s, m: eight-point solution of all matches of each group, or of those inside its model."""
    if models is None:
        none = parts.select("g").distinct().select("g", F.lit(0).alias("s"), F.array(F.lit(0.0)).alias("m"))
        sums = over_blocks(parts, none, lambda xa, ya, xb, yb, m: _moments(xa, ya, xb, yb, np.ones(len(xa), bool)), 81, TWO)
    else:
        inside = _sampson_inside(limit)
        sums = over_blocks(parts, models, lambda xa, ya, xb, yb, m: _moments(xa, ya, xb, yb, inside(xa, ya, xb, yb, m)[0]), 81, TWO)
    return _solved(sums, 81, lambda v: eight_point_of_moments(v.reshape(9, 9)))


def essentials(rows: DataFrame, parts: DataFrame, count: int = 256, limit: float = 0.01) -> DataFrame:
    """g, m, inliers: the sampled model with most matches under ``limit``, or its refit on them where that has no fewer; written."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [G.eight_point(np.c_[xa, ya], np.c_[xb, yb]) for xa, ya, xb, yb in zip(*_of(pdf, TWO))]
            yield pd.DataFrame([(g, s, e.ravel().tolist()) for g, s, e in zip(pdf["g"], pdf["s"], found) if e is not None], columns=["g", "s", "m"])

    models = written(samples(rows, TWO, count, 8).mapInPandas(solve, POSES), "models")
    first = written(best(parts, models, _sampson_inside(limit), count, TWO), "best")
    again = eight_points(parts, first, limit)
    both = written(first.select("g", F.lit(1).alias("s"), "m").unionByName(again.select("g", F.lit(0).alias("s"), "m")), "models")  # the refit first
    found = best(parts, both, _sampson_inside(limit), 2, TWO).where("inliers >= 8")
    return written(found.select("g", "m", "inliers"), "essential")


def relative_poses(parts: DataFrame, models: DataFrame) -> DataFrame:
    """g, m (r, then t), inliers (matches in front of both cameras): of each matrix's four poses the one with most; written."""

    def four(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(g, s, [*r.ravel().tolist(), *t.tolist()]) for g, m in zip(pdf["g"], pdf["m"]) for s, (r, t) in enumerate(G.pose_candidates(np.reshape(m, (3, 3))))]
            yield pd.DataFrame(out, columns=["g", "s", "m"])

    def inside(xa, ya, xb, yb, poses):
        out = []
        for p in poses:
            r, t = p[:9].reshape(3, 3), p[9:]
            x = G.triangulate(np.c_[xa, ya], np.c_[xb, yb], np.eye(3, 4), np.c_[r, t])
            out.append((x[:, 2] > 0) & (x @ r[2] + t[2] > 0))
        return np.stack(out)

    models = written(models.select("g", "m").mapInPandas(four, POSES), "poses-four")
    return written(best(parts, models, inside, 4, TWO).where("inliers >= 5").select("g", "m", "inliers"), "poses-relative")


def _pose_inside(limit: float) -> Callable:
    def some(u, v, w, poses):
        cx, cy, cz = (np.c_[poses[:, 3 * i : 3 * i + 3], poses[:, 9 + i]] @ w for i in range(3))
        z = np.where(cz > 1e-6, cz, np.nan)
        return np.nan_to_num((cx / z - u) ** 2 + (cy / z - v) ** 2, nan=np.inf) < limit

    def inside(u, v, x, y, z, poses):
        w = np.stack([x, y, z, np.ones(len(x))])
        return np.concatenate([some(u, v, w, poses[i : i + MODELS]) for i in range(0, len(poses), MODELS)])

    return inside


def refine(parts: DataFrame, poses: DataFrame, limit: float = np.inf, rounds: int = 10) -> DataFrame:
    """g, s, m: Gauss-Newton on the six parameters of each group's pose, over the rows that its first pose has under ``limit``; written.

    A round adds up one 6 x 6 system per group over its blocks. The poses, one row a group, are held by the driver.
    """
    start = {r["g"]: np.asarray(r["m"]) for r in poses.select("g", "m").collect()}
    now = {g: np.r_[G.angle_axis(m[:9].reshape(3, 3)), m[9:]] for g, m in start.items()}
    spark, inside, live = parts.sparkSession, _pose_inside(limit), set(now)

    def system(u, v, x, y, z, m):
        first, p = m[0][:12], m[0][12:]
        ok = inside(u, v, x, y, z, first[None])[0]
        x2, x3 = np.c_[u, v][ok], np.c_[x, y, z][ok]
        f = G._project_six(p, x3)
        j = np.stack([(G._project_six(p + 1e-6 * d, x3) - f) / 1e-6 for d in np.eye(6)], 1)
        return np.r_[(j.T @ j).ravel(), j.T @ (x2.ravel() - f)]

    for _ in range(rounds):
        if not live:
            break
        models = spark.createDataFrame([(g, 0, [*start[g].tolist(), *now[g].tolist()]) for g in sorted(live)], POSES)
        sums: dict[str, np.ndarray] = {}
        for g, i, v in over_blocks(parts, models, system, 42, SIX).collect():  # 42 numbers a group
            sums.setdefault(g, np.zeros(42))[i] = v
        for g in list(live):
            s = sums.get(g)
            h = None if s is None else s[:36].reshape(6, 6)
            step = None if h is None else G.solve(h + 0.001 * np.diag(np.diag(h)) + 1e-12 * np.eye(6), s[36:], 0.0)
            if step is None or step @ step < 1e-14:
                live.discard(g)
            else:
                now[g] = now[g] + step
    return spark.createDataFrame([(g, 1, [*G.rotation(p[:3]).ravel().tolist(), *p[3:].tolist()]) for g, p in sorted(now.items())], POSES)


def resections(rows: DataFrame, parts: DataFrame, count: int = 1024, limit: float = 0.005) -> DataFrame:
    """g, m, inliers: pose of each group's 2D-3D rows from samples of six (four or five where there are no more), refined on its inliers; written."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [G.epnp(np.c_[u, v], np.c_[x, y, z]) for u, v, x, y, z in zip(*[pdf[c] for c in SIX])]
            yield pd.DataFrame([(g, s, [*p[0].ravel().tolist(), *p[1].tolist()]) for g, s, p in zip(pdf["g"], pdf["s"], found) if p is not None], columns=["g", "s", "m"])

    some = rows.groupBy("g").agg(F.count("*").alias("n")).where("n between 4 and 5").select("g")
    few = parts.join(some, "g").select("g", F.lit(0).alias("s"), *SIX)
    models = written(samples(rows, SIX, count, 6).unionByName(few).mapInPandas(solve, POSES), "models")
    first = written(best(parts, models, _pose_inside(limit), count, SIX).where("inliers >= 4"), "best")
    both = written(first.select("g", F.lit(1).alias("s"), "m").unionByName(refine(parts, first, limit).select("g", F.lit(0).alias("s"), "m")), "models")
    return written(best(parts, both, _pose_inside(limit), 2, SIX).select("g", "m", "inliers"), "resected")


def errors(rows: DataFrame, poses: DataFrame) -> DataFrame:
    """g, median: reprojection error of each group's rows under its pose, in column expressions."""
    m = [F.col("m")[i] for i in range(12)]
    c = [m[3 * i] * F.col("x") + m[3 * i + 1] * F.col("y") + m[3 * i + 2] * F.col("z") + m[9 + i] for i in range(3)]
    e = F.when(c[2] > 1e-6, F.sqrt(F.pow(c[0] / c[2] - F.col("u"), 2) + F.pow(c[1] / c[2] - F.col("v"), 2))).otherwise(1e6)
    return cloud.upper_median(rows.join(poses, "g").select("g", e.alias("e")), ["g"], "e").select("g", "median")


def rigid_fits(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``by``, r, t with (u, v, w) = r (x, y, z) + t in the least-squares sense: fifteen sums a group, then a 3 x 3 solve."""
    w, c = ("x", "y", "z"), ("u", "v", "w")
    cross = [F.covar_pop(a, b).alias(f"{a}{b}") for a in c for b in w]
    s = pairs.groupBy(*by).agg(*[F.avg(k).alias(k) for k in (*w, *c)], *cross)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            k = pdf[[f"{a}{b}" for a in c for b in w]].to_numpy().reshape(-1, 3, 3)
            u, _, vt = np.linalg.svd(k)
            d = np.ones((len(k), 3))
            d[:, 2] = np.sign(np.linalg.det(u @ vt))
            r = (u * d[:, None, :]) @ vt
            t = pdf[list(c)].to_numpy() - np.einsum("nij,nj->ni", r, pdf[list(w)].to_numpy())
            yield pdf[by].assign(r=r.reshape(-1, 9).tolist(), t=t.tolist())

    kinds = dict(pairs.dtypes)
    return s.mapInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", r array<double>, t array<double>")


def _outer(u, v, x, y, z, models) -> np.ndarray:
    w = np.c_[x, y, z, np.ones(len(x))]
    return w.T @ w


def _control(m: np.ndarray) -> np.ndarray:
    """Control points (4 x 3) from moments: the centroid, and one along each principal axis."""
    c = m[:3, 3] / m[3, 3]
    ev, axes = np.linalg.eigh(m[:3, :3] / m[3, 3] - np.outer(c, c))
    return np.vstack([c, c + (axes * np.sqrt(np.maximum(ev, 1e-6))).T])


def _barycentric(control: np.ndarray, x3: np.ndarray) -> np.ndarray:
    return np.linalg.solve(np.vstack([control.T, np.ones(4)]), np.vstack([x3.T, np.ones(len(x3))])).T


def _system(u, v, x, y, z, models) -> np.ndarray:
    bary, m = _barycentric(models[0].reshape(4, 3), np.c_[x, y, z]), np.zeros((2 * len(u), 12))
    for j in range(4):
        m[0::2, 3 * j], m[0::2, 3 * j + 2] = bary[:, j], -bary[:, j] * u
        m[1::2, 3 * j + 1], m[1::2, 3 * j + 2] = bary[:, j], -bary[:, j] * v
    return m.T @ m


def _rigid_of_moments(moments: np.ndarray, control: np.ndarray, cam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R, t of the affine map that takes control points to ``cam``, over points with these moments."""
    affine = np.linalg.solve(np.c_[control, np.ones(4)], cam).T  # camera = affine (world, 1)
    n, c = moments[3, 3], moments[:3, 3] / moments[3, 3]
    if affine[2] @ np.r_[c, 1] < 0:
        affine = -affine
    spread = moments[:3, :3] / n - np.outer(c, c)
    u, _, vt = np.linalg.svd(affine[:, :3] @ spread)
    r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    return r, affine @ np.r_[c, 1] - r @ c


def _options(moments: np.ndarray, control: np.ndarray, system: np.ndarray) -> list[np.ndarray]:
    """Poses from one and from two null vectors of the 12 x 12 system."""
    null = np.linalg.eigh(system)[1][:, :2]
    at = [(i, j) for i in range(4) for j in range(i)]
    length = np.array([np.sum((control[i] - control[j]) ** 2) for i, j in at])
    d = [np.stack([null[:, k].reshape(4, 3)[i] - null[:, k].reshape(4, 3)[j] for i, j in at]) for k in (0, 1)]
    one = np.sum(np.sqrt(np.sum(d[0] ** 2, 1) * length)) / max(np.sum(d[0] ** 2), 1e-12)
    b = np.linalg.lstsq(np.stack([np.sum(d[0] ** 2, 1), 2 * np.sum(d[0] * d[1], 1), np.sum(d[1] ** 2, 1)], 1), length, rcond=None)[0]
    weights = (np.array([one, 0.0]), np.array([np.sqrt(abs(b[0])), np.sqrt(abs(b[2])) * (1 if b[1] >= 0 else -1)]))
    return [np.r_[r.ravel(), t] for w in weights for r, t in [_rigid_of_moments(moments, control, (null @ w).reshape(4, 3))]]


def pose_of_all(parts: DataFrame) -> DataFrame:
    """g, m, error: pose from all 2D-3D rows of each group: 16 and then 144 sums a group, refined; the better of two options."""
    none = parts.select("g").distinct().select("g", F.lit(0).alias("s"), F.array(F.lit(0.0)).alias("m"))
    moments = written(_solved(over_blocks(parts, none, _outer, 16, SIX), 16, lambda v: v), "pose-moments")
    control = moments.mapInPandas(lambda frames: (pdf.assign(m=[_control(np.reshape(m, (4, 4))).ravel().tolist() for m in pdf["m"]]) for pdf in frames), POSES)
    control = written(control, "pose-control")
    system = _solved(over_blocks(parts, control, _system, 144, SIX), 144, lambda v: v)
    every = moments.select("g", F.col("m").alias("moments")).join(control.select("g", F.col("m").alias("control")), "g").join(system.select("g", F.col("m").alias("system")), "g")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [(g, _options(np.reshape(a, (4, 4)), np.reshape(b, (4, 3)), np.reshape(c, (12, 12)))) for g, a, b, c in zip(*[pdf[k] for k in ("g", "moments", "control", "system")])]
            yield pd.DataFrame([(g, s, m.tolist()) for g, ms in found for s, m in enumerate(ms)], columns=["g", "s", "m"])

    options = written(every.mapInPandas(run, POSES), "pose-options")
    both = [refine(parts, options.where(F.col("s") == s)).select("g", F.lit(s).alias("s"), "m") for s in (0, 1)]
    both = written(both[0].unionByName(both[1]), "pose-options")

    def error(u, v, x, y, z, poses):
        e = [np.minimum(G.reprojection(p[:9].reshape(3, 3), p[9:], np.c_[u, v], np.c_[x, y, z]), 1e6) for p in poses]
        return np.sum(e, 1)

    top = over_blocks(parts, both, error, 2, SIX).groupBy("g").agg(F.min(F.struct("v", "i")).alias("x")).select("g", F.col("x.i").alias("s"), F.col("x.v").alias("error"))
    return both.join(top, ["g", "s"]).select("g", "m", "error")
