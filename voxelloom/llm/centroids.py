"""Exact k-means on integer vectors with Yinyang bounds.

Components are floor(scale * x). Centroids start as the vectors with the smallest key hashes; each round assigns every vector to the
nearest centroid (squared Euclidean distance, ties to the smaller number) and moves every non-empty centroid to the floored mean.

The centroids are put into groups once, by a few rounds of k-means over themselves. Every vector keeps an upper bound of the distance
to its centroid and, per group, a lower bound of the distance to the group's other centroids. After centroids move, the upper bound
grows by its centroid's drift and each lower bound falls by its group's largest drift. A vector whose upper bound stays below all lower
bounds keeps its centroid (the global filter; tried again with the exact distance); of the others, groups whose lower bound is above
the upper bound are passed over (the group filter); the centroids of the surviving groups are scanned exactly, in integers. Bounds are
doubles and only skip work with a margin of ``MARGIN``, so results are those of plain k-means, ties included.

Vectors and bounds are one table in the shared folder, written anew each round by a pass without a shuffle; the table of the round
before goes. Centroids move by the changes: each batch adds up the vectors that joined and left each centroid, and those sums alone are
exchanged. The driver holds the centroids and their sums, k * (dimensions + 2) numbers.

Edge cases: vectors of another length, null ones and ones with null or non-finite components take no part and have no row; repeated rows
count each; a null key hashes as an empty one; fewer vectors than centroids make as many centroids as vectors; keys with equal hashes
are taken in order of their components; an empty table gives an empty result; other columns are not read. A component beyond +-2**27
after scaling is an error, as its squared distances do not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.memory import tidy
from voxelloom.session import discard, ship, written

#: Relative width by which bounds must differ before they skip a scan.
MARGIN = 1e-9
LIMIT = 1 << 27


def integers(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """vec_id, x: the vectors that take part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.when(F.abs(v) < LIMIT / scale, F.floor(v * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for 64-bit distances")).cast("int")))
    return vectors.where((F.size(vector) == dims) & finite).select(F.col(key).cast("long").alias("vec_id"), whole.alias("x"))


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and key, in order of the hash."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in found], np.int64)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """Each centroid's group, by five rounds of k-means over the centroids from the first ones."""
    c = centroids.astype(float)
    middle = c[:groups].copy()
    for _ in range(5):
        g = ((c[:, None, :] - middle[None]) ** 2).sum(2).argmin(1)
        for i in range(len(middle)):
            if (g == i).any():
                middle[i] = c[g == i].mean(0)
    return np.unique(g, return_inverse=True)[1]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of c."""
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


@dataclass
class Step:
    """What the tasks of one round need: centroids, their groups, and how far each moved since the round before (none: first round)."""

    centroids: np.ndarray
    group: np.ndarray
    drift: np.ndarray | None = None

    def assign(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New assignment and bounds, and how many distances were computed."""
        c, group, n = self.centroids, self.group, len(x)
        members = [np.flatnonzero(group == g) for g in range(group.max() + 1)]
        if self.drift is None:
            d = distances(x, c)
            a = d.argmin(1)  # the first of equal ones
            root = np.sqrt(d.astype(float))
            upper = root[np.arange(n), a]
            root[np.arange(n), a] = np.inf
            return a, upper, np.stack([root[:, m].min(1) for m in members], 1), d.size
        upper = upper + self.drift[a]
        lower = lower - np.array([self.drift[m].max() for m in members])
        scans = 0
        live = np.flatnonzero(lower.min(1) <= upper * (1 + MARGIN) + MARGIN)
        if len(live):  # the global filter again, with the exact distance
            own = ((x[live] - c[a[live]]) ** 2).sum(1)
            scans += len(live)
            upper[live] = np.sqrt(own.astype(float))
            keep = lower[live].min(1) <= upper[live] * (1 + MARGIN) + MARGIN
            live, own = live[keep], own[keep]
        if len(live):
            old, best, number = a[live], own.copy(), a[live].copy()
            second = lower[live].copy()  # per group: the least distance, or its bound, to centroids but ``number``
            bound = upper[live] * (1 + MARGIN) + MARGIN
            seen = np.full((len(live), len(c)), np.inf)
            seen[np.arange(len(live)), old] = upper[live]
            for g, m in enumerate(members):
                scan = np.flatnonzero(lower[live, g] <= bound)
                if not len(scan):
                    continue
                d = distances(x[live[scan]], c[m])
                scans += d.size
                seen[np.ix_(scan, m)] = np.sqrt(d.astype(float))
                first = d.argmin(1)
                near, who = d[np.arange(len(scan)), first], m[first]
                better = (near < best[scan]) | ((near == best[scan]) & (who < number[scan]))
                best[scan[better]], number[scan[better]] = near[better], who[better]
                second[scan, g] = np.inf  # known exactly below
            seen[np.arange(len(live)), number] = np.inf
            for g, m in enumerate(members):
                # Of a scanned group every distance is known; of another one at most the old centroid's, now no longer its own.
                second[:, g] = np.minimum(second[:, g], seen[:, m].min(1))
            a = a.copy()
            a[live], upper[live], lower[live] = number, np.sqrt(best.astype(float)), second
        return a, upper, lower, scans


STATE = "vec_id long, x array<int>, cluster int, upper double, lower array<double>, moved array<long>"


def _round(rows: DataFrame, step: Step, last: bool) -> DataFrame:
    """One round over a table of vec_id, x or of ``STATE``. ``moved`` of a batch's first row: what joined less what left each centroid,
    as sums of components, then counts, then distances computed (and with ``last`` inertia). ``last`` puts squared distances into ``upper``'s place."""
    k, dims = step.centroids.shape
    groups = int(step.group.max()) + 1

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(n, dims).astype(np.int64)
            if step.drift is None:
                old = np.full(n, -1)
                a, upper, lower, scans = step.assign(x, old, None, None)
            else:
                old = batch.column(2).to_numpy().astype(np.int64)
                bounds = batch.column(4).flatten().to_numpy().reshape(n, groups)
                a, upper, lower, scans = step.assign(x, old, batch.column(3).to_numpy(), bounds)
            sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
            changed = a != old
            for c in range(k):
                joined, left = changed & (a == c), changed & (old == c)
                sums[c] = x[joined].sum(0) - x[left].sum(0)
                counts[c] = joined.sum() - left.sum()
            names = ["vec_id", "x", "cluster", "upper", "lower", "moved"]
            if last:
                d = ((x - step.centroids[a]) ** 2).sum(1)
                inertia = np.zeros(k, np.int64)
                np.add.at(inertia, a, d)
                more = np.concatenate([sums.ravel(), counts, [scans], inertia])
                cols, names = [batch.column(0), pa.array(a, pa.int32()), pa.array(d)], ["vec_id", "cluster", "distance", "moved"]
            else:
                more = np.concatenate([sums.ravel(), counts, [scans]])
                cols = [batch.column(0), batch.column(1), pa.array(a, pa.int32()), pa.array(upper), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * groups), pa.array(lower.ravel()))]
            cols.append(pa.array([more.tolist(), *[None] * (n - 1)], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(tidy(run), "vec_id long, cluster int, distance long, moved array<long>" if last else STATE)


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of the ``moved`` arrays, place by place."""
    out = np.zeros(size, np.int64)
    for i, v in rows.where("moved is not null").select(F.posexplode("moved").alias("i", "v")).groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out


@dataclass
class Clusters:
    """``rows``: vec_id, cluster, distance. ``scans``: distances computed in each round."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int]
    scans: list[int] = field(default_factory=list)


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, groups: int | None = None, key: str = "vec_id", vector: str = "embedding"
) -> Clusters:
    """Assignment after ``rounds`` updates. ``groups``: centroid groups of the bounds, one for four centroids by default."""
    ship(vectors.sparkSession)
    rows = integers(vectors, key, vector, dims, scale)
    centroids = starts(rows, k, seed)
    if not len(centroids):
        return Clusters(rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids, [])
    k = len(centroids)
    group = grouped(centroids, min(k, groups or max(1, k // 4)))
    sums, counts, scans, before, drift = np.zeros((k, dims), object), np.zeros(k, object), [], None, None
    for turn in range(rounds + 1):
        now = written(_round(before if turn else rows, Step(centroids, group, drift), turn == rounds), "centroid-round")
        discard(before)
        before = now
        moved = _summed(now, k * (dims + 1) + 1 + (k if turn == rounds else 0))
        scans.append(int(moved[k * (dims + 1)]))
        if turn == rounds:
            return Clusters(now.drop("moved"), centroids, [int(v) for v in moved[-k:]], scans)
        sums = sums + moved[: k * dims].reshape(k, dims).astype(object)
        counts = counts + moved[k * dims : k * (dims + 1)].astype(object)
        new = np.array([[s // n for s in row] if n else old for row, n, old in zip(sums.tolist(), counts.tolist(), centroids.tolist())], np.int64)
        drift, centroids = np.sqrt(((new - centroids) ** 2).sum(1).astype(float)), new


def _lookup(values: list, by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), by + 1)


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per vector that takes part."""
    found = cluster(vectors, **options)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()] or [""]
    inertia = found.inertia or [0]
    own, every = _lookup(inertia, F.col("cluster")).cast("long"), F.lit(sum(inertia)).cast("long")
    return found.rows.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), every.alias("inertia"), _lookup(hashes, F.col("cluster")).alias("centroid_sha256"))
