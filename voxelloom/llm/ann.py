"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample: the sample's neighbour graph is cut into balanced parts (recursive bisection
along the graph's second eigenvector, refined by swaps), and a small classifier (softmax regression on
the vector) learns to tell the parts. Parts grow in number with the square root of the rows: where that is
more than one cut of ``CUT`` parts, executors cut every part again by a sample of its own rows, and a row's
probability of a part is the product of both classifiers'. Index: every row goes to its most
probable part. Search: a query goes to its ``probes`` most probable parts and is reranked exactly there. How
many parts to probe is measured, not guessed: a few queries are answered exactly over all rows, and the
parts of their true neighbours tell the fewest probes that reach the wanted recall.

A part with many rows is dealt out in blocks, and so are its queries, each pair of blocks a group of its own,
so a hot part is never one task; within a block equal vectors are searched once, and only the k + 1
smallest ids among equals can be returned, which is exact because ties go to the smaller id.

Edge cases: vectors that are null, of another width than most, zero, or hold null or non-finite values
take no part; fewer candidates than k are all returned; repeated ids count as one another's own row;
an empty table gives an empty result; other columns are not read. Parts that a query does not probe are not searched
for it, so all candidates are returned only when all parts are probed, as with few rows.
"""

from __future__ import annotations

from typing import Iterator  # noqa: UP035  the hint that Spark looks for

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.session import ship, written

#: Rows that partitions and classifier are fitted on.
SAMPLE = 4000
#: Queries that are answered exactly over all rows to set the number of probes.
PROBE_QUERIES = 64
#: Square root of the rows for each part wanted, and parts of one cut at most.
ROOT, CUT = 12.0, 128
#: Rows of one part, and queries of one part, searched in one task.
BLOCK = 20_000
NEIGHBOURS = 10


def valid_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(key).isNotNull() & ok).select(F.col(key).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _bisect(graph: np.ndarray, members: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size with few graph edges between them."""
    a = graph[np.ix_(members, members)].astype(float)
    d = a.sum(1) + 1e-9
    v = x[members] @ np.linalg.svd(x[members] - x[members].mean(0), full_matrices=False)[2][0]
    for _ in range(60):  # power iteration of the normalised graph, without its trivial vector
        v = v - (d @ v) / d.sum()
        v = 0.5 * v + 0.5 * (a @ v) / d
        v /= max(np.linalg.norm(v), 1e-12)
    side = np.zeros(len(members), bool)
    side[np.argsort(v, kind="stable")[len(members) // 2 :]] = True
    for _ in range(8):  # swaps of equal numbers: those with most to gain first
        gain = (a @ side - a @ ~side) * np.where(side, -1, 1)
        up, down = np.flatnonzero(~side), np.flatnonzero(side)
        up, down = up[np.argsort(-gain[up], kind="stable")], down[np.argsort(-gain[down], kind="stable")]
        n = min(len(up), len(down), max(1, len(members) // 20))
        n = int((gain[up[:n]] + gain[down[:n]] > 0).sum())
        if not n:
            break
        side[up[:n]], side[down[:n]] = True, False
    return members[~side], members[side]


def partition_sample(x: np.ndarray, parts: int) -> np.ndarray:
    """Part of each sample row: a balanced cut of the sample's neighbour graph."""
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    k = min(NEIGHBOURS, len(x) - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(x), 0), int)
    graph = np.zeros((len(x), len(x)), np.uint8)
    graph[np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()] = 1
    graph |= graph.T
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups = [h for g in groups for h in (_bisect(graph, g, x) if len(g) > 1 else (g,))]
        if max(map(len, groups)) <= 1:
            break
    out = np.zeros(len(x), int)
    for j, g in enumerate(groups):
        out[g] = j
    return out


def train_router(x: np.ndarray, y: np.ndarray, parts: int, rounds: int = 150, rate: float = 4.0) -> np.ndarray:
    """Softmax regression (last row: bias) by full-batch gradient descent with momentum."""
    x1 = np.c_[x, np.ones(len(x))]
    w, m, t = np.zeros((x1.shape[1], parts)), 0.0, np.eye(parts)[y]
    for _ in range(rounds):
        z = x1 @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        m = 0.9 * m + x1.T @ (p - t) / len(x) * x.shape[1] ** 0.5 + 1e-5 * w
        w = w - rate * m * 0.3
    return w


def _log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-probabilities of unit vectors' parts."""
    z = x @ w[:-1] + w[-1]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


class Router:
    """One classifier over the first cut and, where parts were cut again, one over each part's own parts."""

    def __init__(self, top: np.ndarray, below: dict[int, np.ndarray] | None = None):
        self.top, self.below = top, below or {}
        sizes = [self.below[p].shape[1] if p in self.below else 1 for p in range(top.shape[1])]
        self.first = np.r_[0, np.cumsum(sizes)]

    @property
    def parts(self) -> int:
        return int(self.first[-1])

    def own(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of each row: first by the first cut, then within it."""
        n = _unit(x)
        top = _log_odds(n, self.top).argmax(1)
        out = self.first[top]
        for p in np.unique(top) if self.below else ():
            if p in self.below:
                out[top == p] += _log_odds(n[top == p], self.below[p]).argmax(1)
        return out

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """All parts of each row, the most probable first."""
        n = _unit(x)
        top = _log_odds(n, self.top)
        every = [top[:, p : p + 1] + (_log_odds(n, self.below[p]) if p in self.below else 0.0) for p in range(top.shape[1])]
        return np.argsort(-np.concatenate(every, axis=1), axis=1, kind="stable")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit_cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Classifier of a balanced cut of sample rows ``x`` into about ``parts`` parts of at least 16 of them."""
    x = np.unique(_unit(x), axis=0)  # copies of one vector would be a part of their own
    y = partition_sample(x, min(parts, max(1, len(x) // 16)))
    return train_router(x, y, int(y.max()) + 1)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the wanted width, and which those are."""
    right = column.value_lengths().to_numpy(zero_copy_only=False) == width
    return np.asarray(column.filter(pa.array(right)).flatten(), float).reshape(-1, width), right


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, summed in order of component: the same for equal vectors anywhere."""
    s = np.zeros(len(q))
    for d in range(q.shape[1]):
        s += q[:, d] * x[:, d]
    return s


def best(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, vec_id and score of the k best of x for each query, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    u, of = np.unique(x, axis=0, return_inverse=True)
    by = np.lexsort((ids, of.ravel()))
    start = np.searchsorted(of.ravel()[by], np.arange(len(u) + 1))
    keep = by[np.arange(len(by)) - np.repeat(start[:-1], np.diff(start)) <= k]  # k + 1 of equals
    ids, x = ids[keep], x[keep]
    out: list[tuple] = []
    for a in range(0, len(q), 256):
        sims = q[a : a + 256] @ x.T
        n = min(k + 1, len(x))
        bar = np.partition(sims, len(x) - n, axis=1)[:, len(x) - n]
        i, j = np.nonzero(sims >= (bar - 1e-9 * np.maximum(1.0, np.abs(bar)))[:, None])  # rounding may reorder; near ties are kept
        s = exact_scores(q[a + i], x[j])
        own = qid[a + i] == ids[j]
        i, j, s = i[~own], j[~own], s[~own]
        o = np.lexsort((ids[j], -s, i))
        i, j, s = i[o], j[o], s[o]
        first = np.searchsorted(i, np.arange(len(q[a : a + 256]) + 1))
        top = np.arange(len(i)) - np.repeat(first[:-1], np.diff(first)) < k
        out.append((qid[a + i[top]], ids[j[top]], s[top]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _exact(sent, k: int, width: int):
    """True neighbours in this partition of a few broadcast queries, with the parts that hold them."""

    def run(batches):
        qid, q, router = sent.value
        for batch in batches:
            x, right = _matrix(batch.column("v"), width)
            ids = batch.column("vec_id").to_numpy()[right]
            if len(ids):
                part = dict(zip(ids.tolist(), router.own(x).tolist()))
                a, b, s = best(qid, q, ids, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s), pa.array([part[i] for i in b.tolist()], pa.int32())], ["query_id", "vec_id", "score", "part"])

    return run


def _sizes(sent, probes: int, width: int):
    """part, query, n: rows of each part and queries that probe it, over a partition."""

    def run(batches):
        rows, asked = (np.zeros(sent.value.parts, np.int64) for _ in range(2))
        for batch in batches:
            x, right = _matrix(batch.column("v"), width)
            if len(x):
                rows += np.bincount(sent.value.own(x), minlength=len(rows))
                q = x[batch.column("ask").to_numpy(zero_copy_only=False)[right]]
                asked += np.bincount(sent.value.ranked(q)[:, :probes].ravel(), minlength=len(rows))
        for query, n in ((False, rows), (True, asked)):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), query)), pa.array(n[at])], ["part", "query", "n"])

    return run


def _spread(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % of


_ROUTED = "part int, block int, asked int, query boolean, vec_id long, v array<double>"


def _route(sent, probes: int, width: int, blocks):
    """Index rows go to a block of their part, query rows to a block of each part they probe; a group is a pair of blocks."""
    names = [c.split()[0] for c in _ROUTED.split(", ")]

    def rows(part, block, asked, query, ids, v):
        for a in range(0, len(part), 4096):
            i = [c[a : a + 4096] for c in (part, block, asked)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in i), pa.array(np.full(len(i[0]), query)), pa.array(ids[a : a + 4096]), v.slice(a, len(i[0]))], names)

    def across(n):
        """Row numbers repeated n times each, and the number of the repeat."""
        at = np.repeat(np.arange(len(n)), n)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)

    def run(batches):
        router, (held, asks) = sent.value, blocks.value
        for batch in batches:
            x, right = _matrix(batch.column("v"), width)
            if not len(x):
                continue
            ids, v = batch.column("vec_id").to_numpy()[right], batch.column("v").filter(pa.array(right))
            part = router.own(x)
            at, asked = across(asks[part])
            yield from rows(part[at], _spread(ids, np.maximum(held[part], 1))[at], asked, False, ids[at], v.take(pa.array(at)))
            q = np.flatnonzero(batch.column("ask").to_numpy(zero_copy_only=False)[right])
            if len(q):
                probed = router.ranked(x[q])[:, :probes]
                q, part = np.repeat(q, probed.shape[1]), probed.ravel()
                at, block = across(held[part])
                yield from rows(part[at], block, _spread(ids[q], np.maximum(asks[part], 1))[at], True, ids[q][at], v.take(pa.array(q[at])))

    return run


def _search(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        if not len(t):
            return
        x, _ = _matrix(t["v"].combine_chunks(), width)
        query, ids = t["query"].to_numpy(), t["vec_id"].to_numpy()
        a, b, s = best(ids[query], x[query], ids[~query], x[~query], k) if query.any() and (~query).any() else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, is_query, k: int = 20, recall: float = 0.95, key: str = "vec_id", vector: str = "embedding", parts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, measured_recall, probes, parts for the rows where ``is_query`` (a condition on vec_id) holds.

    ``recall``: wanted mean share of true neighbours on the measured queries; more than asked of the
    whole, since they are few.
    """
    spark = rows.sparkSession
    ship(spark)
    ok = written(valid_vectors(rows, key, vector), "ann-valid")
    n = ok.count()
    width = ok.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, measured_recall double, probes int, parts int")
    if width is None:
        return empty
    width = width["w"]
    ok = ok.where(F.size("v") == width)
    by_hash = ok.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id")
    x, _ = _matrix(by_hash.limit(SAMPLE).toArrow()["v"].combine_chunks(), width)
    wanted = parts or 2 ** max(4, round(np.log2(max(n, 1) ** 0.5 / ROOT)))
    router = Router(fit_cut(x, min(wanted, CUT)))
    if wanted > router.parts == CUT:
        router = _cut_again(ok, router, width, min(CUT, wanted // CUT))
    sent = spark.sparkContext.broadcast(router)

    probes, reached = router.parts, 1.0
    if router.parts > 1:
        few = ok.where(is_query).withColumn("h", F.xxhash64("vec_id", F.lit(1))).orderBy("h", "vec_id").limit(PROBE_QUERIES).toArrow()
        if len(few):
            q, _ = _matrix(few["v"].combine_chunks(), width)
            asked = spark.sparkContext.broadcast((few["vec_id"].to_numpy(), q, router))
            top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            true = ok.mapInArrow(_exact(asked, k, width), "query_id long, vec_id long, score double, part int").withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).toPandas()
            place = dict(zip(few["vec_id"].to_pylist(), np.argsort(router.ranked(q), axis=1)))
            at = np.array([place[a][p] for a, p in zip(true["query_id"], true["part"])])
            if len(at):
                probes = int(np.quantile(at, recall, method="higher")) + 1
                reached = float((at < probes).mean())
    rows = ok.select("vec_id", "v", is_query.alias("ask"))
    held, asks = np.zeros(router.parts, np.int64), np.zeros(router.parts, np.int64)
    for r in rows.mapInArrow(_sizes(sent, probes, width), "part int, query boolean, n long").groupBy("part", "query").agg(F.sum("n").alias("n")).collect():  # two rows a part
        (asks if r["query"] else held)[r["part"]] = -(-r["n"] // BLOCK)
    blocks = spark.sparkContext.broadcast((held, asks))
    routed = rows.mapInArrow(_route(sent, probes, width, blocks), _ROUTED)
    found = routed.groupBy("part", "block", "asked").applyInArrow(_search(k, width), "query_id long, vec_id long, score double")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    measured = [F.lit(reached).alias("measured_recall"), F.lit(probes).alias("probes"), F.lit(router.parts).alias("parts")]
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *measured)


def _cut_again(ok: DataFrame, router: Router, width: int, parts: int) -> Router:
    """Every part cut again, on executors, by a sample of its own rows: a classifier a part comes back."""
    sent = ok.sparkSession.sparkContext.broadcast(router)

    def place(batches):
        for batch in batches:
            x, right = _matrix(batch.column("v"), width)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.own(x).astype(np.int32)), batch.column("vec_id").filter(pa.array(right)), batch.column("v").filter(pa.array(right))], ["part", "vec_id", "v"])

    def cut(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        x, _ = _matrix(rows["v"].combine_chunks(), width)
        return pa.table({"part": rows["part"].slice(0, 1), "w": pa.array([fit_cut(x, parts).tobytes()], pa.binary())})

    own = ok.mapInArrow(place, "part int, vec_id long, v array<double>")
    first = Window.partitionBy("part").orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = own.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE).drop("r")
    found = sample.groupBy("part").applyInArrow(cut, "part int, w binary").collect()  # CUT rows at most
    return Router(router.top, {r["part"]: np.frombuffer(r["w"], float).reshape(width + 1, -1) for r in found})
