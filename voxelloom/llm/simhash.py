"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``distance`` bits must, for any split of the 64 bits into parts whose thresholds t
satisfy sum(t + 1) = distance + 1, agree to within t in at least one part (t = -1: the part is not
used). Correlated bits are put into one part, so that the other parts tell documents apart; a dynamic
programme chooses the number of parts and the thresholds with the least estimated work from candidate
counts over all fingerprints. Whatever it chooses, no link is lost.

Probing works on distinct fingerprints. A part with threshold t gives one key per choice of t masked
bits, equal for all values within t of each other. Rows that share a key are verified together; a key
with more than ``BLOCK`` rows is dealt out as pairs of blocks, each a group of its own. From one group
come its links or, where they are many, a spanning forest of them: components stay exact and a group
of near copies gives as many rows as it has members, not their square. A node is the pair of its smallest
key and its fingerprint, so the smallest node of a component tells the component's smallest key, and no
join gathers a component.

Edge cases: null and blank texts have fingerprint zero and link like any other; repeated rows and
equal texts share a fingerprint; null keys are ignored when the smallest key is taken (null where all are);
an empty table gives an empty result; very long texts are hashed whole, in slices; other columns are not
read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import acos, comb, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.components import components
from voxelloom.llm.exact_dedup import without
from voxelloom.llm.jaccard import exact_links
from voxelloom.llm.memory import tidy
from voxelloom.session import ship, written

SEED = 42
#: Members of a key that are verified in one group.
BLOCK = 4096
#: Cost of a key row (made, exchanged, sorted, sent to Python) against checking one candidate pair in a vector operation.
KEY_COST = 1500.0
#: Independent fingerprints of a text's words by which near copies meet, and words of the long one that verifies them.
FAMILIES, LONG = 2, 8
#: Standard deviations of the long fingerprint by which a link must be above the similarity to need no shingles.
SURE = 3.0
#: Key of nodes that have none.
NO_KEY = (1 << 63) - 1

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)


def shingle_hashes(data: bytes, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle of the normalised text, as unsigned 64-bit integers."""
    words = data.lower().split()  # A-Z only; splits at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined, n, xxh = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= k:
        return np.array([xxh(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts, view = ends - lengths, memoryview(joined)
    return np.fromiter((xxh(view[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, n - k + 1)


def majorities(h: np.ndarray) -> np.ndarray:
    """For each row of hashes the bits that more than half of them have; zero for no hashes."""
    m, n = h.shape
    ones, base = np.zeros((m * 8, 8)), (256 * np.arange(m * 8)).reshape(m, 1, 8)
    for i in range(0, n, 1 << 13):  # how often each byte has each value, then each bit
        b = np.ascontiguousarray(h[:, i : i + (1 << 13)]).astype("<u8", copy=False).view(np.uint8).reshape(m, -1, 8)
        ones += np.bincount((b + base).ravel(), minlength=m * 2048).reshape(-1, 256) @ _BITS
    return np.packbits(2 * ones > n, axis=1, bitorder="little").reshape(m, 8).view("<u8")[:, 0]


def fingerprint(data: bytes, k: int) -> int:
    return int(majorities(shingle_hashes(data, k)[None])[0])


def _mixed(h: np.ndarray, first: int, n: int) -> np.ndarray:
    """n further hashes of each hash, one row each."""
    x = (h[None] ^ (np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(29))


def word_and_shingle_hashes(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct words and of its distinct k-word shingles (all words, where there are fewer)."""
    w = shingle_hashes(data, 1)
    if not len(w):
        return w, w
    n, s = max(1, len(w) - k + 1), np.zeros(max(1, len(w) - k + 1), np.uint64)
    for i in range(min(k, len(w))):
        s = (s ^ (s >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + w[i : i + n]
    return np.unique(w), np.unique(s)


def near_fingerprints(data: bytes, k: int) -> np.ndarray:
    """``FAMILIES`` fingerprints of the distinct words, then ``LONG`` of the distinct shingles."""
    words, shingles = word_and_shingle_hashes(data, k)
    return np.r_[majorities(_mixed(words, 1, FAMILIES)), majorities(_mixed(shingles, 101, LONG))]


def long_limit(similarity: float, deviations: float = 2.33) -> int:
    """Bits of the long fingerprint within which 99 in 100 texts of that Jaccard similarity lie. With negative
    ``deviations``: bits within which hardly any of that similarity or less lie."""
    p, n = acos(2 * similarity / (1 + similarity)) / pi, 64 * LONG
    return int(n * p + deviations * sqrt(n * p * (1 - p)))


def _fingerprints(k: int):
    def run(batches):
        for batch in batches:
            keys, texts = batch.columns
            fp = [fingerprint(bytes(t.as_buffer()) if t.is_valid else b"", k) for t in texts]
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def _fingerprint_sets(k: int):
    """Fingerprints of the words, the long one of the shingles, and an id of all."""
    names = ["doc_id", "h", *[f"fp{i}" for i in range(FAMILIES)], "check", "id"]

    def run(batches):
        for batch in batches:
            keys, hashes, texts = batch.columns
            rows = [near_fingerprints(bytes(t.as_buffer()) if t.is_valid else b"", k) for t in texts]
            x = np.array(rows, np.uint64).reshape(-1, FAMILIES + LONG)
            ids = np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in rows], np.uint64)
            check = pa.array([r[FAMILIES:].tobytes() for r in rows], pa.binary())
            fps = [pa.array(np.ascontiguousarray(x[:, i]).view(np.int64)) for i in range(FAMILIES)]
            yield pa.RecordBatch.from_arrays([keys, hashes, *fps, check, pa.array(ids.view(np.int64))], names)

    return run


def _bit_pairs(batches):
    """How often each pair of bits is set together, over a partition."""
    total = np.zeros((64, 64))
    for batch in batches:
        x = batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
        b = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
        for i in range(0, len(b), 1 << 14):
            total += b[i : i + (1 << 14)].T @ b[i : i + (1 << 14)]
    i, j = np.triu_indices(64)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])


def bit_groups(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Splits the 64 bits into parts of even size, gathering the most correlated bits first."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs(cov / np.outer(sd, sd))
    corr[:, p * (1 - p) < 1e-9] = corr[p * (1 - p) < 1e-9] = 1.0  # constant bits tell nothing apart: together
    left, out = set(range(64)), []
    for g in range(parts):
        size = 64 // parts + (g < 64 % parts)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        while len(group) < size:
            group.append(max((b for b in rest if b not in group), key=lambda b: (corr[b, group].sum(), -b)))
        left -= set(group)
        out.append(sorted(group))
    return out


def allocate(work: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 and the least sum of work[i][t_i + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in work:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for t1 in range(min(len(costs), distance + 2 - spent)):
                option = (c + costs[t1], [*chosen, t1 - 1])
                if spent + t1 not in step or option < step[spent + t1]:
                    step[spent + t1] = option
        best = step
    return best[distance + 1]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plan(fps: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every part used, from statistics over all fingerprints."""
    n = fps.count()
    rows = fps.select("fp").mapInArrow(_bit_pairs, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect()  # 2080 rows at most
    both = np.zeros((64, 64))
    for i, j, c in rows:
        both[i, j] = both[j, i] = c
    splits = {m: bit_groups(both, n, m) for m in range(2, distance + 2)} if distance else {1: [list(range(64))]}
    # Pairs that agree in a whole part, counted exactly; agreement within t is estimated from it.
    masks = F.explode(F.array(*[F.struct(F.lit(f"{m}:{i}").alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(g)))).alias("v")) for m, gs in splits.items() for i, g in enumerate(gs)])).alias("x")
    same = fps.select(masks).groupBy("x.part", "x.v").count().groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count"))).collect()
    equal = dict(map(tuple, same))
    best: tuple[float, list] | None = None
    for m, groups in splits.items():
        work = []
        for i, g in enumerate(groups):
            costs = [0.0]
            for t in range(min(3, distance + 1)):
                keys = comb(len(g), t)
                costs.append(n * keys * KEY_COST + equal.get(f"{m}:{i}", 0.0) * sum(comb(len(g), e) for e in range(t + 1)))
            work.append(costs)
        try:
            cost, t = allocate(work, distance)
        except KeyError:  # too few parts for thresholds of 2 at most
            continue
        if best is None or cost < best[0]:
            best = (cost, [(g, e) for g, e in zip(groups, t) if e >= 0])
    assert best is not None
    return best[1]


def _within(x: np.ndarray, y: np.ndarray, limits: tuple[int, ...]) -> np.ndarray:
    """Which rows of fingerprints lie within all limits; a second limit is over all later words."""
    near = np.flatnonzero(np.bitwise_count(x[:, 0] ^ y[..., 0]) <= limits[0])
    if len(limits) > 1 and len(near):
        far = np.bitwise_count(x[near, 1:] ^ (y[near, 1:] if y.ndim > 1 else y[1:])).sum(-1, dtype=np.int64)
        near = near[far <= limits[1]]
    return near


def _forest(x: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs of a spanning forest of the links among rows x, and the tree of each row."""
    left, us, vs = np.arange(len(x)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    tree = np.zeros(len(x), np.int64)
    while len(left):
        root, stack, left = left[0], [left[0]], left[1:]
        tree[root] = root
        while stack and len(left):
            p = stack.pop()
            hit = _within(x[left], x[p], limits)
            if len(hit):
                found, left = left[hit], np.delete(left, hit)
                us.append(np.repeat(p, len(found)))
                vs.append(found)
                tree[found] = root
                stack.extend(found)
    return np.concatenate(us), np.concatenate(vs), tree


def _near(x: np.ndarray, limits: tuple[int, ...], sure: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of links among rows x of fingerprints: all of them, or a spanning forest where they are many.
    With ``sure``, the forest is of links that are sure wherever these connect."""
    if len(x) <= 512:
        a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None, 0] ^ x[None, :, 0]) <= limits[0], 1))
        ok = _within(x[a], x[b], limits)
        if len(ok) <= 4 * len(x):
            return a[ok], b[ok]
    if sure is None:
        return _forest(x, limits)[:2]
    u, v, tree = _forest(x, (limits[0], sure))
    if (tree == tree[0]).all():
        return u, v
    a, b, _ = _forest(x, limits)
    across = tree[a] != tree[b]
    return np.concatenate([u, a[across]]), np.concatenate([v, b[across]])


def _verify(limits: tuple[int, ...], sure: int | None = None):
    """Over rows sorted by key: verifies each run of one key, holding one run and one batch.

    Columns: key, fp, id, least and, under two limits, the long fingerprint. With ``sure``, each link also tells
    whether its long fingerprints lie within that many bits.
    """
    width = 1 + LONG * (len(limits) - 1)
    names = ["u", "u_least", "v", "v_least", "sure"]

    def run(batches):
        k, x, ids = np.zeros(0, np.int64), np.zeros((0, width), np.uint64), np.zeros((0, 2), np.int64)

        def out(n):
            us, vs = _runs(k[:n], x[:n], limits, sure)
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                cols = [pa.array(np.ascontiguousarray(c)) for e in (ids[u], ids[v]) for c in e.T]
                if sure is not None:
                    cols.append(pa.array(np.bitwise_count(x[u, 1:] ^ x[v, 1:]).sum(1, dtype=np.int64) <= sure))
                yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

        for batch in batches:
            new = batch.column(1).to_numpy().view(np.uint64)[:, None]
            if width > 1:
                long = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u8").reshape(-1, LONG)
                new = np.concatenate([new, long], axis=1)
            node = np.stack([batch.column(c).to_numpy() for c in (2, 3)], axis=1)
            k, x, ids = np.concatenate([k, batch.column(0).to_numpy()]), np.concatenate([x, new]), np.concatenate([ids, node])
            last = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last run may go on
            yield from out(last)
            k, x, ids = k[last:], x[last:], ids[last:]
        yield from out(len(k))

    return run


def _runs(k: np.ndarray, x: np.ndarray, limits: tuple[int, ...], sure: int | None) -> tuple[list, list]:
    """Row pairs of the links within each run of equal keys."""
    us, vs = [], []
    if not len(k):
        return us, vs
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[start, len(k)])
    small = np.repeat(size, size) <= 16
    ks, xs, js = k[small], x[small], np.flatnonzero(small)
    for d in range(1, 16):  # all small runs at once: each row against the d-th after it
        if len(ks) <= d:
            break
        same = np.flatnonzero(ks[d:] == ks[:-d])
        same = same[_within(xs[same + d], xs[same], limits)]
        if len(same):
            us.append(js[same])
            vs.append(js[same + d])
    for a, s in zip(start[size > 16].tolist(), size[size > 16].tolist()):
        u, v = _near(x[a : a + s], limits, sure)
        if len(u):
            us.append(a + u)
            vs.append(a + v)
    return us, vs


def _keyed(fps: DataFrame, fp: str, seed: int, parts: list[tuple[list[int], int]], carried: list[str]) -> DataFrame:
    keys = []
    for p, (bits, t) in enumerate(parts):
        for c, gone in enumerate(combinations(bits, t)):
            kept = _signed(_mask(set(bits) - set(gone)))
            # The numbers of the fingerprint, part and masked bits go into the key, so keys of different ones never meet.
            keys.append(F.xxhash64(F.lit(seed), F.lit(p), F.lit(c), F.col(fp).bitwiseAND(F.lit(kept))))
    return fps.select(F.explode(F.array(*keys)).alias("k"), F.col(fp).alias("fp"), *carried)


def fingerprint_links(fps: DataFrame, distance: int, limits: tuple[int, ...], families: tuple[str, ...] = ("fp",), sure: int | None = None) -> DataFrame:
    """u, v: links between nodes (least, id) that lie within the limits: all that some fingerprint has within
    ``distance``, and those beyond that share a key anyway. With ``sure`` also whether a link's long fingerprints
    lie within that many bits.

    ``fps``: distinct rows of id, least, the fingerprints named by ``families`` and, under two limits, check
    (the long fingerprint).
    """
    carried = ["id", "least"] + ["check"] * (len(limits) - 1)
    rows = [c for c in ("k", "fp", *carried)]
    keyed = reduce(DataFrame.unionByName, [_keyed(fps, c, i, plan(fps.select(F.col(c).alias("fp")), distance), carried) for i, c in enumerate(families)])
    hot = written(keyed.groupBy("k").count().where(F.col("count") > BLOCK).select("k", F.ceil(F.col("count") / BLOCK).cast("int").alias("b")), "sim-hot")
    every = keyed
    if not hot.isEmpty():
        own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("b")).cast("int")
        dealt = keyed.join(hot, "k").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
        blocks = F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("k")
        every = keyed.join(hot, "k", "left_anti").unionByName(dealt.select(blocks, *rows[1:]))
    every = every.repartition("k").sortWithinPartitions("k").select(*rows)
    more = ["sure"] if sure is not None else []
    found = every.mapInArrow(tidy(_verify(limits, sure)), "u long, u_least long, v long, v_least long" + ", sure boolean" * len(more))
    return found.select(*[F.struct(F.col(f"{c}_least").alias("least"), F.col(c).alias("id")).alias(c) for c in "uv"], *more)


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, component_id from nodes of id, least (smallest key, or ``NO_KEY``) and fingerprints."""
    labels = components(links).select(F.col("node.id").alias("id"), F.col("label.least").alias("label"))
    found = F.coalesce("label", "least")
    return nodes.select("id", "least").join(labels, "id", "left").select("id", F.when(found < NO_KEY, found).alias("component_id"))


def _least(key: str = "doc_id"):
    return F.coalesce(F.min(key), F.lit(NO_KEY)).alias("least")


def simhash_components(docs: DataFrame, words: int, distance: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``."""
    ship(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    slim = written(source.mapInArrow(tidy(_fingerprints(words)), "doc_id long, fp long"), "sim-slim")
    nodes = written(slim.groupBy("fp").agg(_least()).select("fp", F.col("fp").alias("id"), "least"), "sim-distinct")
    ids = _labelled(nodes, fingerprint_links(nodes, distance, (distance,))).withColumnRenamed("id", "fp")
    return slim.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _near_rows(docs: DataFrame, words: int, similarity: float, distance: int, limit: int, key: str, text: str) -> DataFrame:
    """doc_id, h (hash of the text), component_id: one row per row of ``docs``."""
    ship(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("text"))
    families = tuple(f"fp{i}" for i in range(FAMILIES))
    slim = written(source.mapInArrow(tidy(_fingerprint_sets(words)), f"doc_id long, h long, {' long, '.join(families)} long, check binary, id long"), "near-slim")
    nodes = written(slim.groupBy("id").agg(_least(), *[F.first(c).alias(c) for c in (*families, "check")]), "near-distinct")
    found = fingerprint_links(nodes, distance, (limit, long_limit(similarity)), families, long_limit(similarity, -SURE))
    links = written(found.groupBy("u", "v").agg(F.max("sure").alias("sure")), "near-links")
    ids = _labelled(nodes, _exact(docs, slim, links, words, similarity, key, text))
    return slim.select("doc_id", "h", "id").join(ids, "id").select("doc_id", "h", "component_id")


def _exact(docs: DataFrame, slim: DataFrame, links: DataFrame, words: int, similarity: float, key: str, text: str) -> DataFrame:
    """u, v: the sure links, and where a component has others, those that its texts' shingles have."""
    if links.where("not sure").isEmpty():
        return links.select("u", "v")
    labels = written(components(links), "near-candidates")
    unsure = links.where("not sure").join(labels, F.col("u") == F.col("node")).select("label").distinct()
    open_ = written(labels.join(unsure, "label").select("node", F.xxhash64("label").alias("label")), "near-open")
    # One row of each text, which stands for all rows that have its fingerprints.
    row = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_KEY)), "doc_id", "h")).alias("row")
    members = slim.select("id", "doc_id", "h").join(open_.select(F.col("node.id").alias("id"), F.col("node.least").alias("least"), "label"), "id")
    members = written(members.groupBy("id", "least", "label").agg(row).select("id", "least", "label", "row.doc_id", "row.h"), "near-members")
    exact = exact_links(docs, members, lambda data: word_and_shingle_hashes(data, words)[1], similarity, key, text)
    settled = links.join(open_.select(F.col("node").alias("u")), "u", "left_anti").select("u", "v")
    return settled.unionByName(exact)


def near_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 7, limit: int = 18, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, component_id: documents whose distinct word shingles have ``similarity`` (Jaccard) or more.

    Candidates share a key of one of two independent 64-bit fingerprints of their distinct words, which
    move less than those of shingles when a word changes. All within ``distance`` bits do, and most within
    ``limit``, the furthest that is looked at. They also have 512-bit fingerprints of the distinct shingles
    within :func:`long_limit` bits. Where all links of a component lie ``SURE`` deviations inside the
    similarity, they stand; every other component is settled by :mod:`.jaccard` on whole shingle sets.
    """
    return _near_rows(docs, words, similarity, distance, limit, key, text).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row, that of the smallest key, of each component.

    Of rows of one key in one component that with the smallest hash of its text stays, of rows that repeat
    key and text one. Texts without words are one group.
    """
    found = written(_near_rows(docs, words, similarity, 7, 18, key, text), "near-found")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    same = written(found.where(first).groupBy("component_id").agg(F.count("*").alias("n"), F.min("h").alias("least")).where("n > 1"), "near-same")
    gone = found.where(~first).select("doc_id", "h")
    again = None
    if not same.isEmpty():  # several rows of the smallest key
        tied = found.where(first).join(same, found["component_id"].eqNullSafe(same["component_id"])).select("doc_id", "h", "least")
        gone = gone.unionByName(tied.where("h <> least").select("doc_id", "h"))
        again = tied.where("h = least").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")
    return without(docs, written(gone.distinct(), "near-gone"), again, key, F.xxhash64(text))
