"""op11 to op13: against SQL, brute force and the tokenizer itself."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelloom.llm import centroids, packing, registry, resample, sql

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, words string, score long, at string"
EDGES = [
    (1, "Ab ab AB, xy-z 9", "q", 1, "a"), (1, "Ab ab AB, xy-z 9", "q", 1, "a"), (2, None, None, None, None), (3, "", "", 0, ""), (None, "é É Straße " * 12, "x", 1, "b"),
    (None, "é É Straße " * 12, "x", 1, "b"), (4, "long Words " * 20000, "x", 2, "c"), (5, "one", None, 1, None), (6, "x\0y " * 30, "x", 1, ""), (7, "z" * 30000, "", 1, ""),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS).persist()


def against_sql(got, query, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, pa.Table.from_pandas(df) if not isinstance(df, pa.Table) else df)
    want = c.execute(query).fetchall()
    names = [d[0] for d in c.description]
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=key) == sorted(map(tuple, want), key=key)


# 11: resampling


def test_resample_edges(spark, edges):
    aim = spark.createDataFrame([("Straße é ab",), (None,), ("",), ("long words long",)], "text string")
    against_sql(resample.resample(edges, aim), sql.OP11, documents=edges.toArrow(), benchmark=aim.toArrow())
    against_sql(resample.resample(edges.limit(0), aim), sql.OP11, documents=edges.limit(0).toArrow(), benchmark=aim.toArrow())
    nothing = resample.resample(edges, aim.limit(0)).collect()
    assert len(nothing) == len(EDGES) and sorted(r.rank for r in nothing if r.rank) == [1]  # of five with 20 words


def test_resample_by_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"W{i}" for i in range(60)] + ["ü", "Ñandú"]
    data = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(300)]
    aim = [" ".join(rng.choice(vocabulary[:9], 15)) for _ in range(30)]

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text))
        return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for text in (d[1] for d in data):
        np.add.at(s, [bucket(f) for f in features(text)[1]], 1)
    for text in aim:
        np.add.at(t, [bucket(f) for f in features(text)[1]], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    want = {}
    for i, text in data:
        w, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        want[i] = (len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20)
    order = sorted((i for i in want if want[i][3]), key=lambda i: (-want[i][2], i))
    rank = {i: k for k, i in enumerate(order[: 25 * len(order) // 100], 1)}
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = resample.resample(df.repartition(7), spark.createDataFrame([(a,) for a in aim], "text string"))
    assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in got.collect()} == {i: (*v[:3], rank.get(i)) for i, v in want.items()}


def test_scoring_has_no_explode_and_texts_stay(spark, edges):
    df = resample.scored(edges, [0] * 10000, "text", "doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_ranges_are_numbered_through(spark):
    rows = spark.range(5000).select((F.col("id") % 40).alias("doc_id"), (F.col("id") % 7).alias("score"), F.monotonically_increasing_id().alias("at"))
    got = [(r.score, r.doc_id, r.rank) for r in resample.ranked(rows, (1, 3), F.lit(True)).collect()]
    drawn = sorted((x for x in got if x[2]), key=lambda x: x[2])
    assert [x[2] for x in drawn] == list(range(1, 5000 // 3 + 1)) and len(got) == 5000
    assert [x[:2] for x in drawn] == sorted((x[:2] for x in got), key=lambda x: (-x[0], x[1]))[: 5000 // 3]


# 12: packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_are_those_of_the_library():
    own, library, rng = packing.Tokens(PATH), Tokenizer.from_file(PATH), random.Random(5)
    assert own.fast is not None
    alphabet = "aZ09'sSt ll\n\t\r  .,!?é中 　​٣😀<|>_-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["x <|endoftext|> y", "", "".join(chr(c) + "b 1" for c in range(1, 0x3000, 3)), "word " * 200_000, "a" * 600_000, " " * 600_000 + "b", "tail  " * 100_000]
    for t in texts:
        assert own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_best_fit_and_bounds_by_brute_force():
    rng = np.random.default_rng(8)

    def fewest(sizes, capacity):
        best = [len(sizes)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(rooms)
                return
            for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
                place(i + 1, [r - sizes[i] * (j == k) for j, r in enumerate(rooms)])
            place(i + 1, [*rooms, capacity - sizes[i]])

        place(0, [])
        return best[0]

    met = 0
    for _ in range(150):
        capacity = int(rng.integers(6, 30))
        sizes = sorted(rng.integers(1, capacity + 1, rng.integers(1, 9)).tolist(), reverse=True)
        least, bound = fewest(sizes, capacity), packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        bins, offsets, filled = packing.best_fit_decreasing(np.array(sizes), capacity)
        assert bound <= least <= len(filled) and max(filled) <= capacity
        met += bound == least
        for b in range(len(filled)):  # gapless
            mine = sorted((o, s) for o, s, k in zip(offsets.tolist(), sizes, bins.tolist()) if k == b)
            assert [o for o, _ in mine] == [sum(s for _, s in mine[:i]) for i in range(len(mine))]
    assert met > 120
    assert packing.lower_bound(np.bincount([6] * 5, minlength=11), 10) == 5  # sizes alone say 3
    assert packing.lower_bound(np.bincount([34] * 6, minlength=101), 100) == 3


def checked(got, capacity):
    """Every sequence is gapless and within capacity."""
    rows = got.collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in by.values():
        seq.sort()
        assert [o for o, _ in seq] == [sum(n for _, n in seq[:i]) for i in range(len(seq))] and sum(n for _, n in seq) <= capacity
    assert rows == [] or {(r.bins, r.bound) for r in rows} == {(len(by), rows[0].bound)}
    return rows, len(by)


def test_pack_edges(spark, edges):
    library = Tokenizer.from_file(PATH)
    docs = [(r[0], r[1]) for r in EDGES]
    rows, _ = checked(packing.pack(edges, PATH, 64), 64)
    got = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for k, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first, piece, at = len(ids) % 64 or 64, 0, 0
        while at < len(ids):
            n = first if piece == 0 else 64
            want.append((str(k), piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            piece, at = piece + 1, at + n
    assert got == sorted(want)
    assert packing.pack(edges.limit(0), PATH, 64).count() == 0


@pytest.mark.parametrize("low, high", [(1, 40), (20, 52), (30, 36)])
def test_partitions_exchange_until_nothing_is_freed(spark, monkeypatch, low, high):
    """Many small partitions come to as few sequences as their bound, or as one partition of everything."""
    rng = np.random.default_rng(low)
    docs = [(i, "a " * int(rng.integers(low, high))) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lengths = np.array([r.length for r in packing.pack(df, PATH, 100).collect()])
    alone = len(packing.best_fit_decreasing(lengths, 100)[2])
    monkeypatch.setattr(packing, "GROUP", 100)
    rows, bins = checked(packing.pack(df, PATH, 100), 100)
    assert len(rows) == 1500 and rows[0].bound <= bins <= max(alone + 2, int(1.005 * alone))


# 13: clustering


def plain(x, k, rounds, start):
    c = [list(map(int, x[i])) for i in start]
    for turn in range(rounds + 1):
        d = [[sum((int(a) - b) ** 2 for a, b in zip(v, m)) for m in c] for v in x]
        a = [min(range(len(c)), key=lambda j: (row[j], j)) for row in d]
        if turn == rounds:
            return a, [row[j] for row, j in zip(d, a)], c
        for j in range(len(c)):
            mine = [v for v, own in zip(x, a) if own == j]
            if mine:
                c[j] = [sum(int(v[i]) for v in mine) // len(mine) for i in range(len(c[j]))]


@pytest.mark.parametrize("k, groups", [(8, None), (12, 4), (5, 1)])
def test_bounds_change_nothing(spark, k, groups):
    rng = np.random.default_rng(k)
    means = rng.normal(0, 3, (6, 4))
    x = np.round(means[rng.integers(0, 6, 400)] + rng.normal(0, 0.6, (400, 4)), 1)  # rounded: many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    ints = np.floor(x.astype(np.float32).astype(float) * 16).astype(int)
    start = sorted(range(400), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:k]
    a, d, c = plain(ints, k, 10, start)
    found = centroids.cluster(df, k=k, dims=4, scale=16, groups=groups)
    got = sorted(map(tuple, found.rows.collect()))
    assert got == [(i, a[i], d[i]) for i in range(400)] and found.centroids.tolist() == c
    assert found.inertia == [sum(n for n, own in zip(d, a) if own == j) for j in range(k)]
    assert found.scans[0] == 400 * k and sum(found.scans) < (0.7 if k > 5 else 0.9) * 11 * 400 * k


def test_cluster_edges(spark):
    bad = [(1, None), (2, [1.0, 2.0]), (3, [1.0, None, 2.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 0.0, 0.0]), (6, [])]
    good = [(7, [0.5, -0.5, 0.001]), (7, [0.5, -0.5, 0.001]), (None, [9.0, 9.0, 9.0]), (8, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(bad + good, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("x", F.lit(1))
    got = centroids.clustered(df, dims=3)
    assert sorted(str(r.vec_id) for r in got.collect()) == ["7", "7", "8", "None"]
    for found in (got, centroids.clustered(df, dims=3, k=2, scale=10)):
        assert {r.inertia for r in found.collect()} == {0} or found is not got
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    empty = centroids.clustered(df.limit(0), dims=3)
    assert empty.columns == names and empty.count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(spark.createDataFrame([(1, [1e30, 0.0, 0.0])], "vec_id long, embedding array<float>"), dims=3).collect()


@pytest.mark.parametrize("name", ["op11_resample", "op13_centroids"])
def test_against_sql(spark, name):
    tables = {t: f"{SF}/{t}.parquet" for t in ("documents", "benchmark", "embeddings")}
    c = duckdb.connect()
    for t, path in tables.items():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    want = c.execute(sql.ORACLES[name])
    names = [d[0] for d in want.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))
