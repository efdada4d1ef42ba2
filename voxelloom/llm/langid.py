"""Language identification by nearest centroid.

Features are byte n-grams of one to three bytes of the whole text (A-Z lower-cased, all other ASCII but
letters folded to one blank), hashed into ``DIM`` slots, as normalised TF-IDF with logarithmic counts.
Each language has several centroids, found by spherical k-means over its training rows. A text goes to
the language of the centroid with the largest cosine; the score is that cosine. Rejection is by
distance: a text is rejected if its cosine lies below ``REJECT_SHARE`` of what all but ``REJECT_TAIL`` of
its language's training texts of its length class reach. Beginnings of longer training rows stand for the
shorter classes; a class of fewer than ``MIN_CLASS`` texts takes those of the nearest classes, shorter ones
first. Clusters of hardly any training rows are junk and give no centroid.

The classifier is fitted on at most ``MAX_PER_LANG`` labelled rows per language, those with the
smallest hash of the key and text (found from counts by power of two of the hash, so that no language is
ranked in one task), and needs labels and texts alone. Everything else reads every row in full.
Executors turn the sample into vectors and fit each language; the driver holds the finished model alone,
``CENTROIDS`` vectors a language.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and rejected; the empty
label is a label; without any labelled row every text is ``und``; ties go to the label that sorts
first; an empty table gives an empty result; other columns are not read; long texts are counted in
slices that carry their ends over, which gives the counts of the whole text.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm.memory import tidy
from voxelloom.session import ship, written

DIM = 1 << 13
#: Labelled rows per language that the classifier is fitted on.
MAX_PER_LANG = 400
CENTROIDS = 4
REJECT_SHARE = 0.5
REJECT_TAIL = 0.05
MIN_CLASS = 20
#: A centroid stands for at least this share of its language's training rows, and for two.
LEAST_SHARE = 0.02
SLICE = 1 << 18
#: Upper ends of the length classes, in bytes, of the rejection thresholds.
LENGTHS = (32, 128, 512, 2048, 8192)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def counts(data: bytes) -> np.ndarray:
    """Counts of hashed byte n-grams (1 to 3) over the whole text, with a blank before and after it."""
    total, raw = np.zeros(DIM, np.int64), np.frombuffer(data, np.uint8)
    total[32 * 31 % DIM] += 1  # the blank before
    before = np.array([32], np.uint32)  # the last two bytes counted
    for i in range(0, len(raw) + 1, SLICE):
        x = _FOLD[raw[i : i + SLICE]].astype(np.uint32)
        x = np.r_[x, np.uint32(32)] if i + SLICE > len(raw) else x
        x = x[(x | np.r_[before[-1:], x[:-1]]) != 32]  # one blank for several
        total += np.bincount(x * np.uint32(31) % DIM, minlength=DIM)
        x, old = np.r_[before, x], len(before)
        two = (x[:-1] << 8 | x[1:])[old - 1 :]
        total += np.bincount(((two * np.uint32(2654435761)) >> 16) % DIM, minlength=DIM)
        three = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        total += np.bincount(((three * np.uint32(2246822519)) >> 17) % DIM, minlength=DIM)
        before = x[-2:]
    return total


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray  # DIM
    centroids: np.ndarray  # centroids x DIM, unit rows
    of: np.ndarray  # language of each centroid
    floor: np.ndarray  # languages x length classes: cosines below are rejected

    def judge(self, data: bytes) -> tuple[int, float, bool]:
        v = np.log1p(counts(data)).astype(np.float32) * self.idf
        norm = float(np.sqrt(v @ v))
        if not norm:
            return -1, 0.0, True
        cos = self.centroids @ v / norm
        best = int(np.argmax(cos))
        score, lang = min(1.0, max(0.0, float(cos[best]))), int(self.of[best])
        return lang, score, score < self.floor[lang, np.searchsorted(LENGTHS, len(data))]


def _vectors(batches):
    """Counts of each row and of its beginnings, one per length class below its own, as slots and values."""
    for batch in batches:
        out = []
        for lang, h, text in zip(*batch.columns):
            data = bytes(text.as_buffer())
            starts = [data[: 3 * end // 4].decode("utf-8", "ignore").encode() for end in LENGTHS[: np.searchsorted(LENGTHS, len(data))]]
            for d in (data, *starts):
                c = counts(d)
                at = np.flatnonzero(c)
                out.append((lang.as_py(), h.as_py(), at.astype(np.uint16).tobytes(), c[at].astype(np.float32).tobytes(), len(d), d is data))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*out)) or [()] * 6, (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()))], ["lang", "h", "at", "v", "n", "whole"])


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; deterministic."""
    seeds = [x.sum(0)]
    seeds[0] = seeds[0] / max(np.linalg.norm(seeds[0]), 1e-12)
    while len(seeds) < min(k, len(x)):
        seeds.append(x[int(np.argmin(np.max(np.stack(seeds) @ x.T, axis=0)))])
    c = np.stack(seeds)
    for _ in range(rounds):
        near = np.argmax(c @ x.T, axis=0)
        new = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k-means without the rows of clusters that are too small to be a kind of text."""
    least = max(2, LEAST_SHARE * len(x))
    while True:
        c = _kmeans(x, k)
        near = np.argmax(c @ x.T, axis=0)
        size = np.bincount(near, minlength=len(c))
        kept = size[near] >= least
        if kept.all() or not kept.any():
            return c[size > 0]  # equal rows leave clusters empty
        x = x[kept]


def _floors(cos: list[np.ndarray]) -> list[float]:
    """Lowest accepted cosine of each length class."""
    out = []
    for k in range(len(cos)):
        order = sorted(range(len(cos)), key=lambda o: (abs(o - k), o))
        some = np.zeros(0)
        for o in order:
            if len(some) >= MIN_CLASS:
                break
            some = np.concatenate([some, cos[o]])
        out.append(REJECT_SHARE * float(np.quantile(some, REJECT_TAIL)))
    return out


def _seen(batches):
    """In how many rows each slot is, over a partition; at -1 the number of rows."""
    seen, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for at in batch.column(0).to_pylist():
            seen[np.frombuffer(at, np.uint16)] += 1
            n += 1
    slots = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, slots].astype(np.int32)), pa.array(np.r_[n, seen[slots]])], ["slot", "n"])


def _fit_one(sent, centroids: int, per_lang: int):
    """One language's centroids and lowest accepted cosines, from at most ``per_lang`` rows and their beginnings."""

    def run(rows: pa.Table) -> pa.Table:
        idf = sent.value
        hashes = np.sort(rows["h"].to_numpy()[rows["whole"].to_numpy()])
        rows = rows.filter(pc.less_equal(rows["h"], int(hashes[: per_lang][-1])))
        rows = rows.sort_by([("n", "ascending"), ("at", "ascending"), ("v", "ascending")])
        slots, values = ([np.frombuffer(b, t) for b in rows[c].to_pylist()] for c, t in (("at", np.uint16), ("v", np.float32)))
        whole, kind = rows["whole"].to_numpy(), np.searchsorted(LENGTHS, rows["n"].to_numpy())

        def vectors(some: np.ndarray) -> np.ndarray:
            x = np.zeros((len(some), DIM), np.float32)
            for v, i in zip(x, some):
                v[slots[i]] = np.log1p(values[i])
            x *= idf
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            return x

        c = _centroids(vectors(np.flatnonzero(whole)), centroids).astype(np.float32)
        floor = _floors([(vectors(np.flatnonzero(kind == k)) @ c.T).max(1) for k in range(len(LENGTHS) + 1)])
        return pa.table({"lang": rows["lang"].slice(0, 1).cast(pa.string()), "c": pa.array([c.tobytes()], pa.binary()), "floor": pa.array([floor], pa.list_(pa.float64()))})

    return run


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = MAX_PER_LANG, centroids: int = CENTROIDS) -> Model | None:
    """Fits on at most ``per_lang`` rows a language of ``labelled``; None without rows."""
    spark = labelled.sparkSession
    ship(spark)
    h = F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text)), 1)
    rows = labelled.select(F.col(lang).alias("lang"), h.alias("h"), F.floor(F.log2(h + 1.0)).cast("int").alias("power"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Each power of two holds about as many rows as all below it, so the first ones that hold ``per_lang`` rows
    # hold few more. One bound per language, of which the model has to hold centroids anyway, then picks the
    # texts in a filter, without an exchange.
    held = rows.groupBy("lang", "power").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("power").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = {r["lang"]: r["cut"] for r in held.withColumn("below", below).where(F.col("below") < per_lang).groupBy("lang").agg(F.max("power").alias("cut")).collect()}
    if not cuts:
        return None
    bound = F.from_json(F.lit(json.dumps(cuts)), "map<string,int>")
    some = rows.where(F.col("power") <= F.try_element_at(bound, F.col("lang"))).select("lang", "h", "text")
    sample = written(some.mapInArrow(tidy(_vectors), "lang string, h long, at binary, v binary, n long, whole boolean"), "lang-sample")
    seen = dict(map(tuple, sample.where("whole").select("at").mapInArrow(_seen, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect()))  # DIM slots
    n = seen.pop(-1, 0)
    idf = np.full(DIM, np.log(1 + n) + 1, np.float32)
    idf[list(seen)] = np.log((1 + n) / (1 + np.array(list(seen.values())))) + 1
    sent = spark.sparkContext.broadcast(idf)
    found = sample.groupBy("lang").applyInArrow(_fit_one(sent, centroids, per_lang), "lang string, c binary, floor array<double>").toArrow().sort_by("lang")
    cs = [np.frombuffer(b, np.float32).reshape(-1, DIM) for b in found["c"].to_pylist()]
    return Model(found["lang"].to_pylist(), idf, np.concatenate(cs), np.repeat(np.arange(len(cs)), [len(c) for c in cs]), np.array(found["floor"].to_pylist()))


def _predict(sent):
    def run(batches):
        model: Model | None = sent.value
        for batch in batches:
            keys, texts = batch.columns
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
            lang, score, rejected = [], [], []
            for t, ok in zip(texts, letters):
                j, s, r = model.judge(bytes(t.as_buffer())) if ok and model else (-1, 0.0, True)
                lang.append(model.langs[j] if j >= 0 else "und")
                score.append(s)
                rejected.append(bool(r))
            yield pa.RecordBatch.from_arrays([keys, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # languages x CENTROIDS x DIM floats
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(tidy(_predict(sent)), "doc_id long, lang_pred string, score double, rejected boolean")


def _accepting(sent, at: int):
    def run(batches):
        model: Model | None = sent.value
        for batch in batches:
            texts = batch.column(at)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
            keep = [bool(model and ok and not model.judge(bytes(t.as_buffer()))[2]) for t, ok in zip(texts, letters)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text some language accepts. No shuffle."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    return docs.mapInArrow(tidy(_accepting(sent, docs.columns.index(text))), docs.schema)


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0
