"""Importance resampling towards a target text set, on hashed runs of words.

A document's features are its runs of one to ``longest`` words. Each feature falls into one of ``buckets`` buckets; a bucket's gain is
the log ratio of its smoothed shares in the target and in the documents. A document scores the mean gain of its features plus Gumbel
noise of its key, and the highest scores are a sample without replacement with odds by importance.

Nothing is exploded. Higher-order functions turn a text into the array of its buckets; a pass adds these up per task, so that no more
than ``buckets`` counts of each task are exchanged; a second pass sums ``element_at`` over the gains, which are one literal array.
Words, not texts, are lower-cased, and no bucket table is kept between the passes.

The sample's order is global without a task that holds it: scores at or above the last drawn one are dealt out by range of (score, key,
row number), and a row's rank is its place in its range plus the sizes of the ranges before. The histogram of scores (integers, at most
some 10^5 of them at any size) and one count per range are all that the driver sees.

Edge cases: null text has no words; documents without features weigh 0; a null key hashes as an empty one and comes last among ties;
rows that repeat key and text get ranks of their own, next to each other; an empty target leaves every gain to the documents alone; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.session import ship, written

#: What lies between words: all of ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(word: Column) -> Column:
    """A-Z in lower case. ``lower`` is the fast way where a word has no other letters that it would change."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def with_buckets(docs: DataFrame, text: str, buckets: int = 10_000, longest: int = 2) -> DataFrame:
    """Adds ``words`` (lower-cased) and ``found``: the bucket of every run of 1 to ``longest`` words, repeats included."""
    split = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), GAP), lambda w: w != "")
    out = docs.withColumn("words", F.transform(split, _lowered))
    bucket = lambda f: (F.crc32(F.encode(f, "UTF-8")) % buckets).cast("int")

    def runs(n: int) -> Column:
        starts = F.slice("words", F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: bucket(F.concat_ws(" ", w, *[F.get("words", i + k) for k in range(1, n)])))

    return out.withColumn("found", F.concat(F.transform("words", bucket), *[runs(n) for n in range(2, longest + 1)]))


def bucket_counts(found: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs in the arrays of the only column. Tasks add up their own; counts alone are exchanged."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit], pa.int64())], ["bucket", "n"])

    out = [0] * buckets
    for bucket, n in found.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(raw: list[int], target: list[int], scale: int = 1000) -> list[int]:
    """floor(scale * ln(smoothed share in the target / smoothed share in the documents)) of each bucket."""
    S, T, k = sum(raw), sum(target), len(raw)
    return [math.floor(scale * math.log(float((t + 1) * (S + k)) / float((s + 1) * (T + k)))) for s, t in zip(raw, target)]


def literal(values: list[int]) -> Column:
    """One array literal: a constant of the plan rather than an expression per entry."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def scored(docs: DataFrame, gains: list[int], text: str, key: str, longest: int = 2, seed: int = 7, scale: int = 1000) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    one = F.aggregate("found", F.lit(0).cast("long"), lambda a, b: a + F.element_at(literal(gains), b + 1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    out = with_buckets(slim, "text", len(gains), longest).select("doc_id", F.size("words").alias("n_words"), F.size("found").cast("long").alias("n_features"), one.alias("total"))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("total") / F.col("n_features"))).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).cast("long").alias("score"))


def ranked(rows: DataFrame, share: tuple[int, int], eligible: Column) -> DataFrame:
    """Adds ``rank`` (1, 2, ... by falling score, then key; else null) to the drawn ones of a written table of doc_id, score, at."""
    rows = rows.withColumn("fits", F.coalesce(eligible, F.lit(False)))
    held = sorted(map(tuple, rows.where("fits").groupBy("score").agg(F.count("*")).collect()), reverse=True)
    wanted = sum(n for _, n in held) * share[0] // share[1]
    reached = list(accumulate(n for _, n in held))
    if not wanted:
        return rows.withColumn("rank", F.lit(None).cast("long")).drop("fits", "at")
    cut = next(score for (score, _), upto in zip(held, reached) if upto >= wanted)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("at")]
    top = rows.where(F.col("fits") & (F.col("score") >= cut)).repartitionByRange(*order).sortWithinPartitions(*order)
    top = written(top.withColumns({"range": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "resample-order")
    sizes = dict(map(tuple, top.groupBy("range").agg(F.count("*")).collect()))
    before = list(accumulate((sizes.get(r, 0) for r in range(max(sizes))), initial=0))
    place = F.element_at(literal(before), F.col("range") + 1) + F.col("place") + 1
    rank = F.when(place <= wanted, place)
    rest = rows.where(~F.col("fits") | (F.col("score") < cut)).withColumn("rank", F.lit(None).cast("long"))
    return top.withColumn("rank", rank).drop("range", "place", "fits", "at").unionByName(rest.drop("fits", "at"))


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (25, 100), least_words: int = 20, buckets: int = 10_000, longest: int = 2,
    seed: int = 7, key: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of ``docs``; the ``share`` of those with ``least_words`` is drawn."""
    ship(docs.sparkSession)
    raw, aim = (bucket_counts(with_buckets(d.select(F.col(c).alias("text")), "text", buckets, longest).select("found"), buckets) for d, c in ((docs, text), (target, target_text)))
    rows = scored(docs, bucket_gains(raw, aim), text, key, longest, seed).withColumn("at", F.monotonically_increasing_id())
    out = ranked(written(rows, "resample-scores"), share, F.col("n_words") >= least_words)
    return out.select("doc_id", "n_features", "weight", "score", "rank")
