"""Exact deduplication with counting quotient filters.

1. One pass over the texts makes a slim table: document key, 64-bit fingerprint, SHA-256.
2. Every partition of the slim table builds counting quotient filters over its fingerprints. A filter
   stores sorted remainders per quotient plus a count, so filters of the same quotient range merge by
   merging sorted remainders, without loss; a hot text is one entry per filter however often it occurs.
3. Fingerprints whose merged count exceeds one are routed to byte verification: only texts with such
   a fingerprint (told by a bitmap of fixed size over fingerprint prefixes; false alarms cost work,
   never correctness) are grouped by their whole normalised bytes.

Edge cases: null text counts as empty text; empty texts equal each other; rows that repeat both key
and text share one decision (the group counts each of them); a null key is smaller than any other;
an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from typing import Iterator  # noqa: UP035  the hint that Spark looks for

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.memory import tidy
from voxelloom.session import ship, written

#: Fingerprints that one filter gathers before it is handed on.
FLUSH = 1 << 20
#: Fingerprints expected in one quotient range.
RANGE_SIZE = 1 << 16
#: Largest routing bitmap, as a power of two bits (16 MB).
MAX_ROUTE_BITS = 27


class CountingQuotientFilter:
    """Fingerprints of 64 bits split into quotient and remainder, each with a count.

    ``occupied`` has a bit per quotient slot, ``run_ends`` a bit per entry that is the last of its
    quotient's run; entries lie in order of quotient and then remainder. The split is lossless, so
    the filter holds no false positives and can be enumerated.
    """

    def __init__(self, quotient_bits: int, values: np.ndarray, counts: np.ndarray):
        self.q, self.values, self.counts = quotient_bits, values, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, quotient_bits: int) -> CountingQuotientFilter:
        values, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls(quotient_bits, values, counts.astype(np.int64))

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        """Sorted runs are merged; counts of equal remainders under one quotient add up."""
        values = np.concatenate([self.values, *(o.values for o in others)])
        counts = np.concatenate([self.counts, *(o.counts for o in others)])
        order = np.argsort(values, kind="stable")  # merges presorted runs
        values, counts = values[order], counts[order]
        if not len(values):
            return self
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        return CountingQuotientFilter(self.q, values[first], np.add.reduceat(counts, first))

    def to_bytes(self, low: int = 0, high: int | None = None) -> bytes:
        """Slots ``low`` to ``high`` (exclusive), as metadata bits, remainders and counts."""
        high = 1 << self.q if high is None else high
        r = np.uint64(64 - self.q)
        quotient = (self.values >> r).astype(np.int64)
        a, b = np.searchsorted(quotient, [low, high])
        quotient, values, counts = quotient[a:b], self.values[a:b], self.counts[a:b]
        occupied = np.zeros(high - low, bool)
        occupied[quotient - low] = True
        ends = np.r_[quotient[1:] != quotient[:-1], True] if len(quotient) else np.zeros(0, bool)
        many = np.flatnonzero(counts > 1)  # a count of one costs no slot
        head = np.array([self.q, low, high, len(values), len(many)], np.int64)
        remainders = values & ((np.uint64(1) << r) - np.uint64(1))
        return b"".join(x.tobytes() for x in (head, np.packbits(occupied), np.packbits(ends), remainders, many, counts[many]))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, low, high, n, m = (int(x) for x in np.frombuffer(data, np.int64, 5))
        at = 40
        take = lambda size, dtype, count: np.frombuffer(data, dtype, count, size)
        a, b = (high - low + 7) // 8, (n + 7) // 8
        occupied = np.unpackbits(take(at, np.uint8, a))[: high - low]
        ends = np.unpackbits(take(at + a, np.uint8, b))[:n]
        at += a + b
        remainders, at = take(at, np.uint64, n), at + 8 * n
        many, at = take(at, np.int64, m), at + 8 * m
        counts = np.ones(n, np.int64)
        counts[many] = take(at, np.int64, m)
        run = np.cumsum(np.r_[0, ends[:-1]]) if n else np.zeros(0, np.int64)
        quotient = (np.flatnonzero(occupied) + low)[run].astype(np.uint64) if n else np.zeros(0, np.uint64)
        return cls(q, (quotient << np.uint64(64 - q)) | remainders, counts)


def _normal(scalar) -> bytes:
    """Lower-cases A-Z alone: bytes.lower() leaves every other byte of UTF-8 as it is."""
    data = scalar.as_buffer() if scalar.is_valid else None
    return bytes(data).lower() if data is not None else b""


def _digest(batches):
    for batch in batches:
        keys, texts = batch.columns
        sha, fp = [], []
        for t in texts:
            b = _normal(t)
            sha.append(hashlib.sha256(b).hexdigest())
            fp.append(xxhash.xxh3_64_intdigest(b))
        yield pa.RecordBatch.from_arrays([keys, pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sha, pa.string())], ["doc_id", "fp", "text_sha256"])


def _filters(range_bits: int, quotient_bits: int):
    per = 1 << (quotient_bits - range_bits)

    def build(batches):
        def flush(parts):
            cqf = CountingQuotientFilter.of(np.concatenate(parts), quotient_bits)
            present = np.unique(cqf.values >> np.uint64(64 - range_bits)).astype(np.int64)
            for i in range(0, len(present), 512):
                some = present[i : i + 512].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([cqf.to_bytes(k * per, (k + 1) * per) for k in some], pa.binary())], ["slot_range", "filter"])

        parts, n = [], 0
        for batch in batches:
            parts.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(parts[-1])
            if n >= FLUSH:
                yield from flush(parts)
                parts, n = [], 0
        if n:
            yield from flush(parts)

    return build


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters of one range at a time, merged as they come; gives the fingerprints counted more than once."""
    whole = None
    for batch in batches:
        found = [CountingQuotientFilter.from_bytes(x.as_py()) for x in batch.column("filter")]
        whole = found[0].merge(*found[1:]) if whole is None else whole.merge(*found)
    if whole is None:
        return
    again = whole.counts > 1
    yield pa.RecordBatch.from_arrays([pa.array(whole.values[again].view(np.int64)), pa.array(whole.counts[again])], ["fp", "n"])


def repeated_fingerprints(slim: DataFrame, rows: int) -> DataFrame:
    """fp, n: fingerprints that more than one row of ``slim`` has, by merged quotient filters."""
    range_bits = min(24, max(4, int(np.ceil(np.log2(max(rows, 1) / RANGE_SIZE + 1)))))
    quotient_bits = range_bits + 12
    filters = slim.select("fp").mapInArrow(_filters(range_bits, quotient_bits), "slot_range long, filter binary")
    return filters.groupBy("slot_range").applyInArrow(_merged, "fp long, n long")


def _router(bitmap, bits: int):
    def route(batches):
        words = bitmap.value
        for batch in batches:
            keys, texts = batch.columns
            at, fps, norms = [], [], []
            for i, t in enumerate(texts):
                b = _normal(t)
                fp = xxhash.xxh3_64_intdigest(b)
                slot = fp >> (64 - bits)
                if words[slot >> 3] >> (slot & 7) & 1:
                    at.append(i)
                    fps.append(fp)
                    norms.append(b)
            if at:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(norms, pa.binary())], ["doc_id", "fp", "norm"])

    return route


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    slim = written(source.mapInArrow(tidy(_digest), "doc_id long, fp long, text_sha256 string"), "exact-slim")
    rows = slim.count()
    repeated = written(repeated_fingerprints(slim, rows), "exact-repeated")
    bits = min(MAX_ROUTE_BITS, max(16, int(np.ceil(np.log2(repeated.count() + 1))) + 4))
    # A bitmap of at most 2**MAX_ROUTE_BITS bits, whatever the input.
    words = repeated.select(F.shiftrightunsigned("fp", 64 - bits).alias("slot")).groupBy((F.col("slot") / 8).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(1, cast(slot % 8 as int)))").alias("b")).toArrow()
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    bitmap[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint8)
    sent = spark.sparkContext.broadcast(bitmap)
    routed = source.mapInArrow(tidy(_router(sent, bits)), "doc_id long, fp long, norm binary")
    groups = routed.groupBy("fp", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = written(groups.select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "exact-groups")
    out = slim.join(groups, ["fp", "text_sha256"], "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def without(docs: DataFrame, gone: DataFrame, again: DataFrame | None, key: str, digest: Column) -> DataFrame:
    """``docs`` without the rows whose key and digest are in ``gone``, and with one row of each in ``again``.

    Both hold doc_id and h (the digest), distinct; ``again`` names rows that are there several times.
    """
    names = docs.columns
    own = docs.select(F.struct(*names).alias("_row"), F.col(key).cast("long").alias("_key"), digest.alias("_h"))
    same = lambda t: own["_key"].eqNullSafe(t["doc_id"]) & (own["_h"] == t["h"])
    kept = own.join(gone, same(gone), "left_anti")
    if again is not None:
        again = written(again, "again")
        if not again.isEmpty():
            one = own.join(again, same(again), "left_semi").dropDuplicates(["_key", "_h"])
            kept = kept.join(again, same(again), "left_anti").unionByName(one)
    return kept.select("_row.*")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` does not keep; of rows that repeat key and text one stays."""
    short = lambda sha: F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")  # noqa: E731  rows of one key are told apart by 60 bits
    found = written(exact_groups(docs, key, text).where("group_size > 1").select("doc_id", short("text_sha256").alias("h"), "kept"), "exact-found")
    gone = written(found.where(~F.col("kept")).select("doc_id", "h").distinct(), "exact-gone")
    again = found.where("kept").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return without(docs, gone, again, key, short(F.sha2(lower, 256)))
