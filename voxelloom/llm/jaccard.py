"""Exact Jaccard links inside components of candidates.

Fingerprints tell which texts may be near copies; whether two of them are is decided here on their whole sets of shingles. Only texts
of the given components come here: a bitmap of fixed size over (key, text hash) picks their rows, so that no other text leaves its task.

A component is dealt out in blocks of at most about ``BYTES`` of shingles and ``MEMBERS`` texts, and every pair of blocks is a group:
shingles that several members have become columns, and a product of the matrix with itself counts what each pair shares. A group gives a
spanning forest of its links, so that a component of many near copies gives as many rows as it has members a block, not their square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.memory import tidy
from voxelloom.session import written

#: Bytes of shingles, and texts, of a block.
BYTES, MEMBERS = 8 << 20, 1024
#: Columns that are multiplied at once.
COLUMNS = 2048
#: Largest bitmap, as a power of two bits (16 MB).
MOST_BITS = 27


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of sets shares."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(times > 1) - 1  # elements of one set alone are shared with none
    keep = times[column] > 1
    owner, column = owner[keep], common[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[owner[i:j], column[i:j] - a] = 1
        out += part @ part.T
    return out


def forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of a symmetric matrix of links."""
    us, vs, left = [], [], np.arange(len(linked))
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            p = stack.pop()
            hit = linked[p, left]
            found, left = left[hit].tolist(), left[~hit]
            us += [p] * len(found)
            vs += found
            stack += found
    return us, vs


def group_links(table: pa.Table, similarity: float) -> pa.Table:
    sets = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("shingles")]
    size = np.array([len(s) for s in sets], np.float64)
    both = shared_counts(sets).astype(np.float64)
    u, v = forest(both >= similarity * (size[:, None] + size[None] - both) - 1e-9)
    cols = [table.column(c).combine_chunks() for c in ("id", "least")]
    return pa.table({f"{e}_{c}": col.take(pa.array(at, pa.int64())) for e, at in (("u", u), ("v", v)) for c, col in zip(("id", "least"), cols)})


def _bitmap(rows: DataFrame, slot: Column, n: int):
    """Bitmap over the leading bits of ``slot``, a hash: at most 2**MOST_BITS bits whatever the input."""
    bits = min(MOST_BITS, max(16, int(n).bit_length() + 4))
    at = rows.select(F.shiftrightunsigned(slot, 64 - bits).alias("at")).groupBy(F.shiftright("at", 3).alias("w"))
    words = at.agg(F.expr("bit_or(shiftleft(1, cast(at % 8 as int)))").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    out[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out), bits


def exact_links(docs: DataFrame, members: DataFrame, shingled, similarity: float, key: str, text: str) -> DataFrame:
    """u, v (structs of least, id): links of ``similarity`` or more among the members of each label.

    ``members``: a written table of id, least, label, doc_id and h, one row per text; doc_id and h (the text's hash) name a row of ``docs`` that has
    the text. ``shingled`` gives a text's distinct shingles as sorted 64-bit numbers.
    """
    slot = F.xxhash64("doc_id", "h")
    sent, bits = _bitmap(members, slot, members.count())

    def shingles(batches):
        seen = set()
        for batch in batches:
            keys, hashes, slots, texts = batch.columns
            at = slots.to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            hit = np.flatnonzero(sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).tolist()
            fresh, sets = [], []
            for i in hit:
                name = (keys[i].as_py(), hashes[i].as_py())
                if name not in seen:  # repeated rows of a task make one
                    seen.add(name)
                    fresh.append(i)
                    t = texts[i]
                    sets.append(shingled(bytes(t.as_buffer()) if t.is_valid else b"").tobytes())
            take = pa.array(fresh, pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(take), hashes.take(take), pa.array(sets, pa.binary())], ["doc_id", "h", "shingles"])

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("text"))
    found = source.select("doc_id", "h", slot.alias("slot"), "text").mapInArrow(tidy(shingles), "doc_id long, h long, shingles binary")
    same = members["doc_id"].eqNullSafe(found["doc_id"]) & (members["h"] == found["h"])
    rows = members.join(found, same).select("label", "id", "least", "shingles")
    # Rows of several tasks that repeat key and text make one.
    rows = written(rows.groupBy("label", "id", "least").agg(F.first("shingles").alias("shingles")), "near-shingles")
    size = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("bytes") / BYTES)).cast("int")
    dealt = rows.join(size.select("label", blocks.alias("b")), "label")
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("b")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    group = F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("k")
    links = dealt.select(group, "id", "least", "shingles").groupBy("k").applyInArrow(lambda t: group_links(t, similarity), "u_id long, u_least long, v_id long, v_least long")
    return links.select(*[F.struct(F.col(f"{c}_least").alias("least"), F.col(f"{c}_id").alias("id")).alias(c) for c in "uv"])
