"""Running values over ordered events of sessions of any size.

Events are dealt out by range of (session, order): a range is a block, and a session that holds most events covers many. Values run
within (session, block); each block's totals, one row per session and block, run on their own and are carried into the blocks after.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voxelloom.session import written


def ranged(events: DataFrame, by: str, order: list[str], name: str = "ranged") -> DataFrame:
    """``events`` with ``block``, the number of its range, written once so that it stays as it is."""
    return written(events.repartitionByRange(by, *order).withColumn("block", F.spark_partition_id()), name)


def _carried(df: DataFrame, totals: DataFrame, by: str) -> DataFrame:
    totals = totals.withColumnsRenamed({by: "_by", "block": "_block"})
    return df.join(totals, df[by].eqNullSafe(F.col("_by")) & (df["block"] == F.col("_block")), "left").drop("_by", "_block")


def running(events: DataFrame, by: str, order: list[str], last: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, own: bool = True) -> DataFrame:
    """Adds, up to and with (unless not ``own``) each event of its session, the last value that is not null, and the sum."""
    last, sums, mine = last or {}, sums or {}, 0 if own else -1
    here = Window.partitionBy(by, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, mine)
    local = events.withColumns({n: F.last(c, ignorenulls=True).over(here) for n, c in last.items()} | {n: F.sum(c).over(here) for n, c in sums.items()})
    ends = [F.max_by(c, F.when(c.isNotNull(), F.struct(*order))).alias(f"_{n}") for n, c in last.items()] + [F.sum(c).alias(f"_{n}") for n, c in sums.items()]
    before = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = events.groupBy(by, "block").agg(*ends)
    totals = totals.select(by, "block", *[F.last(f"_{n}", ignorenulls=True).over(before).alias(f"_{n}") for n in last], *[F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums])
    both = _carried(local, totals, by)
    both = both.withColumns({n: F.coalesce(n, f"_{n}") for n in last} | {n: F.coalesce(F.col(n), F.lit(0.0)) + F.coalesce(F.col(f"_{n}"), F.lit(0.0)) for n in sums})
    return both.drop(*[f"_{n}" for n in (*last, *sums)])


def clamped_sum(events: DataFrame, by: str, order: list[str], name: str, step: Column, low: float, high: float) -> DataFrame:
    """Adds ``name``: the sum from 0 of ``step`` (null: none), clamped to low..high after each event.

    Adding and clamping compose: any run of such steps is x -> min(max(x + a, lo), hi), so blocks are folded on their own.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:  # sorted, so that a session's block is a run of rows
            out, steps = [], batch["_step"].to_numpy(zero_copy_only=False).tolist()
            for key, s in zip(zip(batch[by].to_pylist(), batch["block"].to_pylist()), steps):
                if key != now:
                    now, a, lo, hi = key, 0.0, float("-inf"), float("inf")
                if s is not None and s == s:
                    a, lo, hi = a + s, min(max(lo + s, low), high), min(max(hi + s, low), high)
                out.append((a, lo, hi))
            ends = [pa.array(c, pa.float64()) for c in zip(*out)] if out else [pa.array([], pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *ends], names=[*batch.schema.names, "_a", "_lo", "_hi"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x = object(), 0.0
        for batch in batches:  # one row per range that a session reaches into, in order
            out, rows = [], batch.to_pydict()
            for key, a, lo, hi in zip(rows[by], rows["_a"], rows["_lo"], rows["_hi"]):
                if key != now:
                    now, x = key, 0.0
                out.append(x)
                x = min(max(x + a, lo), hi)
            yield pa.RecordBatch.from_arrays([batch[by], batch["block"], pa.array(out, pa.float64())], names=[by, "block", "_in"])

    ready = events.withColumn("_step", step.cast("double"))
    ready = ready.repartition(by, "block").sortWithinPartitions(by, "block", *order)
    own = ready.mapInArrow(fold, StructType([*ready.schema.fields, *[StructField(c, DoubleType()) for c in ("_a", "_lo", "_hi")]]))
    own = written(own, "clamped")
    ends = own.groupBy(by, "block").agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in ("_a", "_lo", "_hi")])
    kinds = f"{by} {dict(events.dtypes)[by]}, block int, _in double"
    into = ends.repartition(by).sortWithinPartitions(by, "block").mapInArrow(carry, kinds)
    both = _carried(own, into, by)
    return both.withColumn(name, F.least(F.greatest(F.col("_in") + F.col("_a"), F.col("_lo")), F.col("_hi"))).drop("_step", "_a", "_lo", "_hi", "_in")
