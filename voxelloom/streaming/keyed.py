"""Frames of an unbounded source, followed per session by a stateful processor in event time.

Frames wait in keyed state until the watermark passes them, then a timer releases them in order of time, so the result does not depend on how
files fall into micro-batches. A session's past is one row: its last pose, smoothed velocity and last sort. Waiting frames are those of
the lateness bound alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxelloom.session import shared_dir
from voxelloom.streaming.frames import GATE_MS, KEEP, NEW, POSE

ROCKS, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_POSE = ", ".join(f"{c} double" for c in POSE)
#: Frames wait in blocks, a batch's frames of a session as bytes: a list of single frames costs the way to Python and back for each.
WAITING = "frames binary"
FRAME = np.dtype([("us", "<i8"), ("frame_id", "<i8"), *[(c, "<f8") for c in POSE]])
PAST = f"sorted_ms long, ema double, {_POSE}"
OUT = "session long, frame_id long, ms long, v double, ema double, sorts boolean"
#: A frame of no session that closes a bounded stream: the watermark passes everything before it.
END = "2262-01-01 00:00:00"


class Follower(StatefulProcessor):
    """Velocity, smoothing and sort gate of one session's frames."""

    def __init__(self, ms: int = GATE_MS):
        self.ms = ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.past = handle.getValueState("past", PAST)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if pd.isna(key[0]):  # the closing frame
            return
        first = None
        for batch in rows:
            if batch["us"].isna().any():
                raise ValueError("a frame without its time")
            held = np.empty(len(batch), FRAME)
            for c in FRAME.names:
                held[c] = batch[c].to_numpy()
            self.waiting.appendValue((held.tobytes(),))
            low = int(held["us"].min())
            first = low if first is None else min(first, low)
        if first is not None:  # earlier timers of this session stay
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [np.frombuffer(r[0], FRAME) for r in self.waiting.get()]
        held = np.concatenate(blocks) if blocks else np.empty(0, FRAME)
        due, rest = held[held["us"] < mark], held[held["us"] >= mark]
        if not len(due):  # an earlier timer has let them go
            return
        self.waiting.clear()
        if len(rest):
            self.waiting.appendValue((rest.tobytes(),))
            self.handle.registerTimer(int(rest["us"].min()) // 1000 + 1)
        yield self._follow(key[0], due[np.lexsort([due[c] for c in reversed(FRAME.names)])])

    def _follow(self, session: int, due: np.ndarray) -> pd.DataFrame:
        past = self.past.get()
        last, ema, *pose = past if past is not None else (None, 0.0, *[None] * len(POSE))
        v = np.zeros(len(due))
        for i, c in enumerate(POSE):
            step = np.diff(due[c], prepend=due[c][0] if pose[i] is None else pose[i])
            v += step * step
        smooth, sorts, at = [], [], due["us"] // 1000
        for d, ms in zip(v.tolist(), at.tolist()):
            ema = KEEP * ema + NEW * d
            sort = last is None or ms - last >= self.ms
            last = ms if sort else last
            smooth.append(ema)
            sorts.append(sort)
        self.past.update((last, ema, *[float(due[c][-1]) for c in POSE]))
        return pd.DataFrame({"session": session, "frame_id": due["frame_id"], "ms": at, "v": v, "ema": smooth, "sorts": sorts})


def followed(frames: DataFrame, late: str, ms: int = GATE_MS) -> DataFrame:
    """session, frame_id, ms, v, ema, sorts of a stream of frames (session, ts, frame_id and pose), each once the watermark has passed it."""
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    return timed.groupBy("session").transformWithStateInPandas(Follower(ms), OUT, "Append", "eventTime")


def drain(spark: SparkSession, source, schema_of: DataFrame, folder: str, late: str, ms: int = GATE_MS) -> DataFrame:
    """Everything that a bounded stream gives: ``source()`` is its streaming DataFrame, ``folder`` is for state and results.

    The stream is run with ``availableNow``, then once more from the same checkpoint with the closing frame, which releases what
    still waits for the watermark.
    """
    before = spark.conf.get(ROCKS)
    spark.conf.set(ROCKS, PROVIDER)
    columns = ["session", "ts", "frame_id", *POSE]
    try:
        schema_of.select(*columns).limit(0).write.mode("append").parquet(f"{folder}/end")
        for closing in (False, True):
            if closing:
                zero = [F.lit(0.0).alias(c) for c in POSE]
                last = spark.range(1).select(F.lit(None).cast("long").alias("session"), F.lit(END).cast(schema_of.schema["ts"].dataType).alias("ts"), F.lit(0).cast("long").alias("frame_id"), *zero)
                last.write.mode("append").parquet(f"{folder}/end")
            ends = spark.readStream.schema(schema_of.select(*columns).schema).parquet(f"{folder}/end")
            out = followed(source().select(*columns).unionByName(ends), late, ms)
            q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(ROCKS, before)
    return spark.read.schema(OUT).parquet(f"{folder}/out")


def drain_table(spark: SparkSession, path: str, frames, late: str = "1 hour", ms: int = GATE_MS, files: int | None = None) -> DataFrame:
    """:func:`drain` over the Parquet files of ``path``, ``files`` of them a micro-batch; ``frames`` makes frames of its rows."""
    import uuid

    static = spark.read.parquet(path)

    def source() -> DataFrame:
        reader = spark.readStream.schema(static.schema)
        if files:
            reader = reader.option("maxFilesPerTrigger", files)
        return frames(reader.parquet(f"{path[:-1]}[{path[-1]}]"))  # as a pattern, so that it may be one file as well

    return drain(spark, source, frames(static), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", late, ms)
