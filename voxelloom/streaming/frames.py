"""Frame events: the same logic over a batch, and as keyed state over a stream.

frames: session, ts, px, py, pz, fx, fy, fz. Batch forms are windows, or running values over ranges where they add up a whole session; the
greedy gate is a chain of successors followed by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.session import discard, written
from voxelloom.streaming.running import clamped_sum, ranged, running

# Smoothing, hysteresis limits and the least time between sorts.
KEEP, NEW = 0.7, 0.3
ENTER, LEAVE = 0.0002, 0.00005
GATE_MS = 50
POSE = ("px", "py", "pz", "fx", "fy", "fz")


def velocity(frames: DataFrame) -> DataFrame:
    """Adds v: the squared change of position and direction since the session's previous frame, 0 at its first."""
    w = Window.partitionBy("session").orderBy("ts", "frame_id")
    d = [F.col(c) - F.lag(c).over(w) for c in POSE]
    return frames.withColumn("v", F.coalesce(sum(x * x for x in d), F.lit(0.0)))


def smoothed(frames: DataFrame) -> DataFrame:
    """session, n, ema: the smoothed velocity after each session's last frame.

    The average is a sum of velocities by powers of ``KEEP`` in their distance from the last frame, so sessions are numbered and added up
    by range, however long they are.
    """
    order = ["ts", "frame_id"]
    e = ranged(frames.select("session", *order, *POSE), "session", order)
    e = running(e, "session", order, last={"was": F.struct(*POSE)}, own=False)
    v = F.coalesce(sum((F.col(c) - F.col(f"was.{c}")) * (F.col(c) - F.col(f"was.{c}")) for c in POSE), F.lit(0.0))
    e = running(e.withColumn("v", v), "session", order, sums={"i": F.lit(1.0)}).select("session", "i", "v")
    n = e.groupBy("session").agg(F.count("*").alias("n")).withColumnRenamed("session", "_s")
    both = e.join(n, e["session"].eqNullSafe(F.col("_s")))
    return both.groupBy("session").agg(F.first("n").alias("n"), F.sum(F.col("v") * NEW * F.pow(F.lit(KEEP), F.col("n") - F.col("i"))).alias("ema"))


def half_resolution(moving: DataFrame) -> DataFrame:
    """Adds half: on above the upper limit, off at or under the lower one, else as it was."""
    w = Window.partitionBy("session").orderBy("ts", "frame_id").rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(F.col("v") > ENTER, True).when(F.col("v") <= LEAVE, False)
    return moving.withColumn("half", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False)))


def frames_per_second(frames: DataFrame) -> DataFrame:
    return frames.groupBy(F.window("ts", "1 second").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def _successors(f: DataFrame, ms: int) -> DataFrame:
    """session, at, next: each frame's (ms, frame_id) and the first frame at least ``ms`` later.

    Frames and the moments that they ask for meet in cells of ``ms`` of time; a moment whose cell has nothing later takes the first
    frame of the session's next cell, from one row per session and cell.
    """
    cell = lambda c: F.floor(F.col(c) / ms)
    at = F.struct("ms", "frame_id")
    frames = f.select("session", F.col("ms").alias("t"), at.alias("found"), F.lit(None).cast("struct<ms:bigint,frame_id:bigint>").alias("asks"))
    asks = f.select("session", (F.col("ms") + ms).alias("t"), F.lit(None).cast("struct<ms:bigint,frame_id:bigint>").alias("found"), at.alias("asks"))
    # A frame at the very moment counts, so frames come after the moments of the same time.
    later = Window.partitionBy("session", "cell").orderBy("t", F.col("found").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
    both = frames.unionByName(asks).withColumn("cell", cell("t"))
    near = both.withColumn("next", F.min("found").over(later)).where("asks is not null").select("session", "cell", F.col("asks").alias("at"), "next")
    # The cells that hold frames or are asked for, each with the first frame of a later one.
    cells = both.groupBy("session", "cell").agg(F.min("found").alias("first"))
    beyond = Window.partitionBy("session").orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    cells = cells.select(F.col("session").alias("_s"), F.col("cell").alias("_c"), F.first("first", ignorenulls=True).over(beyond).alias("_first"))
    out = near.join(cells, F.col("session").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c")))
    return out.select("session", "at", F.coalesce("next", "_first").alias("next")).distinct()


def gated(frames: DataFrame, ms: int = GATE_MS) -> DataFrame:
    """session, frame_id, ts of the frames that may sort: each at least ``ms`` after the one before it, from each session's first.

    Every frame knows its successor; the chain from the first frame is followed by doubling, so n links take log n rounds and no
    session is gathered. Frames that repeat session, time and id are one.
    """
    f = frames.select("session", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "frame_id")
    jump = written(_successors(f, ms).where("next is not null"), "gate-jumps")
    chain = written(f.groupBy("session").agg(F.min(F.struct("ms", "frame_id")).alias("at")), "gate-chain")
    while not jump.isEmpty():
        j = jump.select(F.col("session").alias("_s"), F.col("at").alias("_at"), F.col("next").alias("_next"))
        reached = chain.join(j, chain["session"].eqNullSafe(j["_s"]) & (chain["at"] == j["_at"])).select("session", F.col("_next").alias("at"))
        grown = written(chain.unionByName(reached), "gate-chain")
        # Each link now spans two: frames without a second one are at their chain's end and need no link any more.
        further = written(jump.join(j, jump["session"].eqNullSafe(j["_s"]) & (jump["next"] == j["_at"])).select("session", "at", F.col("_next").alias("next")), "gate-jumps")
        discard(chain, jump)
        chain, jump = grown, further
    return chain.select("session", "at.frame_id", "at.ms")


STATE = "ms long, ema double, px double, py double, pz double, fx double, fy double, fz double, n long"
OUT = "session long, frame_id long, v double, ema double, sorts boolean"


def _fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["ts", "frame_id"])
    last, ema, *pose, n = state.get if state.exists else (None, 0.0, *[None] * 6, 0)
    out = []
    for r in rows.itertuples():
        now = [getattr(r, c) for c in POSE]
        v = 0.0 if pose[0] is None else sum((a - b) ** 2 for a, b in zip(now, pose))
        ema, pose, n = KEEP * ema + NEW * v, now, n + 1
        ms = int(r.ts.timestamp() * 1000)
        sorts = last is None or ms - last >= GATE_MS
        last = ms if sorts else last
        out.append((key[0], r.frame_id, v, ema, sorts))
    state.update((last, ema, *pose, n))
    yield pd.DataFrame(out, columns=["session", "frame_id", "v", "ema", "sorts"])


def follow(frames: DataFrame) -> DataFrame:
    """The streaming form: velocity, smoothing and sort gate per session, on event time within each batch."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return frames.groupBy("session").applyInPandasWithState(_fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_rates(frames: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Frames per second of a stream; the watermark bounds the state."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", "1 second").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def controls(events: DataFrame) -> DataFrame:
    """Yaw and pitch after all look events (session, ts, frame_id, dx, dy) of a session: 0.001 a unit, pitch clamped."""
    limit, order = 1.5707963267948966 - 0.01, ["ts", "frame_id"]
    e = clamped_sum(ranged(events.select("session", *order, "dx", "dy"), "session", order), "session", order, "pitch", -F.col("dy") * 0.001, -limit, limit)
    return e.groupBy("session").agg((F.sum("dx") * 0.001).alias("yaw"), F.max_by("pitch", F.struct(*order)).alias("pitch"))
