"""Streams, gates and camera input against plain loops, with one session that holds nearly all events."""

import math

import numpy as np
from pyspark.sql import functions as F

from voxelloom.plans import fixtures as X
from voxelloom.streaming import frames as FR
from voxelloom.streaming import input as IN
from voxelloom.streaming import keyed, running

SF = "/root/testdata/sf0.001"


def test_stream_does_not_depend_on_micro_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = sorted(map(tuple, keyed.drain_table(spark, f"{SF}/events.parquet", X.frames_of, ms=3_600_000).collect()))
    assert len(want) == events.count()
    lo, hi = (x.timestamp() for x in events.select(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")).first())
    step = (hi - lo) / 5 + 1
    for i in range(5):  # files in order of time, each in one micro-batch, with rows that come up to an hour late
        at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.when(F.col("event_id") % 4 == 0, 3000).otherwise(0)
        events.where((at >= lo + i * step) & (at < lo + (i + 1) * step)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert events.count() - spark.read.parquet(str(tmp_path / "in")).count() <= 1  # the last one may fall behind the last file
    got = sorted(map(tuple, keyed.drain_table(spark, str(tmp_path / "in"), X.frames_of, ms=3_600_000, files=1).collect()))
    kept = {r[1] for r in got}
    assert got == [r for r in want if r[1] in kept] or len(kept) == len(want) - 1


def dense(spark, n=4000):
    rng = np.random.default_rng(6)
    ms = np.sort(rng.integers(0, 60_000, n))
    rows = [(1 if i % 50 else int(rng.integers(2, 5)), i, int(t)) for i, t in enumerate(ms)]
    return rows, spark.createDataFrame(rows, "session long, frame_id long, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")


def test_gate_of_a_dense_session(spark):
    rows, df = dense(spark)
    for ms in (50, 700, 10_000):
        last, want = {}, set()
        for s, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
            if s not in last or t - last[s] >= ms:
                last[s] = t
                want.add((s, i, t))
        assert {(r.session, r.frame_id, r.ms) for r in FR.gated(df, ms).collect()} == want
    assert FR.gated(df.limit(0)).count() == 0
    twice = FR.gated(df.unionByName(df), 700).collect()
    assert sorted(map(tuple, twice)) == sorted(map(tuple, FR.gated(df, 700).collect()))


def loop(events, speed=0.2):
    """The state machine, event by event."""
    drag = pan = False
    lx = ly = yaw = pitch = 0.0
    p, held, out = np.zeros(3), set(), {}
    for e in sorted(events, key=lambda e: (e["ts"], e["frame_id"])):
        cp, sp = math.cos(pitch), math.sin(pitch)
        forward = np.array([cp * math.sin(yaw), sp, -cp * math.cos(yaw)])
        right = np.array([math.cos(yaw), 0.0, math.sin(yaw)])
        k = e["kind"]
        if k == "down":
            drag, pan, lx, ly = True, e["button"] == 1 or (e["button"] == 0 and e["shift"]), e["cx"], e["cy"]
        elif k == "up":
            drag = pan = False
        elif k == "move" and drag:
            dx, dy, lx, ly = e["cx"] - lx, e["cy"] - ly, e["cx"], e["cy"]
            if pan:
                p = p - right * dx * speed * 0.001 + np.cross(right, forward) * dy * speed * 0.001
            else:
                yaw, pitch = yaw + dx * 0.001, min(max(pitch - dy * 0.001, -IN.PITCH), IN.PITCH)
        elif k == "wheel":
            p = p - forward * min(max(e["delta"] / 100, -2), 2) * speed * 0.01
        elif k in ("keydown", "keyup"):
            (held.add if k == "keydown" else held.discard)(e["key"].lower())
        elif k == "tick":
            move = sum((np.array(v) for c, v in (("w", forward), ("s", -forward), ("d", right), ("a", -right), ("e", (0, 1, 0)), ("q", (0, -1, 0))) if c in held), np.zeros(3))
            if move @ move >= 0.001:
                p = p + move / np.sqrt(move @ move) * speed * e["dt"] * (3 if "shift" in held else 1)
        out[e["frame_id"]] = (yaw, pitch, *p)
    return out


def test_controls_of_a_long_session(spark):
    rng, rows = np.random.default_rng(9), []
    for i in range(3000):
        kind = str(rng.choice(["down", "up", "move", "move", "move", "wheel", "keydown", "keyup", "tick", "tick"]))
        rows.append((1 if i % 40 else 2, i // 3, i, kind, int(rng.integers(0, 3)), bool(rng.integers(0, 2)), float(rng.integers(0, 900)), float(rng.integers(0, 3000)), float(rng.normal(0, 300)), str(rng.choice(["w", "A", "s", "d", "q", "e", "Shift", "x"])), 0.016))
    schema = "session long, ts long, frame_id long, kind string, button int, shift boolean, cx double, cy double, delta double, key string, dt double"
    df = spark.createDataFrame(rows, schema)
    assert running.ranged(df, "session", IN.ORDER).where("session = 1").select("block").distinct().count() >= 1
    got = {r.frame_id: (r.yaw, r.pitch, r.px, r.py, r.pz) for r in IN.steer(df.repartition(6)).collect()}
    names = [c.split()[0] for c in schema.split(", ")]
    want = {}
    for s in (1, 2):
        want |= loop([dict(zip(names, r)) for r in rows if r[0] == s])
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert max(abs(v[1]) for v in want.values()) > 1.5  # the clamp is met
    assert IN.steer(df.limit(0)).count() == 0


def test_running_values_cross_blocks(spark):
    n = 1000
    df = spark.range(n).select(F.lit(7).alias("s"), F.col("id").alias("t"), F.when(F.col("id") % 90 == 0, F.col("id")).alias("v"), (F.col("id") % 3 - 1).cast("double").alias("d"))
    e = df.repartitionByRange(6, "s", "t").withColumn("block", F.spark_partition_id())
    assert e.select("block").distinct().count() == 6
    got = running.running(e, "s", ["t"], last={"seen": F.col("v")}, sums={"total": F.col("d")}).orderBy("t").collect()
    d = [(i % 3 - 1) for i in range(n)]
    assert [r.seen for r in got] == [i // 90 * 90 for i in range(n)] and [r.total for r in got] == list(np.cumsum(d))
    before = running.running(e, "s", ["t"], last={"seen": F.col("v")}, own=False).orderBy("t").collect()
    assert [r.seen for r in before] == [None, *[(i - 1) // 90 * 90 for i in range(1, n)]]
    clamped, want, x = running.clamped_sum(e, "s", ["t"], "c", (F.col("t") % 7 - 3.5).cast("double"), -4.0, 4.0).orderBy("t").collect(), [], 0.0
    for i in range(n):
        x = min(max(x + i % 7 - 3.5, -4.0), 4.0)
        want.append(x)
    assert [r.c for r in clamped] == want


def test_candidates_are_limited_below_the_window(spark):
    from voxelloom.operators import match

    f = X.features(spark, SF)
    plan = match.best_two(f, match.image_pairs(f.select("image_id").distinct()), X.WORDS)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "row_number(), 2" in plan


def test_waiting_frames_are_blocks():
    """Each waiting frame was a list entry of its own, and all were read again with each batch."""
    import pandas as pd

    calls = []

    class State(list):
        def appendValue(self, v):  # noqa: N802
            calls.append("append")
            self.append(v)

        def appendList(self, v):  # noqa: N802
            calls.extend(["append"] * len(v))
            self.extend(v)

        def get(self):
            calls.append("get")
            return iter(list(self)) if self else None

        def update(self, v):
            self[:] = v

    class Handle:
        def getListState(self, *_):  # noqa: N802
            return State()

        def getValueState(self, *_):  # noqa: N802
            state = State()
            state.get = lambda: tuple(state) or None
            state.exists = lambda: bool(state)
            return state

        def registerTimer(self, ms):  # noqa: N802
            calls.append(ms)

    class Mark:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    f = keyed.Follower(1000)
    f.init(Handle())
    us = [4_000_000, 1_000_000, 9_000_000, 2_500_000]
    frame = pd.DataFrame({"us": us, "frame_id": [4, 1, 9, 2], **{c: [float(u) / 1e6 for u in us] for c in keyed.POSE}})
    list(f.handleInputRows((3,), iter([frame]), None))
    assert calls == ["append", 1001]
    (first,) = f.handleExpiredTimer((3,), Mark(5000), None)
    assert first["frame_id"].tolist() == [1, 2, 4] and first["sorts"].tolist() == [True, True, True] and calls[-1] == 9001
    assert np.allclose(first["v"], [0, 1.5**2 * len(keyed.POSE), 1.5**2 * len(keyed.POSE)])
    assert list(f.handleExpiredTimer((3,), Mark(6000), None)) == []  # a timer of a batch that is gone
    (last,) = f.handleExpiredTimer((3,), Mark(9900), None)
    assert last["frame_id"].tolist() == [9] and np.allclose(last["v"], 25.0 * len(keyed.POSE))
