"""Camera input: mouse, wheel, key and tick events as one state machine per session.

Every part of the state is a running value (last mouse button, last mouse place, keys held, summed yaw, clamped pitch, summed
position), so sessions of any length are split over tasks; nothing is folded event by event over a whole session.

Events: session, ts, frame_id, kind (down, up, move, wheel, keydown, keyup, tick), button, shift (with the mouse button), cx, cy, delta, key, dt.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.session import discard, written
from voxelloom.streaming.running import clamped_sum, ranged, running

# Sensitivities, limits and factors of the controls.
LOOK, PAN, WHEEL = 0.001, 0.001, 0.01
PITCH = pi / 2 - 0.01
FAST, WHEEL_UNIT, WHEEL_MOST = 3.0, 100.0, 2.0
STILL = 0.001
KEYS = ("w", "a", "s", "d", "q", "e", "shift")
ORDER = ["ts", "frame_id"]


def steer(events: DataFrame, speed: float = 0.2, yaw: float = 0.0, at: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """session, frame_id, yaw, pitch, px, py, pz after each event.

    A drag pans with the middle button, or the left one with shift, and looks around otherwise. The wheel moves along the view, by two
    notches at most. A tick moves along the keys held then, three times as fast with shift, unless they cancel out.
    """
    kind = F.col("kind")
    key = F.lower("key")
    held = {f"k_{k}": F.when(kind.isin("keydown", "keyup") & (key == k), kind == "keydown") for k in KEYS}
    down = F.when(kind == "down", F.struct(F.lit(True).alias("drag"), ((F.col("button") == 1) | ((F.col("button") == 0) & F.col("shift"))).alias("pan"))).when(
        kind == "up", F.struct(F.lit(False).alias("drag"), F.lit(False).alias("pan"))
    )
    # Running values read their events twice, so each stage is written: left alone, every stage would double the work before it.
    first = ranged(events, "session", ORDER, "input")
    e = second = written(running(first, "session", ORDER, last=held | {"mouse": down}), "input")
    discard(first)
    dragged = (kind == "move") & F.coalesce(F.col("mouse.drag"), F.lit(False))
    # The place that the mouse was dragged from: that of the last down or dragged move before this event.
    e = running(e, "session", ORDER, last={"old": F.when((kind == "down") | dragged, F.struct("cx", "cy"))}, own=False)
    dx, dy = (F.when(dragged, F.col(c) - F.col(f"old.{c}")) for c in ("cx", "cy"))
    pans = F.coalesce(F.col("mouse.pan"), F.lit(False))
    e = third = written(e.withColumns({"dx": dx, "dy": dy, "pans": pans}).drop("mouse", "old"), "input")
    discard(second)
    e = running(e, "session", ORDER, sums={"turn": F.when(~F.col("pans"), F.col("dx") * LOOK)}).withColumn("yaw", F.col("turn") + yaw)
    e = clamped_sum(e, "session", ORDER, "pitch", F.when(~F.col("pans"), -F.col("dy") * LOOK), -PITCH, PITCH)
    discard(third)
    sy, cy, sp, cp = F.sin("yaw"), F.cos("yaw"), F.sin("pitch"), F.cos("pitch")
    forward, right, up = (cp * sy, sp, -cp * cy), (cy, F.lit(0.0), sy), (-sy * sp, cp, cy * sp)
    on = {k: F.coalesce(F.col(f"k_{k}"), F.lit(False)).cast("int") for k in KEYS}
    walk = [f * (on["w"] - on["s"]) + r * (on["d"] - on["a"]) + (on["e"] - on["q"]) * int(i == 1) for i, (f, r) in enumerate(zip(forward, right))]
    size = walk[0] * walk[0] + walk[1] * walk[1] + walk[2] * walk[2]
    pace = F.lit(speed) * F.col("dt") * F.when(on["shift"] == 1, FAST).otherwise(1.0) / F.sqrt(size)
    notch = F.least(F.greatest(F.col("delta") / WHEEL_UNIT, F.lit(-WHEEL_MOST)), F.lit(WHEEL_MOST)) * speed * WHEEL
    step = {
        f"s{i}": F.when((kind == "tick") & (size >= STILL), w * pace).when(kind == "wheel", -f * notch).when(F.col("dx").isNotNull() & F.col("pans"), (u * F.col("dy") - r * F.col("dx")) * speed * PAN)
        for i, (w, f, r, u) in enumerate(zip(walk, forward, right, up))
    }
    e = written(e.select("session", "block", *ORDER, "yaw", "pitch", *[c.alias(k) for k, c in step.items()]), "input")
    e = running(e, "session", ORDER, sums={f"p{i}": F.col(f"s{i}") for i in range(3)})
    return e.select("session", "frame_id", "yaw", "pitch", *[(F.col(f"p{i}") + at[i]).alias(c) for i, c in enumerate(("px", "py", "pz"))])
