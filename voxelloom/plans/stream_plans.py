"""Queries over frame and input events: streams, gates, controls."""

from __future__ import annotations


from voxelloom.plans import fixtures as X
from voxelloom.plans.registry import query
from voxelloom.streaming import frames as FR
from voxelloom.streaming import input as IN
from voxelloom.streaming import keyed

#: The fixture's frames lie minutes apart, so its gate is an hour.
HOUR = 3_600_000

_N = "SELECT session, frame_id, epoch_us(ts) // 1000 AS ms, v, row_number() OVER (PARTITION BY session ORDER BY ts, frame_id) AS k FROM (SELECT *, coalesce(" + " + ".join(f"({c} - lag({c}) OVER w) ** 2" for c in FR.POSE) + ", 0) AS v FROM frames WINDOW w AS (PARTITION BY session ORDER BY ts, frame_id))"
_FOLLOW = f"""
SELECT session, frame_id, ms, v, ema, sorts FROM (
  WITH RECURSIVE n AS MATERIALIZED ({_N}),
  r AS (
    SELECT session, frame_id, ms, v, k, {FR.NEW}::DOUBLE * v AS ema, true AS sorts, ms AS last FROM n WHERE k = 1
    UNION ALL
    SELECT n.session, n.frame_id, n.ms, n.v, n.k, {FR.KEEP}::DOUBLE * r.ema + {FR.NEW}::DOUBLE * n.v, n.ms - r.last >= {HOUR}, CASE WHEN n.ms - r.last >= {HOUR} THEN n.ms ELSE r.last END
    FROM r JOIN n ON n.session = r.session AND n.k = r.k + 1)
  SELECT * FROM r)
"""


@query(_FOLLOW, ints="session frame_id ms", reals="v ema", other="sorts")
def stream_frames(spark, sf):
    return keyed.drain_table(spark, f"{sf}/events.parquet", X.frames_of, ms=HOUR)


@query(f"SELECT session, frame_id, ms FROM ({_FOLLOW}) WHERE sorts", ints="session frame_id ms")
def w_gate(spark, sf):
    return FR.gated(X.frames(spark, sf), HOUR)


_HELD = " + ".join(f"CASE WHEN lower(n.key) = '{k}' THEN {1 << i} ELSE 0 END" for i, k in enumerate(IN.KEYS))
_ON = ", ".join(f"(held >> {i}) & 1 AS h_{k}" for i, k in enumerate(IN.KEYS))
_STEER = f"""
SELECT session, frame_id, yaw, pitch, px, py, pz FROM (
  WITH RECURSIVE n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, frame_id) AS k FROM inputs),
  r AS (
    SELECT session, 0::BIGINT AS k, 0::BIGINT AS frame_id, false AS drag, false AS pan, 0.0::DOUBLE AS lx, 0.0::DOUBLE AS ly, 0::BIGINT AS held, 0.0::DOUBLE AS yaw, 0.0::DOUBLE AS pitch, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, 0.0::DOUBLE AS pz
    FROM (SELECT DISTINCT session FROM n)
    UNION ALL
    SELECT session, k, frame_id, drag, pan, lx, ly, held, yaw, pitch,
      px + CASE WHEN moved THEN mx * pace WHEN kind = 'wheel' THEN -fx * notch WHEN dx IS NOT NULL AND pan THEN (-sin(yaw) * sin(pitch) * dy - cos(yaw) * dx) * 0.0002::DOUBLE ELSE 0 END,
      py + CASE WHEN moved THEN my * pace WHEN kind = 'wheel' THEN -fy * notch WHEN dx IS NOT NULL AND pan THEN cos(pitch) * dy * 0.0002::DOUBLE ELSE 0 END,
      pz + CASE WHEN moved THEN mz * pace WHEN kind = 'wheel' THEN -fz * notch WHEN dx IS NOT NULL AND pan THEN (cos(yaw) * sin(pitch) * dy - sin(yaw) * dx) * 0.0002::DOUBLE ELSE 0 END
    FROM (
      SELECT *, kind = 'tick' AND mx * mx + my * my + mz * mz >= 0.001 AS moved, 0.2::DOUBLE * dt * CASE WHEN h_shift = 1 THEN 3 ELSE 1 END / sqrt(greatest(mx * mx + my * my + mz * mz, 1e-9)) AS pace
      FROM (
        SELECT *, fx * (h_w - h_s) + cos(yaw) * (h_d - h_a) AS mx, fy * (h_w - h_s) + (h_e - h_q) AS my, fz * (h_w - h_s) + sin(yaw) * (h_d - h_a) AS mz, least(greatest(delta / 100, -2), 2) * 0.002::DOUBLE AS notch
        FROM (
          SELECT *, cos(pitch) * sin(yaw) AS fx, sin(pitch) AS fy, -cos(pitch) * cos(yaw) AS fz, {_ON}
          FROM (
            SELECT * EXCLUDE (yaw, pitch), yaw + CASE WHEN dx IS NOT NULL AND NOT pan THEN dx * 0.001::DOUBLE ELSE 0 END AS yaw,
              CASE WHEN dx IS NOT NULL AND NOT pan THEN least(greatest(pitch - dy * 0.001::DOUBLE, {-IN.PITCH!r}), {IN.PITCH!r}) ELSE pitch END AS pitch
            FROM (
              SELECT n.session, n.k, n.frame_id, n.kind, n.delta, n.dt, r.yaw, r.pitch, r.px, r.py, r.pz,
                CASE WHEN n.kind = 'down' THEN true WHEN n.kind = 'up' THEN false ELSE r.drag END AS drag,
                CASE WHEN n.kind = 'down' THEN n.button = 1 OR (n.button = 0 AND n.shift) WHEN n.kind = 'up' THEN false ELSE r.pan END AS pan,
                CASE WHEN n.kind = 'move' AND r.drag THEN n.cx - r.lx END AS dx, CASE WHEN n.kind = 'move' AND r.drag THEN n.cy - r.ly END AS dy,
                CASE WHEN n.kind = 'down' OR (n.kind = 'move' AND r.drag) THEN n.cx ELSE r.lx END AS lx, CASE WHEN n.kind = 'down' OR (n.kind = 'move' AND r.drag) THEN n.cy ELSE r.ly END AS ly,
                CASE WHEN n.kind = 'keydown' THEN r.held | ({_HELD}) WHEN n.kind = 'keyup' THEN r.held & ~({_HELD}) ELSE r.held END AS held
              FROM r JOIN n ON n.session = r.session AND n.k = r.k + 1))))))
  SELECT * FROM r WHERE k > 0)
"""


@query(_STEER, ints="session frame_id", reals="yaw pitch px py pz")
def ctl_events(spark, sf):
    return IN.steer(X.inputs(spark, sf))
