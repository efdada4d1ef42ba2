"""Queries of corner features, training and frame events."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions import splat as S
from voxelloom.operators import features as K
from voxelloom.operators import train as T
from voxelloom.plans import fixtures as X
from voxelloom.plans.registry import query
from voxelloom.streaming import frames as FR

_CIRCLE = ", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(K.CIRCLE))
_INNER = "c.x BETWEEN 4 AND w - 5 AND c.y BETWEEN 4 AND h - 5"
_P = f"SELECT c.x, c.y, c.v, k.i, n.v AS p FROM blocky c JOIN size ON {_INNER} JOIN (VALUES {_CIRCLE}) k(i, dx, dy) ON true JOIN blocky n ON n.x = c.x + k.dx AND n.y = c.y + k.dy"
_FAST = f"SELECT x, y, any_value(v) AS v FROM ({_P}) WHERE i IN (0, 4, 8, 12) GROUP BY x, y HAVING count(*) FILTER (WHERE p > v + 25) >= 3 OR count(*) FILTER (WHERE p < v - 25) >= 3"


def _arc(test):
    """Nine in a row around the circle, by runs in the doubled list of positions."""
    return f"SELECT x, y FROM (SELECT x, y, i, sum(CASE WHEN {test} THEN 1 ELSE 0 END) OVER (PARTITION BY x, y ORDER BY i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS run FROM (SELECT x, y, v, i, p FROM pp UNION ALL SELECT x, y, v, i + 16, p FROM pp)) WHERE run = 9 GROUP BY x, y"


_PP = f"(SELECT q.* FROM ({_P}) q SEMI JOIN ({_FAST}) f ON q.x = f.x AND q.y = f.y)"
_SCORED = (
    f"SELECT x, y, CASE WHEN b THEN bs ELSE ds END AS score FROM (SELECT s.x, s.y, (s.x, s.y) IN (SELECT (x, y) FROM ({_arc('p - v > 25')})) AS b, (s.x, s.y) IN (SELECT (x, y) FROM ({_arc('v - p > 25')})) AS d, bs, ds "
    "FROM (SELECT x, y, min(p - v - 25) FILTER (WHERE p - v > 25) AS bs, min(v - p - 25) FILTER (WHERE v - p > 25) AS ds FROM pp GROUP BY x, y) s) WHERE b OR d"
).replace("FROM pp", f"FROM {_PP}")
_NMS = f"SELECT x, y, score FROM ({_SCORED}) QUALIFY row_number() OVER (PARTITION BY x // 8, y // 8 ORDER BY score DESC, y, x) = 1"
_TOP = f"SELECT x, y, score, row_number() OVER (ORDER BY score DESC, y, x) - 1 AS feat_id FROM ({_NMS}) QUALIFY feat_id < 2000"


def _size(spark, sf):
    return X.WIDTH, X.height(spark, sf)


@query(_FAST, ints="x y v")
def flt_fast4(spark, sf):
    return K.compass_test(X.blocky(spark, sf), *_size(spark, sf))


@query(_SCORED, ints="x y score")
def f_fast(spark, sf):
    return K.corners(X.blocky(spark, sf), *_size(spark, sf))


@query(f"SELECT score, count(*) AS n FROM ({_SCORED}) GROUP BY score", ints="score n")
def f_score(spark, sf):
    return K.corners(X.blocky(spark, sf), *_size(spark, sf)).groupBy("score").agg(F.count("*").alias("n"))


@query(f"SELECT k.i, count(*) AS n, sum(p.v) AS total FROM blocky c JOIN (VALUES {_CIRCLE}) k(i, dx, dy) ON true JOIN blocky p ON p.x = c.x + k.dx AND p.y = c.y + k.dy GROUP BY k.i", ints="i n total")
def f_circle(spark, sf):
    """What lies at each place of the circle around every pixel."""
    g = X.blocky(spark, sf)
    at = g.select("image_id", K.circle("x", "y").alias("k")).select("image_id", "k.*")
    return at.join(g, ["image_id", "x", "y"]).groupBy("i").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT m, list_bool_or(list_transform(range(16), lambda s: ((m + m * 65536) >> s) & 511 = 511)) AS arc FROM (SELECT event_id * 40503 % 65536 AS m FROM events)", ints="m", other="arc")
def w_circle9(spark, sf):
    from voxelloom.session import table

    m = table(spark, sf, "events").select((F.col("event_id") * 40503 % 65536).alias("m"))
    return m.select("m", K.has_arc([F.shiftright("m", i).bitwiseAND(F.lit(1)) == 1 for i in range(16)]).alias("arc"))


@query(_NMS, ints="x y score")
def w_nms(spark, sf):
    return K.suppress(K.corners(X.blocky(spark, sf), *_size(spark, sf)))


@query(_TOP, ints="feat_id x y score")
def s_top2000(spark, sf):
    return K.strongest(K.suppress(K.corners(X.blocky(spark, sf), *_size(spark, sf))))


_PAIRS = K.test_pairs().tolist()
_TABLE = ", ".join(f"({i}, {a}, {b}, {c}, {d})" for i, (a, b, c, d) in enumerate(_PAIRS))
_ASK = f"SELECT k.feat_id, k.i, p.v < q.v AS bit FROM (SELECT feat_id, i, f.x + x1 AS ax, f.y + y1 AS ay, f.x + x2 AS bx, f.y + y2 AS by_ FROM ({_TOP}) f JOIN size ON f.x BETWEEN 15 AND w - 16 AND f.y BETWEEN 15 AND h - 16 JOIN (VALUES {_TABLE}) t(i, x1, y1, x2, y2) ON true) k JOIN (SELECT x, y, v FROM blocky) p ON p.x = k.ax AND p.y = k.ay JOIN (SELECT x, y, v FROM blocky) q ON q.x = k.bx AND q.y = k.by_"


@query(f"SELECT feat_id, count(*) FILTER (WHERE bit) AS ones, count(*) FILTER (WHERE bit AND i % 2 = 0) AS even FROM ({_ASK}) GROUP BY feat_id", ints="feat_id ones even")
def f_brief(spark, sf):
    g = X.blocky(spark, sf)
    w, h = _size(spark, sf)
    d = K.describe(g, K.strongest(K.suppress(K.corners(g, w, h))), w, h).where(F.col("x").between(15, w - 16) & F.col("y").between(15, h - 16))
    ones = F.expr("bit_count(d0) + bit_count(d1) + bit_count(d2) + bit_count(d3)")
    mask = 0x5555555555555555
    even = F.expr(" + ".join(f"bit_count(d{i} & {mask}L)" for i in range(4)))
    return d.select("feat_id", ones.alias("ones"), even.alias("even"))


@query(f"SELECT t.i, count(*) AS n, count(*) FILTER (WHERE p.v < q.v) AS less FROM blocky c JOIN (VALUES {_TABLE}) t(i, x1, y1, x2, y2) ON c.x % 10 = 0 AND c.y % 5 = 0 JOIN blocky p ON p.x = c.x + x1 AND p.y = c.y + y1 JOIN blocky q ON q.x = c.x + x2 AND q.y = c.y + y2 GROUP BY t.i", ints="i n less")
def f_pairs(spark, sf):
    """How each of the 256 tests turns out over a grid of pixels that covers the image."""
    g = X.blocky(spark, sf).select("image_id", "x", "y", "v")
    tests = F.broadcast(spark.createDataFrame([(i, *p) for i, p in enumerate(_PAIRS)], "i int, x1 int, y1 int, x2 int, y2 int"))  # 256 rows
    at = lambda k: g.select("image_id", F.col("x").alias(f"px{k}"), F.col("y").alias(f"py{k}"), F.col("v").alias(f"v{k}"))
    c = g.where("x % 10 = 0 and y % 5 = 0").crossJoin(tests)
    c = c.select("image_id", "i", *[(F.col(a) + F.col(f"{a}{k}")).alias(f"p{a}{k}") for k in (1, 2) for a in "xy"])
    both = c.join(at(1), ["image_id", "px1", "py1"]).join(at(2), ["image_id", "px2", "py2"])
    return both.groupBy("i").agg(F.count("*").alias("n"), F.count_if(F.col("v1") < F.col("v2")).alias("less"))


_WORD = lambda w: f"sum(CASE WHEN bit AND i // 64 = {w} THEN 1::HUGEINT << (i % 64)::INT ELSE 0 END)"
_SIGNED = lambda c: f"coalesce(CASE WHEN {c} >= 9223372036854775808 THEN {c} - 18446744073709551616 ELSE {c} END, 0) AS {c}"
_WORDS = f"SELECT feat_id, {', '.join(f'{_WORD(w)} AS d{w}' for w in range(4))} FROM ({_ASK}) GROUP BY feat_id"


@query(f"SELECT 0 AS image_id, feat_id, x, y, {', '.join(_SIGNED(f'd{w}') for w in range(4))} FROM ({_TOP}) LEFT JOIN ({_WORDS}) USING (feat_id)", ints="image_id feat_id x y d0 d1 d2 d3")
def f_detect(spark, sf):
    return K.detect(X.blocky(spark, sf), *_size(spark, sf))


_NN = "(SELECT avg(d) AS m FROM (SELECT min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS d FROM (SELECT * FROM ppts ORDER BY point_id LIMIT 100) a JOIN ppts b ON a.point_id <> b.point_id GROUP BY a.point_id))"


@query(f"SELECT point_id AS splat_id, x, ln(m * 0.5) AS scale_x, 2 AS opacity_logit, (r - 0.5) * 2 AS sh_dc_r FROM ppts, {_NN}", ints="splat_id", reals="x scale_x opacity_logit sh_dc_r")
def t_init(spark, sf):
    return T.initialise(X.part_points(spark, sf))


@query("SELECT splat_id, x FROM spl WHERE 1 / (1 + exp(-opacity_logit)) >= 0.01", ints="splat_id", reals="x")
def flt_prune(spark, sf):
    return T.prune(X.splats(spark, sf))


_L1 = "SELECT avg((abs(coalesce(i.r, 0) - t.r) + abs(coalesce(i.g, 0) - t.g) + abs(coalesce(i.b, 0) - t.b)) / 3) AS loss FROM target t LEFT JOIN image i ON i.x = t.x AND i.y = t.y"


@query(_L1, reals="loss")
def agg_l1(spark, sf):
    from voxelloom.operators import raster as R

    lit = R.composite(R.splat_pixels(R.project(X.splats(spark, sf), X.CAMERA), 64, 48))
    return T.l1(lit, X.target(spark, sf))


_BACK = (
    "SELECT s.splat_id, sh_dc_r - sign(er) * 0.005 AS sh_dc_r, opacity_logit + CASE WHEN abs(er) + abs(eg) + abs(eb) > 0.5 THEN 0.001 ELSE 0 END AS opacity_logit, scale_x - CASE WHEN abs(er) + abs(eg) + abs(eb) > 0.3 THEN 0.0005 ELSE 0 END AS scale_x FROM "
    "(SELECT spl.*, CASE WHEN t.r IS NULL THEN 0 ELSE coalesce(i.r, 0) - t.r END AS er, CASE WHEN t.r IS NULL THEN 0 ELSE coalesce(i.g, 0) - t.g END AS eg, CASE WHEN t.r IS NULL THEN 0 ELSE coalesce(i.b, 0) - t.b END AS eb FROM "
    "(SELECT *, CAST(trunc(least(greatest(76.8::DOUBLE * -x / z + 32, 0), 63)) AS BIGINT) AS u, CAST(trunc(least(greatest(76.8::DOUBLE * -y / z + 24, 0), 47)) AS BIGINT) AS v2 FROM spl) spl LEFT JOIN target t ON t.x = u AND t.y = v2 LEFT JOIN image i ON i.x = u AND i.y = v2) s"
)


@query(_BACK, ints="splat_id", reals="sh_dc_r opacity_logit scale_x")
def t_back(spark, sf):
    from voxelloom.operators import raster as R

    s = X.splats(spark, sf)
    lit = R.composite(R.splat_pixels(R.project(s, X.CAMERA), 64, 48))
    return T.update(s, lit, X.target(spark, sf), X.CAMERA)




def _adapt_sql(cap):
    kept = "(SELECT *, (exp(scale_x + 1.5) + exp(scale_y + 1.5) + exp(scale_z + 1.5)) / 3 AS sx FROM spl WHERE 1 / (1 + exp(-opacity_logit)) >= 0.01)"
    room = f"(SELECT greatest(0, {cap} - count(*)) AS room, max(splat_id) AS top FROM {kept})"
    split = f"(SELECT splat_id, i, top FROM (SELECT splat_id, row_number() OVER (ORDER BY splat_id) AS i FROM {kept} WHERE sx > 0.1), {room} WHERE i <= room)"
    return (
        f"SELECT k.splat_id, CASE WHEN s.i IS NULL THEN x ELSE x + sx * 0.5 END AS x, CASE WHEN s.i IS NULL THEN scale_x + 1.5 ELSE ln(sx * 0.5) END AS scale_x FROM {kept} k LEFT JOIN {split} s ON s.splat_id = k.splat_id "
        f"UNION ALL SELECT top + i, x - sx * 0.5, ln(sx * 0.5) FROM {kept} k JOIN {split} s ON s.splat_id = k.splat_id"
    )


def _large(spark, sf):
    return X.splats(spark, sf).withColumns({f"scale_{a}": F.col(f"scale_{a}") + 1.5 for a in "xyz"})


@query(_adapt_sql(5000), ints="splat_id", reals="x scale_x")
def t_adapt(spark, sf):
    return T.adapt(_large(spark, sf))


@query(_adapt_sql(210), ints="splat_id", reals="x scale_x")
def u_split(spark, sf):
    return T.adapt(_large(spark, sf), cap=210)


@query("SELECT splat_id, (1 / (1 + exp(-sh_dc_r)) - 0.5) / 0.28209479::DOUBLE AS sh_dc_r FROM spl", ints="splat_id", reals="sh_dc_r")
def snk_scene(spark, sf):
    return T.to_scene(X.splats(spark, sf))


_VEL = "SELECT *, coalesce(" + " + ".join(f"({c} - lag({c}) OVER w) ** 2" for c in FR.POSE) + ", 0) AS v FROM frames WINDOW w AS (PARTITION BY session ORDER BY ts, frame_id)"


@query(_VEL, ints="session frame_id", reals="v")
def w_velocity(spark, sf):
    return FR.velocity(X.frames(spark, sf))


@query(f"SELECT session, count(*) AS n, list_reduce(list_prepend(0.0::DOUBLE, list(v ORDER BY ts, frame_id)), lambda s, x: 0.7::DOUBLE * s + 0.3::DOUBLE * x) AS ema FROM ({_VEL}) GROUP BY session", ints="session n", reals="ema")
def w_ema(spark, sf):
    return FR.smoothed(X.frames(spark, sf))


@query(f"SELECT session, frame_id, coalesce(last_value(CASE WHEN v > 0.0002 THEN true WHEN v <= 0.00005 THEN false END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS half FROM ({_VEL})", ints="session frame_id", other="half")
def w_hyst(spark, sf):
    return FR.half_resolution(FR.velocity(X.frames(spark, sf)))


@query("SELECT epoch_ms(date_trunc('second', ts)) // 1000 AS start, count(*) AS n FROM frames GROUP BY 1", ints="start n")
def agg_fps(spark, sf):
    return FR.frames_per_second(X.frames(spark, sf)).select(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', start)").alias("start"), "n")


@query("SELECT session, sum(dx) * 0.001 AS yaw, list_reduce(list_prepend(0.0::DOUBLE, list(dy ORDER BY ts, frame_id)), lambda s, d: least(greatest(s - d * 0.001, -(pi() / 2 - 0.01)), pi() / 2 - 0.01)) AS pitch FROM frames GROUP BY session", ints="session", reals="yaw pitch")
def ctl_look(spark, sf):
    return FR.controls(X.frames(spark, sf))


@query(None, ints="iteration", reals="loss")
def w_loss(spark, sf):
    _, losses = T.train(X.part_points(spark, sf), X.target(spark, sf), X.CAMERA, iterations=3, batch=None)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(losses)], "iteration int, loss double")


@query(None, ints="splat_id", reals="x sh_dc_r opacity_logit")
def t_loop(spark, sf):
    splats, _ = T.train(X.part_points(spark, sf), X.target(spark, sf), X.CAMERA, iterations=2)
    return splats


@query("SELECT splat_id, exp(scale_x) AS sx FROM spl", ints="splat_id", reals="sx")
def snk_handoff(spark, sf):
    return X.splats(spark, sf).select("splat_id", F.exp("scale_x").alias("sx"))


@query("SELECT splat_id, ln(exp(scale_x)) AS back, 1 / (1 + exp(-opacity_logit)) AS opacity FROM spl", ints="splat_id", reals="back opacity")
def act_inverse(spark, sf):
    return X.splats(spark, sf).select("splat_id", F.ln(F.exp("scale_x")).alias("back"), S.sigmoid("opacity_logit").alias("opacity"))
