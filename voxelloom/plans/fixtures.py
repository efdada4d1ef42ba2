"""The driver's tables as pixel, descriptor, point, splat and frame tables, in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions import splat as S
from voxelloom.functions.camera import Camera
from voxelloom.session import table

WIDTH = 100
WORDS = ["d0", "d1"]
#: Kinds and keys of the input fixture, dealt out by event.
KINDS, KEYS = "down move move wheel tick keydown tick move tick up keyup move", "w A s D q E Shift w"
#: The camera that looks at the splat fixture.
CAMERA = Camera.default(64, 48, position=(0.0, 0.0, 0.0), forward=(0.0, 0.0, 1.0))


def height(spark: SparkSession, sf: str) -> int:
    return max(1, table(spark, sf, "events").count() // WIDTH)


def _place():
    return F.lit(0).alias("image_id"), (F.col("event_id") % WIDTH).cast("int").alias("x"), F.expr(f"cast(event_id div {WIDTH} as int)").alias("y")


def depth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(*_place(), F.col("value").alias("d"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(*_place(), (F.col("user_id") % 256).cast("int").alias("r"), (k % 256).alias("g"), (F.col("event_id") * 37 % 256).cast("int").alias("b"), F.lit(255).alias("a"))


def gray(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(*_place(), (F.col("event_id") * 7919 % 256).cast("int").alias("v"))


def blocky(spark: SparkSession, sf: str) -> DataFrame:
    """A dark grey image with bright dots, which the segment test finds."""
    e = F.col("event_id")
    x, y = e % WIDTH, F.expr(f"event_id div {WIDTH}")
    lit = F.expr(f"event_id % {WIDTH} % 9 < 2 AND event_id div {WIDTH} % 7 < 2")
    v = F.when(lit, 200).otherwise(40) + (x * 7 + y * 13) % 11
    return table(spark, sf, "events").select(*_place(), v.cast("int").alias("v"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    word = lambda a: F.expr(f"aggregate(sequence(0, 31), 0L, (s, i) -> s + IF(embedding[i + {a}] > 0, shiftleft(1L, i), 0L))")
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("image_id"), v.alias("feat_id"), (v * 37 % 640).cast("double").alias("x"), (v * 53 % 480).cast("double").alias("y"), word(0).alias("d0"), word(32).alias("d1")
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    key = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")
    # Every 500th point is far out, so that outlier filters have something to do.
    far = F.when(F.col("l_partkey") % 500 == 7, 40.0).otherwise(1.0)
    return table(spark, sf, "lineitem").select(
        key.alias("point_id"), (F.col("l_quantity") * far).alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_discount") * 100.0 * far + 1.0).alias("z"),
        *[(F.col(c) % m / m).alias(k) for c, m, k in (("l_orderkey", 10.0, "r"), ("l_partkey", 8.0, "g"), ("l_suppkey", 7.0, "b"))],
    )


def part_points(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(p.alias("point_id"), ((p % 41) / 10.0 - 2.0).alias("x"), (F.col("p_size") / 20.0 - 1.2).alias("y"), (2.0 + F.col("p_retailprice") / 500.0).alias("z"), *[(p % m / float(m)).alias(k) for m, k in ((10, "r"), (8, "g"), (7, "b"))])


def splats(spark: SparkSession, sf: str) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        p.alias("splat_id"), ((p % 41) / 10.0 - 2.0).alias("x"), (s / 20.0 - 1.2).alias("y"), (2.0 + F.col("p_retailprice") / 500.0).alias("z"),
        S.ln((s + 1) / 500.0).alias("scale_x"), S.ln((s + 5) / 800.0).alias("scale_y"), S.ln(F.lit(0.03)).alias("scale_z"),
        F.lit(1.0).alias("rot_w"), (p % 7 / 10.0).alias("rot_x"), (p % 5 / 10.0).alias("rot_y"), (p % 3 / 10.0).alias("rot_z"),
        (p % 13 - 6.0).alias("opacity_logit"), (p % 11 / 5.0 - 1.0).alias("sh_dc_r"), (p % 9 / 4.0 - 1.0).alias("sh_dc_g"), (p % 8 / 3.5 - 1.0).alias("sh_dc_b"),
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames_of(table(spark, sf, "events"))


def frames_of(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.select(
        e.alias("frame_id"), F.col("user_id").alias("session"), "ts", (F.col("value") / 20000.0).alias("px"), (e % 17 / 1000.0).alias("py"), F.lit(0.0).alias("pz"),
        (e % 5 / 1000.0).alias("fx"), F.lit(0.0).alias("fy"), F.lit(1.0).alias("fz"), (e % 29 - 14.0).alias("dx"), (F.col("value") % 50 - 20.0).alias("dy"),
    )


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    kinds, keys = (F.split(F.lit(t), " ") for t in (KINDS, KEYS))
    return table(spark, sf, "events").select(
        e.alias("frame_id"), F.col("user_id").alias("session"), "ts", F.get(kinds, (e * 7 % 12).cast("int")).alias("kind"), (e % 3).cast("int").alias("button"), (e % 7 == 0).alias("shift"),
        (e * 37 % 640).cast("double").alias("cx"), (e * 53 % 480).cast("double").alias("cy"), (e * 31 % 700 - 350.0).alias("delta"), F.get(keys, (e % 8).cast("int")).alias("key"), (0.016 + e % 5 / 50.0).alias("dt"),
    )


#: Size of the picture fixture: so many events make one picture.
TILE_W, TILE_H = 12, 8


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """image_id, x, y, r, g, b of pictures of 12 x 8 events each; events that fill no whole picture are left out."""
    e, n = F.col("event_id"), TILE_W * TILE_H
    k = F.get_json_object("props", "$.k").cast("int")
    t = table(spark, sf, "events").select(
        F.expr(f"event_id div {n}").alias("image_id"), (e % n % TILE_W).cast("int").alias("x"), F.expr(f"cast(event_id % {n} div {TILE_W} as int)").alias("y"),
        (F.col("user_id") % 256).cast("int").alias("r"), (k % 256).alias("g"), (e * 37 % 256).cast("int").alias("b"),
    )
    return t.join(t.groupBy("image_id").count().where(F.col("count") == n).select("image_id"), "image_id")


#: So many overlapping views in a row, and in a column, of the plane that all events make; each event is a square of this many pixels a side.
VIEWS, DOT = 3, 2


def views(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """view, x, y, event_id, r, g, b of square views of the events' square plane, and how many events a view has on a side.

    Later events cover earlier ones at the same place; what no event covers is black.
    """
    events = table(spark, sf, "events")
    side = max(1, math.isqrt(max(0, events.count() - 1)) + 1)
    step = 4 * (side // 20)
    size, e, at = side - (VIEWS - 1) * step, F.col("event_id"), F.col("event_id") % (side * side)
    every = F.explode(F.array(*[F.struct(F.lit(VIEWS * j + i).alias("view"), F.lit(i * step).alias("x0"), F.lit(j * step).alias("y0")) for j in range(VIEWS) for i in range(VIEWS)]))
    c = events.select(e, (at % side).alias("px"), F.expr(f"event_id % {side * side} div {side}").alias("py"), *[F.coalesce(v % 256, F.lit(0)).cast("int").alias(k) for k, v in (("r", F.col("user_id")), ("g", F.get_json_object("props", "$.k").cast("int")), ("b", e * 37))])
    c = c.select("*", every.alias("o")).select("o.view", (F.col("px") - F.col("o.x0")).cast("int").alias("x"), (F.col("py") - F.col("o.y0")).cast("int").alias("y"), "event_id", "r", "g", "b")
    return c.where(F.col("x").between(0, size - 1) & F.col("y").between(0, size - 1)), size


def images(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).select("image_id").distinct()


def target(spark: SparkSession, sf: str) -> DataFrame:
    """A 64 x 48 image in 0..1: each pixel is the mean of the events that fall on it."""
    e = table(spark, sf, "events").withColumn("i", (F.col("event_id") - 1) % (64 * 48))
    mean = [(F.avg(c % 256) / 255.0).alias(k) for c, k in ((F.col("user_id"), "r"), (F.col("event_id") * 11, "g"), (F.col("event_id") * 37, "b"))]
    return e.groupBy((F.col("i") % 64).cast("int").alias("x"), F.expr("cast(i div 64 as int)").alias("y")).agg(*mean)


_C = CAMERA
#: Common table expressions of the same fixtures for DuckDB.
CTE = {
    "size": f"SELECT {WIDTH} AS w, greatest(1, count(*) // {WIDTH}) AS h FROM events",
    "depth": f"SELECT 0 AS image_id, event_id % {WIDTH} AS x, event_id // {WIDTH} AS y, value AS d FROM events",
    "mm": "SELECT CASE WHEN lo IS NULL OR lo >= hi THEN 0.0::DOUBLE ELSE lo END AS dmin, CASE WHEN lo IS NULL OR lo >= hi THEN 1.0::DOUBLE WHEN hi = 0 THEN 1.0::DOUBLE ELSE hi END AS dmax FROM (SELECT min(d) FILTER (WHERE d > 0) AS lo, max(d) FILTER (WHERE d > 0) AS hi FROM depth)",
    "nd": "SELECT image_id, x, y, d, CASE WHEN dmax - dmin > 1e-6 THEN (d - dmin) / (dmax - dmin) ELSE 0 END AS n FROM depth, mm",
    "px": f"SELECT 0 AS image_id, event_id % {WIDTH} AS x, event_id // {WIDTH} AS y, user_id % 256 AS r, CAST(json_extract(props, '$.k') AS INT) % 256 AS g, event_id * 37 % 256 AS b, 255 AS a FROM events",
    "gray": f"SELECT 0 AS image_id, event_id % {WIDTH} AS x, event_id // {WIDTH} AS y, event_id * 7919 % 256 AS v FROM events",
    "blocky": f"SELECT 0 AS image_id, event_id % {WIDTH} AS x, event_id // {WIDTH} AS y, CASE WHEN event_id % {WIDTH} % 9 < 2 AND event_id // {WIDTH} % 7 < 2 THEN 200 ELSE 40 END + ((event_id % {WIDTH}) * 7 + (event_id // {WIDTH}) * 13) % 11 AS v FROM events",
    "feat": "SELECT label AS image_id, vec_id AS feat_id, CAST(vec_id * 37 % 640 AS DOUBLE) AS x, CAST(vec_id * 53 % 480 AS DOUBLE) AS y, "
    + ", ".join(f"CAST(list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + {a + 1}] > 0 THEN (1::BIGINT << i) ELSE 0 END)) AS BIGINT) AS d{k}" for k, a in enumerate((0, 32)))
    + " FROM embeddings",
    "pts": "SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS point_id, l_quantity * far AS x, l_extendedprice / 1000.0 AS y, l_discount * 100.0 * far + 1.0 AS z, l_orderkey % 10 / 10.0::DOUBLE AS r, l_partkey % 8 / 8.0::DOUBLE AS g, l_suppkey % 7 / 7.0::DOUBLE AS b FROM (SELECT *, CASE WHEN l_partkey % 500 = 7 THEN 40.0::DOUBLE ELSE 1.0::DOUBLE END AS far FROM lineitem)",
    "ppts": "SELECT p_partkey AS point_id, (p_partkey % 41) / 10.0::DOUBLE - 2.0::DOUBLE AS x, p_size / 20.0::DOUBLE - 1.2::DOUBLE AS y, 2.0 + p_retailprice / 500.0 AS z, p_partkey % 10 / 10.0::DOUBLE AS r, p_partkey % 8 / 8.0::DOUBLE AS g, p_partkey % 7 / 7.0::DOUBLE AS b FROM part",
    "spl": "SELECT p_partkey AS splat_id, (p_partkey % 41) / 10.0::DOUBLE - 2.0::DOUBLE AS x, p_size / 20.0::DOUBLE - 1.2::DOUBLE AS y, 2.0 + p_retailprice / 500.0 AS z, ln((p_size + 1) / 500.0::DOUBLE) AS scale_x, ln((p_size + 5) / 800.0::DOUBLE) AS scale_y, ln(0.03::DOUBLE) AS scale_z, 1.0::DOUBLE AS rot_w, p_partkey % 7 / 10.0::DOUBLE AS rot_x, p_partkey % 5 / 10.0::DOUBLE AS rot_y, p_partkey % 3 / 10.0::DOUBLE AS rot_z, p_partkey % 13 - 6.0::DOUBLE AS opacity_logit, p_partkey % 11 / 5.0::DOUBLE - 1.0::DOUBLE AS sh_dc_r, p_partkey % 9 / 4.0::DOUBLE - 1.0::DOUBLE AS sh_dc_g, p_partkey % 8 / 3.5::DOUBLE - 1.0::DOUBLE AS sh_dc_b FROM part",
    "packed": "SELECT splat_id, x, y, z, " + ", ".join(f"least(greatest(0.5::DOUBLE + 0.28209479::DOUBLE * sh_dc_{c}, 0), 1) AS {c}" for c in "rgb") + ", exp(scale_x) AS scale_x, exp(scale_y) AS scale_y, exp(scale_z) AS scale_z, 1 / (1 + exp(-opacity_logit)) AS opacity FROM spl",
    "frames": "SELECT event_id AS frame_id, user_id AS session, ts, value / 20000.0 AS px, event_id % 17 / 1000.0::DOUBLE AS py, 0.0::DOUBLE AS pz, event_id % 5 / 1000.0::DOUBLE AS fx, 0.0::DOUBLE AS fy, 1.0::DOUBLE AS fz, event_id % 29 - 14.0::DOUBLE AS dx, value % 50 - 20.0::DOUBLE AS dy FROM events",
    "inputs": "SELECT event_id AS frame_id, user_id AS session, ts, string_split('" + KINDS + "', ' ')[event_id * 7 % 12 + 1] AS kind, event_id % 3 AS button, event_id % 7 = 0 AS shift, CAST(event_id * 37 % 640 AS DOUBLE) AS cx, CAST(event_id * 53 % 480 AS DOUBLE) AS cy, event_id * 31 % 700 - 350.0::DOUBLE AS delta, string_split('" + KEYS + "', ' ')[event_id % 8 + 1] AS key, 0.016::DOUBLE + event_id % 5 / 50.0::DOUBLE AS dt FROM events",
    "tiles": f"SELECT * FROM (SELECT event_id // {TILE_W * TILE_H} AS image_id, event_id % {TILE_W * TILE_H} % {TILE_W} AS x, event_id % {TILE_W * TILE_H} // {TILE_W} AS y, user_id % 256 AS r, CAST(json_extract(props, '$.k') AS INT) % 256 AS g, event_id * 37 % 256 AS b, count(*) OVER (PARTITION BY event_id // {TILE_W * TILE_H}) AS n FROM events) WHERE n = {TILE_W * TILE_H}",
    "planes": f"SELECT s, 4 * (s // 20) AS step, s - {VIEWS - 1} * 4 * (s // 20) AS size FROM (SELECT greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS s FROM events)",
    "dots": "SELECT x, y, max_by(r, event_id) AS r, max_by(g, event_id) AS g, max_by(b, event_id) AS b FROM (SELECT event_id, event_id % (s * s) % s AS x, event_id % (s * s) // s AS y, coalesce(user_id % 256, 0) AS r, coalesce(CAST(json_extract(props, '$.k') AS INT) % 256, 0) AS g, event_id * 37 % 256 AS b FROM events, planes) GROUP BY x, y",
    "target": "SELECT i % 64 AS x, i // 64 AS y, avg(user_id % 256) / 255.0::DOUBLE AS r, avg(event_id * 11 % 256) / 255.0::DOUBLE AS g, avg(event_id * 37 % 256) / 255.0::DOUBLE AS b FROM (SELECT *, (event_id - 1) % 3072 AS i FROM events) GROUP BY i",
    # Candidates of descriptor matching, ranked from either side.
    "cand": "SELECT a.image_id AS img_a, b.image_id AS img_b, a.feat_id AS fa, b.feat_id AS fb, bit_count(xor(a.d0, b.d0)) + bit_count(xor(a.d1, b.d1)) AS dist FROM feat a JOIN feat b ON a.image_id < b.image_id",
    "ahead": "SELECT img_a, img_b, fa AS feat, max(fb) FILTER (WHERE k = 1) AS match, max(dist) FILTER (WHERE k = 1) AS best, max(dist) FILTER (WHERE k = 2) AS second FROM (SELECT *, row_number() OVER (PARTITION BY img_a, img_b, fa ORDER BY dist, fb) AS k FROM cand) GROUP BY ALL",
    "back": "SELECT img_a, img_b, fb AS feat, max(fa) FILTER (WHERE k = 1) AS match, max(dist) FILTER (WHERE k = 1) AS best, max(dist) FILTER (WHERE k = 2) AS second FROM (SELECT *, row_number() OVER (PARTITION BY img_a, img_b, fb ORDER BY dist, fa) AS k FROM cand) GROUP BY ALL",
    "mt": "SELECT a.img_a, a.img_b, a.feat AS feat_a, a.match AS feat_b, a.best AS distance FROM ahead a JOIN back b ON a.img_a = b.img_a AND a.img_b = b.img_b AND a.feat = b.match AND a.match = b.feat WHERE a.best < 64 AND a.best < 0.9 * coalesce(a.second, 999999) AND coalesce(a.second, 999999) > 0 AND b.best < 64 AND b.best < 0.9 * coalesce(b.second, 999999) AND coalesce(b.second, 999999) > 0",
    "pairs": "SELECT img_a, img_b, count(*) AS n FROM mt GROUP BY ALL HAVING count(*) >= 8",
    "obs": "SELECT image_id, feat_id, feat_id * 3 AS point_id FROM feat WHERE image_id < 3 AND x < 480",
    # Screen ellipses of the splat fixture under the fixture's camera: it looks along +z, so right is -x and down -y.
    "cov": "SELECT *, 1 - 2 * (qy * qy + qz * qz) AS r00, 2 * (qx * qy - qw * qz) AS r01, 2 * (qx * qz + qw * qy) AS r02, 2 * (qx * qy + qw * qz) AS r10, 1 - 2 * (qx * qx + qz * qz) AS r11, 2 * (qy * qz - qw * qx) AS r12, 2 * (qx * qz - qw * qy) AS r20, 2 * (qy * qz + qw * qx) AS r21, 1 - 2 * (qx * qx + qy * qy) AS r22, exp(2 * scale_x) AS v0, exp(2 * scale_y) AS v1, exp(2 * scale_z) AS v2 FROM (SELECT *, rot_w / q AS qw, rot_x / q AS qx, rot_y / q AS qy, rot_z / q AS qz FROM (SELECT *, sqrt(rot_w * rot_w + rot_x * rot_x + rot_y * rot_y + rot_z * rot_z) AS q FROM spl))",
    "cov6": "SELECT *, " + ", ".join(f"r{i}0 * r{j}0 * v0 + r{i}1 * r{j}1 * v1 + r{i}2 * r{j}2 * v2 AS c{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM cov",
    "proj": f"SELECT splat_id, {_C.focal}::DOUBLE * -x / z + 32 AS screen_x, {_C.focal}::DOUBLE * -y / z + 24 AS screen_y, z AS depth, a * a * c00 + 2 * a * bx * -c02 + bx * bx * c22 + 0.3::DOUBLE AS cov00, a * a * c01 + a * b2 * -c02 + bx * a * -c12 + bx * b2 * c22 AS cov01, a * a * c11 + 2 * a * b2 * -c12 + b2 * b2 * c22 + 0.3::DOUBLE AS cov11, " + ", ".join(f"least(greatest(0.5::DOUBLE + 0.28209479::DOUBLE * sh_dc_{c}, 0), 1) AS {c}" for c in "rgb")
    + f", 1 / (1 + exp(-opacity_logit)) AS opacity FROM (SELECT *, {_C.focal}::DOUBLE / z AS a, {_C.focal}::DOUBLE * x / (z * z) AS bx, {_C.focal}::DOUBLE * y / (z * z) AS b2 FROM cov6 WHERE z > 0.1 AND z < 1000)",
    "rad": "SELECT *, cov00 * cov11 - cov01 * cov01 AS det, 3 * sqrt(0.5 * (cov00 + cov11) + sqrt(greatest(0.1::DOUBLE, 0.25 * (cov00 + cov11) * (cov00 + cov11) - (cov00 * cov11 - cov01 * cov01)))) AS rad FROM proj",
    "vis": "SELECT * FROM rad WHERE opacity >= 1.0::DOUBLE / 255 AND det > 0 AND screen_x + rad >= 0 AND screen_x - rad < 64 AND screen_y + rad >= 0 AND screen_y - rad < 48",
    "box": "SELECT *, greatest(0, CAST(trunc(screen_x - rad) AS BIGINT)) AS min_x, greatest(0, CAST(trunc(screen_y - rad) AS BIGINT)) AS min_y, least(63, CAST(trunc(screen_x + rad) AS BIGINT)) AS max_x, least(47, CAST(trunc(screen_y + rad) AS BIGINT)) AS max_y FROM vis",
    "frag": "SELECT splat_id, x, y, depth, r, g, b, least(0.99::DOUBLE, opacity * exp(p)) AS alpha FROM (SELECT *, -0.5 * (cov11 * dx * dx - 2 * cov01 * dx * dy + cov00 * dy * dy) / det AS p FROM (SELECT *, x + 0.5 - screen_x AS dx, y + 0.5 - screen_y AS dy FROM box JOIN range(64) h(x) ON x BETWEEN min_x AND max_x JOIN range(48) v(y) ON y BETWEEN min_y AND max_y)) WHERE p <= 0 AND p >= -4 AND least(0.99::DOUBLE, opacity * exp(p)) >= 1.0::DOUBLE / 255",
    "image": "SELECT x, y, sum(alpha * t * r) AS r, sum(alpha * t * g) AS g, sum(alpha * t * b) AS b, 1 - min(t * (1 - alpha)) AS a FROM (SELECT *, coalesce(product(1 - alpha) OVER (PARTITION BY x, y ORDER BY depth, splat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS t FROM frag) WHERE t >= 0.004 GROUP BY x, y",
}
