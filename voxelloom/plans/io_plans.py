"""Queries of sources and sinks: files are written to the shared folder first and read back."""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from voxelloom.functions.splat import MEAN, STD
from voxelloom.operators import features as K
from voxelloom.operators import imports as I
from voxelloom.operators import models as M
from voxelloom.operators import scene as O
from voxelloom.plans import fixtures as X
from voxelloom.plans.registry import query
from voxelloom.session import shared_dir, ship
from voxelloom.sources import fetch as FE
from voxelloom.sources import files as S
from voxelloom.sources import scenes as SC

def _address(path: str) -> str:
    return path if ":" in path.split("/", 1)[0] else f"file://{path}"


F32 = "x y z scale_x scale_y scale_z rot_w rot_x rot_y rot_z opacity_logit sh_dc_r sh_dc_g sh_dc_b"


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _float_splats(spark, sf):
    s = X.splats(spark, sf)
    return s.select("splat_id", *[F.col(c).cast("float").alias(c) for c in F32.split()])


@query("SELECT " + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in F32.split()) + " FROM spl", reals=F32)
def src_ply(spark, sf):
    path = _folder(spark, "ply")
    S.save_scene(_float_splats(spark, sf), path, "ply")
    return spark.read.format("ply").load(path)


@query("SELECT CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, CAST(scale_x AS FLOAT) AS scale_x FROM spl", reals="x y z scale_x")
def src_splat(spark, sf):
    path = _folder(spark, "splat")
    S.save_scene(_float_splats(spark, sf), path, "splat")
    return spark.read.format("splat").load(path)


@query("SELECT count(*) AS n, max(CAST(z AS FLOAT)) AS far_z FROM spl", ints="n", reals="far_z")
def snk_export(spark, sf):
    path = _folder(spark, "export")
    S.save_scene(_float_splats(spark, sf), path, "ply")
    return spark.read.format("ply").load(path).agg(F.count("*").alias("n"), F.max("z").alias("far_z"))


@query("SELECT count(*) AS n FROM spl", ints="n")
def src_file(spark, sf):
    path = _folder(spark, "scene")
    S.save_scene(_float_splats(spark, sf).coalesce(1), path, "splat")
    return S.load_scene(spark, f"{path}/part-00000.splat").agg(F.count("*").alias("n"))


def _text_ply(spark, sf):
    """Text PLY files of ``part``, one per partition, with an extra property, a byte colour, no rotation, and some values that are no numbers."""
    path, p = _folder(spark, "text"), X.part_points(spark, sf)
    text = lambda c: F.col(c).cast("string")
    odd = F.when(F.col("point_id") % 5 == 0, F.lit("oops")).otherwise(F.col("point_id").cast("double").cast("string"))
    lines = p.select("point_id", F.concat_ws(" ", text("point_id"), text("x"), text("y"), F.lit("9"), (F.col("point_id") % 256).cast("string"), odd).alias("value"))

    def files(frames):
        rows = [v for pdf in frames for v in pdf["value"]]
        head = f"ply\nformat ascii 1.0\ncomment made\nelement vertex {len(rows)}\nproperty double rot_0\nproperty float x\nproperty float y\nproperty float extra\nproperty uchar f_dc_0\nproperty double opacity\nend_header"
        if rows:
            yield pd.DataFrame({"value": [*head.split("\n"), *rows, "more after the last vertex"]})

    lines.repartition(3, "point_id").select("value").mapInPandas(files, "value string").write.text(path)
    return path


@query("SELECT CAST(CAST(point_id AS FLOAT) AS DOUBLE) AS rot_w, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST((point_id % 256) / 255.0 AS FLOAT) AS sh_dc_r, CASE WHEN point_id % 5 = 0 THEN 0 ELSE point_id END AS opacity_logit, 0 AS z FROM ppts", reals="rot_w x y sh_dc_r opacity_logit z")
def src_ply_ascii(spark, sf):
    return SC.text_scene(spark, _text_ply(spark, sf))


_KINDS = ("float x", "float y", "uchar red", "double opacity", "short label")


def _header_text():
    """A binary header for each row of ``part``: as many vertices as its key, and its first properties by size."""
    n = (F.col("p_size") % 5 + 1).cast("int")
    props = F.transform(F.slice(F.array(*[F.lit(k) for k in _KINDS]), F.lit(1), n), lambda k: F.concat(F.lit("property "), k))
    lines = [F.lit("ply"), F.lit("format binary_little_endian 1.0"), F.concat(F.lit("element vertex "), F.col("p_partkey").cast("string")), props, F.lit("end_header"), F.lit("")]
    return F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("\r\n", *lines)).otherwise(F.concat_ws("\n", *lines))


@query(
    "SELECT p_partkey AS id, p_partkey AS n, p_size % 5 + 1 AS props, [4, 8, 9, 17, 19][p_size % 5 + 1] AS stride, "
    "59 + length(CAST(p_partkey AS VARCHAR)) + [16, 32, 50, 73, 93][p_size % 5 + 1] + (p_size % 5 + 5) * (CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END) AS start FROM part",
    ints="id n props stride start",
)
def src_ply_hdr(spark, sf):
    from voxelloom.session import table
    from voxelloom.sources.ply import Header

    def run(frames):
        for pdf in frames:
            hs = [Header(t.encode()) for t in pdf["head"]]
            yield pd.DataFrame({"id": pdf["p_partkey"], "n": [h.count for h in hs], "props": [len(h.props) for h in hs], "stride": [h.dtype.itemsize for h in hs], "start": [h.start for h in hs]})

    heads = table(spark, sf, "part").select("p_partkey", _header_text().alias("head"))
    return heads.mapInPandas(run, "id long, n long, props int, stride int, start int")


@query("SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' || value ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0) AS v FROM events", ints="event_id", reals="v")
def src_ply_val(spark, sf):
    from voxelloom.session import table

    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", F.coalesce(text.try_cast("double"), F.lit(0.0)).alias("v"))


_SETS = ", ".join(f"({i}, '{n}')" for i, n in enumerate((*S.SETS, "Other")))
_NUMBERS = " UNION ALL ".join(f"SELECT '{k}' AS name, '{p}' || lpad(CAST(i AS VARCHAR), {d}, '0') || '{e}' AS file_name FROM range{s} g(i)" for k, (p, s, d, e) in (S.SETS | {"Other": ("other_", (1, 15, 1), 2, ".jpg")}).items())


@query(f"SELECT file_name, n FROM (SELECT name, count(*) AS n FROM supplier JOIN (VALUES {_SETS}) s(i, name) ON s_suppkey % 6 = i GROUP BY name) JOIN ({_NUMBERS}) USING (name)", ints="n", other="file_name")
def src_dataset(spark, sf):
    """Files of the sets that suppliers are dealt to, with how many share them."""
    from voxelloom.session import table

    names = F.array(*[F.lit(n) for n in (*S.SETS, "Other")])
    sets = table(spark, sf, "supplier").select(F.get(names, (F.col("s_suppkey") % 6).cast("int")).alias("set")).groupBy("set").agg(F.count("*").alias("n"))
    return S.sample_lists(sets).join(sets, "set").select("file_name", "n")


def _lines(spark, sf):
    from voxelloom.session import table

    p = table(spark, sf, "part")
    i = F.col("p_partkey").cast("string")
    row = F.concat_ws(" ", F.concat(F.lit("templeR"), F.lpad(i, 4, "0"), F.lit(".png")), F.lit("1520.4 0 302.32 0 1525.9 246.87 0 0 1 1 0 0 0 1 0 0 0 1"), i, F.lit("0.5"), F.lit("-2"))
    return spark.createDataFrame([("40",)], "value string").unionByName(p.select(row.alias("value")))


@query("SELECT 'templeR' || lpad(CAST(p_partkey AS VARCHAR), 4, '0') || '.png' AS name, 1520.4 AS fx, 302.32 AS cx, 1 AS r00, p_partkey AS t0, -2 AS t2 FROM part", reals="fx cx r00 t0 t2", other="name")
def src_calib(spark, sf):
    c = S.calibration(_lines(spark, sf))
    return c.select("name", F.col("k")[0].alias("fx"), F.col("k")[2].alias("cx"), F.col("r")[0].alias("r00"), F.col("t")[0].alias("t0"), F.col("t")[2].alias("t2"))


@query("SELECT 'templeR' || lpad(CAST(i AS VARCHAR), 4, '0') || '.png' AS file_name, CASE WHEN i < 10 THEN i END AS t0 FROM range(1, 17) g(i)", reals="t0", other="file_name")
def j_calib(spark, sf):
    truth = S.calibration(_lines(spark, sf)).where(F.col("t")[0] < 10)
    return S.with_truth(S.sample_names(spark, "TempleRing"), truth).select("file_name", F.col("t")[0].alias("t0"))


@query("SELECT point_id, sqrt((x - 1.1 * x) ** 2 + 0.01) AS gap FROM ppts WHERE point_id % 4 = 0", ints="point_id", reals="gap")
def j_gt(spark, sf):
    a = X.part_points(spark, sf)
    b = a.where("point_id % 4 = 0").select("point_id", (F.col("x") * 1.1).alias("ox"), (F.col("y") + 0.1).alias("oy"))
    d = F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2)
    return a.join(b, "point_id").select("point_id", F.sqrt(d).alias("gap"))


def png(width: int, height: int, rgb: bytes) -> bytes:
    """A plain 8-bit RGB PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + rgb[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _put(name: str, data: bytes) -> None:
    """A whole file or none; an attempt that is run again does no harm."""
    with open(f"{name}.{os.getpid()}", "wb") as f:
        f.write(data)
    os.replace(f"{name}.{os.getpid()}", name)


def _files(spark, sf):
    """A folder of the picture fixture's files, written where their rows are, and of one file that is no picture."""
    path = _folder(spark, "images")
    local = path.removeprefix("file://")
    os.makedirs(local)
    order = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b")))
    rows = X.tiles(spark, sf).groupBy("image_id").agg(order.alias("p")).select("image_id", "p.r", "p.g", "p.b")

    def save(batches):
        for t in batches:
            rgb = np.stack([t[c].flatten().to_numpy() for c in "rgb"], 1).astype(np.uint8).reshape(len(t), -1)  # whole pictures, so of one length
            for i, p in zip(t["image_id"].to_pylist(), rgb):
                _put(f"{local}/p{i}.png", png(X.TILE_W, X.TILE_H, p.tobytes()))
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(t)], pa.int64())})

    ship(spark)
    if not rows.mapInArrow(save, "n long").agg(F.sum("n")).first()[0]:
        raise ValueError("too few events for a picture")
    with open(f"{local}/bad.png", "wb") as f:
        f.write(b"not a picture")
    return path


def _numbered(images):
    """Images under their fixture's number instead of their name's hash."""
    return images.withColumn("image_id", F.regexp_extract("file_name", r"p(\d+)[^/]*$", 1).cast("long"))


@query("SELECT * EXCLUDE (n) FROM tiles", ints="image_id x y r g b")
def src_img(spark, sf):
    return S.pixels(_numbered(S.images(spark, _files(spark, sf))))


def _view_files(spark, sf, local):
    """Pictures of the overlapping views: rows of pixels first, then a picture's rows."""
    seen, size = X.views(spark, sf)
    row = F.array_sort(F.collect_list(F.struct("x", "event_id", "r", "g", "b")))  # of one place the latest comes last
    strips = seen.groupBy("view", "y").agg(row.alias("p")).select("view", "y", "p.x", "p.r", "p.g", "p.b")

    def strip(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                a = np.zeros((size, 3), np.uint8)
                a[r.x] = np.stack([r.r, r.g, r.b], 1)
                out.append((r.view, r.y, a.tobytes()))
            yield pd.DataFrame(out, columns=["view", "y", "row"])

    def save(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                a = np.zeros((size, size, 3), np.uint8)
                for y, v in zip(r.y, r.row):
                    a[y] = np.frombuffer(v, np.uint8).reshape(size, 3)
                _put(f"{local}/v{r.view}.png", png(X.DOT * size, X.DOT * size, a.repeat(X.DOT, 0).repeat(X.DOT, 1).tobytes()))
            yield pd.DataFrame({"n": [len(pdf)]})

    rows = strips.mapInPandas(strip, "view int, y int, row binary").groupBy("view").agg(F.collect_list(F.struct("y", "row")).alias("p"))
    rows.select("view", "p.y", "p.row").mapInPandas(save, "n long").agg(F.sum("n")).first()


def _import_files(spark, sf):
    """The picture fixture's files, views that overlap, a picture that is no image by its name, and one of more bytes than the limit."""
    path = _files(spark, sf)
    local = path.removeprefix("file://")
    _view_files(spark, sf, local)
    dot = png(1, 1, b"\0\0\0")
    _put(f"{local}/notes.txt", dot)
    _put(f"{local}/large.png", dot)
    os.truncate(f"{local}/large.png", S.MAX_IMAGE + 1)
    return path


_SIDE = f"CASE WHEN {X.DOT} * size > {S.MAX_SIDE} THEN CAST(trunc(CAST({X.DOT} * size AS FLOAT) * ({S.MAX_SIDE}::FLOAT / CAST({X.DOT} * size AS FLOAT))) AS BIGINT) ELSE {X.DOT} * size END"
_AT_EVENT = lambda k: f"least(CAST(trunc(CAST({k} AS FLOAT) * (CAST({X.DOT} * size AS FLOAT) / CAST(w AS FLOAT))) AS BIGINT), {X.DOT} * size - 1) // {X.DOT}"
#: Neighbours by one number for view, row and column: a row is 2,048 pixels, more than any side.
_RING = ", ".join(f"({i}, {dy * 2048 + dx})" for i, (dx, dy) in enumerate(K.CIRCLE))
_TESTS = ", ".join(f"({i}, {b * 2048 + a}, {d * 2048 + c})" for i, (a, b, c, d) in enumerate(K.test_pairs().tolist()))
_NINE = lambda test: f"SELECT DISTINCT view, x, y FROM (SELECT view, x, y, sum(CASE WHEN {test} THEN 1 ELSE 0 END) OVER (PARTITION BY view, x, y ORDER BY i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS run FROM (SELECT * FROM v_pp UNION ALL SELECT view, x, y, v, i + 16, p FROM v_pp)) WHERE run = 9"
_BITS = lambda w: f"coalesce(sum(CASE WHEN bit AND i // 64 = {w} THEN 1::HUGEINT << (i % 64)::INT ELSE 0 END), 0)"
_SIGN = lambda c: f"CAST(CASE WHEN {c} >= 9223372036854775808 THEN {c} - 18446744073709551616 ELSE {c} END AS BIGINT) AS {c}"
_NEAREST = lambda own, other: f"SELECT a, b, f{own} AS f, max(f{other}) FILTER (WHERE k = 1) AS m, max(dist) FILTER (WHERE k = 1) AS best, coalesce(max(dist) FILTER (WHERE k = 2), 999999) AS second FROM (SELECT *, row_number() OVER (PARTITION BY a, b, f{own} ORDER BY dist, f{other}) AS k FROM v_cand) GROUP BY a, b, f{own}"
#: The import step by step over views alone: other pictures have no pixel inside the margin of four.
_IMPORT = {
    "v_size": f"SELECT *, {_SIDE} AS w FROM planes, range({X.VIEWS * X.VIEWS}) r(view)",
    "v_px": f"SELECT view, w, x, y, (view * 2048 + y) * 2048 + x AS at, (coalesce(r, 0) * 77 + coalesce(g, 0) * 150 + coalesce(b, 0) * 29) >> 8 AS v FROM (SELECT view, w, x, y, view % {X.VIEWS} * step + {_AT_EVENT('x')} AS ex, view // {X.VIEWS} * step + {_AT_EVENT('y')} AS ey FROM v_size, range((SELECT max(w) FROM v_size)) h(x), range((SELECT max(w) FROM v_size)) u(y)) q LEFT JOIN (SELECT x AS ex, y AS ey, r, g, b FROM dots) d USING (ex, ey)",
    "v_all": f"SELECT c.view, c.x, c.y, c.v, k.i, n.v AS p FROM v_px c JOIN (VALUES {_RING}) k(i, off) ON c.x BETWEEN 4 AND c.w - 5 AND c.y BETWEEN 4 AND c.w - 5 JOIN v_px n ON n.at = c.at + k.off",
    "v_pp": "SELECT q.* FROM v_all q SEMI JOIN (SELECT view, x, y FROM v_all WHERE i IN (0, 4, 8, 12) GROUP BY view, x, y HAVING count(*) FILTER (WHERE p > v + 25) >= 3 OR count(*) FILTER (WHERE p < v - 25) >= 3) f ON q.view = f.view AND q.x = f.x AND q.y = f.y",
    "v_score": f"SELECT view, x, y, CASE WHEN bright THEN bs ELSE ds END AS score FROM (SELECT view, x, y, min(p - v - 25) FILTER (WHERE p - v > 25) AS bs, min(v - p - 25) FILTER (WHERE v - p > 25) AS ds FROM v_pp GROUP BY view, x, y) s LEFT JOIN (SELECT *, true AS bright FROM ({_NINE('p - v > 25')})) n USING (view, x, y) LEFT JOIN (SELECT *, true AS dark FROM ({_NINE('v - p > 25')})) m USING (view, x, y) WHERE bright OR dark",
    "v_top": f"SELECT *, row_number() OVER (PARTITION BY view ORDER BY score DESC, y, x) - 1 AS id FROM (SELECT * FROM v_score QUALIFY row_number() OVER (PARTITION BY view, x // 8, y // 8 ORDER BY score DESC, y, x) = 1) QUALIFY id < {K.MOST}",
    "v_ask": f"SELECT k.view, k.id, k.i, p.v < q.v AS bit FROM (SELECT f.view, f.id, i, (f.view * 2048 + f.y) * 2048 + f.x + one AS one, (f.view * 2048 + f.y) * 2048 + f.x + two AS two FROM v_top f JOIN v_size z ON z.view = f.view AND f.x BETWEEN 15 AND w - 16 AND f.y BETWEEN 15 AND w - 16, (VALUES {_TESTS}) t(i, one, two)) k JOIN v_px p ON p.at = k.one JOIN v_px q ON q.at = k.two",
    "v_feat": f"SELECT view, id, {', '.join(_SIGN(f'd{i}') for i in range(4))} FROM (SELECT t.view, t.id, {', '.join(f'{_BITS(i)} AS d{i}' for i in range(4))} FROM v_top t LEFT JOIN v_ask k ON k.view = t.view AND k.id = t.id GROUP BY t.view, t.id)",
    "v_cand": f"SELECT a.view AS a, b.view AS b, a.id AS fa, b.id AS fb, {' + '.join(f'CAST(bit_count(xor(a.d{i}, b.d{i})) AS INT)' for i in range(4))} AS dist FROM v_feat a JOIN v_feat b ON a.view < b.view",
    "v_near": _NEAREST("a", "b"),
    "v_back": _NEAREST("b", "a"),
    "v_pair": "SELECT n.a, n.b, count(*) AS n FROM v_near n JOIN v_back m ON n.a = m.a AND n.b = m.b AND n.f = m.m AND n.m = m.f WHERE n.best < 64 AND n.best < 0.75 * n.second AND n.second > 0 AND m.best < 64 AND m.best < 0.75 * m.second AND m.second > 0 GROUP BY n.a, n.b HAVING count(*) >= 8",
}
_IMPORTED = (
    f"SELECT DISTINCT 'p' || image_id || '.png' AS file_name, NULL AS other, {X.TILE_W} AS width, {X.TILE_H} AS height, 0 AS n FROM tiles "
    f"UNION ALL SELECT 'v' || view || '.png', NULL, {X.DOT} * size, {X.DOT} * size, count(id) FROM v_size LEFT JOIN v_feat USING (view) GROUP BY view, size "
    "UNION ALL SELECT 'v' || a || '.png', 'v' || b || '.png', NULL, NULL, n FROM v_pair"
)


@query("SELECT * FROM (WITH " + ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in _IMPORT.items()) + f" {_IMPORTED})", ints="width height n", other="file_name other")
def src_import(spark, sf):
    """Every image with its number of features, then every pair with its number of matches; files that are no pictures, or too large, are left out."""
    images, features, matches = I.import_images(spark, _import_files(spark, sf))
    name = images.select("image_id", F.substring_index("file_name", "/", -1).alias("name"), "width", "height")
    own = name.join(features.groupBy("image_id").agg(F.count("*").alias("n")), "image_id", "left")
    own = own.select(F.col("name").alias("file_name"), F.lit(None).cast("string").alias("other"), "width", "height", F.coalesce("n", F.lit(0)).alias("n"))
    a, b = (name.select(F.col("image_id").alias(f"img_{k}"), F.col("name").alias(k)) for k in "ab")
    pairs = matches.groupBy("img_a", "img_b").agg(F.count("*").alias("n")).join(a, "img_a").join(b, "img_b")
    none = F.lit(None).cast("int")
    return own.unionByName(pairs.select(F.least("a", "b").alias("file_name"), F.greatest("a", "b").alias("other"), none.alias("width"), none.alias("height"), "n"))


@query("SELECT 'p' || image_id || '.png' AS file_name FROM (SELECT DISTINCT image_id FROM tiles) ORDER BY file_name LIMIT 20", other="file_name")
def src_img_ui(spark, sf):
    """What a person may pick: the first 20 files under the size limit, less the one that is no picture."""
    files = S.images(spark, _files(spark, sf).rstrip("/") + "/p*.png", most_files=S.MAX_FILES)
    return files.select(F.substring_index("file_name", "/", -1).alias("file_name"))


@query(f"SELECT page_id, page_id % 7 < 5 AS found, CASE WHEN page_id % 7 = 5 THEN 'FileNotFoundError' WHEN page_id % 7 = 6 THEN 'not an address' END AS error, CASE WHEN page_id % 7 < 5 THEN {X.TILE_W} END AS width FROM pages", ints="page_id width", other="found error")
def src_img_url(spark, sf):
    """Every page's picture by its address; some are not there, some are no address."""
    from voxelloom.session import table

    folder, k = _address(_files(spark, sf)), F.col("page_id") % 7
    url = F.when(k < 5, F.concat(F.lit(folder + "/p"), (F.col("page_id") % 3).cast("string"), F.lit(".png"))).when(k == 5, F.lit(folder + "/none.png")).otherwise(F.lit("mailto:someone"))
    got = FE.fetched(table(spark, sf, "pages").select("page_id", url.alias("url")), tries=2, wait=0.01)
    width = F.conv(F.hex(F.substring("content", 17, 4)), 16, 10).cast("long")
    return got.select("page_id", F.col("content").isNotNull().alias("found"), "error", width.alias("width"))


@query("SELECT CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z FROM spl", reals="x y z")
def src_demo(spark, sf):
    """A scene by its address: fetched, then read by the table function."""
    path = _folder(spark, "demo")
    S.save_scene(_float_splats(spark, sf).coalesce(1), path, "ply")
    got = FE.fetched(spark.createDataFrame([(_address(f"{path}/part-00000.ply"),)], "url string"), most=S.MAX_SCENE)
    return SC.parsed(got.select("content"), "content")


_SCALED = "((({v}) / 255.0::DOUBLE) - {m}::DOUBLE) / {s}::DOUBLE"
_SEEN = " + ".join(_SCALED.format(v=f"s.{v}", m=m, s=s) for v, m, s in zip("rgb", MEAN, STD))


def _decoded(spark, sf):
    return _numbered(S.images(spark, _files(spark, sf)))


_DEPTH = f"SELECT t.image_id, t.x, t.y, ({_SEEN}) / 3 AS d FROM tiles t JOIN tiles s ON s.image_id = t.image_id AND s.x = t.x * {M.SIDE} // {X.TILE_W} * {X.TILE_W} // {M.SIDE} AND s.y = t.y * {M.SIDE} // {X.TILE_H} * {X.TILE_H} // {M.SIDE}"
_RANGED = f"SELECT *, min(d) FILTER (WHERE d > 0) OVER (PARTITION BY image_id) AS lo, max(d) FILTER (WHERE d > 0) OVER (PARTITION BY image_id) AS hi FROM ({_DEPTH})"


@query(f"SELECT image_id, x, y, d, CASE WHEN lo < hi THEN lo ELSE 0 END AS dmin, CASE WHEN lo < hi THEN hi ELSE 1 END AS dmax FROM ({_RANGED})", ints="image_id x y", reals="d dmin dmax")
def n_depth(spark, sf):
    return M.estimate_depth(_decoded(spark, sf))


@query(f"SELECT image_id, x * 2 + i AS x, y * 2 + j AS y, r, g, b FROM tiles, range(2) h(i), range(2) v(j)", ints="image_id x y r g b")
def n_sr(spark, sf):
    return S.pixels(M.upscale(_decoded(spark, sf)))


def _binaries(spark, sf, size: int = 50):
    """file_id, content: splats of ``part`` packed into binaries, even ones headerless, odd ones PLY."""
    from voxelloom.sources.ply import PROPERTIES
    from voxelloom.sources.splat import encode

    cols = F32.split()

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("splat_id")
        k = t["file_id"][0].as_py()
        if k % 2 == 0:
            data = encode(t)
        else:
            rows = np.stack([t[c].to_numpy().astype("<f4") for c in cols], 1)
            data = ("ply\nformat binary_little_endian 1.0\nelement vertex %d\n" % len(t) + "".join(f"property float {p}\n" for p in PROPERTIES) + "end_header\n").encode() + rows.tobytes()
        return pa.table({"file_id": pa.array([k], pa.int64()), "content": pa.array([data], pa.binary())})

    s = _float_splats(spark, sf).withColumn("file_id", F.expr(f"splat_id div {size}"))
    return s.groupBy("file_id").applyInArrow(pack, "file_id long, content binary")


_BYTE = lambda v: f"least(greatest(round(({v}) * 255), 0), 255)"


@query(
    "SELECT splat_id // 50 AS file_id, row_number() OVER (PARTITION BY splat_id // 50 ORDER BY splat_id) - 1 AS splat_id, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, CAST(scale_x AS FLOAT) AS scale_x, "
    + f"CASE WHEN splat_id // 50 % 2 = 0 THEN {_BYTE('0.5::DOUBLE + 0.28209479::DOUBLE * sh_dc_r')} ELSE round((0.5::DOUBLE + 0.28209479::DOUBLE * sh_dc_r) * 255) END AS red FROM spl",
    ints="file_id splat_id red", reals="x y z scale_x",
)
def parse_splat(spark, sf):
    """Binary columns, one with a header and one without, as rows of splats by a lateral join."""
    rows = SC.parsed(_binaries(spark, sf), "content")
    return rows.select("file_id", "splat_id", "x", "y", "z", "scale_x", F.round((0.5 + 0.28209479 * F.col("sh_dc_r").cast("double")) * 255).alias("red"))


@query("SELECT count(*) * 24 AS bytes FROM spl", ints="bytes")
def snk_pack24(spark, sf):
    from voxelloom.sources.splat import pack24

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"v": [pack24(pa.Table.from_pandas(pdf))]})

    return O.pack10(X.splats(spark, sf)).mapInPandas(run, "v binary").agg(F.sum(F.length("v")).alias("bytes"))
