"""Scene, image, calibration and sample-set readers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.session import ship

MAX_SCENE, MAX_IMAGE, MAX_FILES = 500 << 20, 50 << 20, 20
#: Endings of files that are images by their type, and the longest side in which features are sought.
KINDS, MAX_SIDE = ("png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp"), 1024


def register(spark: SparkSession) -> None:
    from voxelloom.sources.ply import PlySource
    from voxelloom.sources.splat import SplatSource

    ship(spark)
    spark.dataSource.register(PlySource)
    spark.dataSource.register(SplatSource)


def _bytes_of(spark: SparkSession, path: str) -> int | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else None


def load_scene(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Splats of a .ply or .splat file, by its ending; ``most`` bytes, such as ``MAX_SCENE`` for one that a viewer is to hold.

    Text files are split by bytes; binary ones are read by range where the folder is mounted, else whole through Spark's readers.
    """
    from voxelloom.sources import scenes

    register(spark)
    kind = path.lower().rsplit(".", 1)[-1]
    if kind not in ("ply", "splat"):
        raise ValueError(f"unknown scene format: {path}")
    size = _bytes_of(spark, path)
    if most is not None and size is not None and size > most:
        raise ValueError(f"{path}: {size} bytes, more than {most}")
    if size is not None and kind == "ply" and scenes.header_of(spark, path).format == "ascii":
        return scenes.text_scene(spark, path)
    if "://" in path and not path.startswith("file:"):
        return scenes.binary_scene(spark, path)
    return spark.read.format(kind).load(path)


def save_scene(splats: DataFrame, folder: str, kind: str = "ply") -> None:
    register(splats.sparkSession)
    splats.write.format(kind).mode("overwrite").save(folder)


def images(spark: SparkSession, path: str, most_bytes: int | None = MAX_IMAGE, most_files: int | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """image_id (in order of names), file_name, width, height, n_channels, data. Unreadable files are skipped, and larger ones than ``most_bytes``.

    ``most_files``: that many first names alone, such as ``MAX_FILES`` where a person picks them. ``kinds``: files with these endings alone.
    """
    reader = spark.read.format("image").option("dropInvalid", True)
    listed = spark.read.format("binaryFile").load(path).select("path", "length")  # no content is read
    if kinds is not None:
        listed = listed.where(F.lower(F.substring_index("path", ".", -1)).isin(*kinds))
    if most_bytes is not None or most_files is not None or kinds is not None:
        few = listed.where(F.lit(True) if most_bytes is None else F.col("length") <= most_bytes)
        if most_files is not None:
            few = few.orderBy("path").limit(most_files)
    raw = reader.load(path).select("image.*")
    if most_bytes is not None or most_files is not None or kinds is not None:
        plain = lambda c: F.regexp_replace(c, r"^(\w+):/+", "$1:/")
        raw = raw.join(few.select(plain(F.col("path")).alias("_path")), plain(F.col("origin")) == F.col("_path"), "left_semi")
    return raw.select(F.xxhash64("origin").alias("image_id"), F.col("origin").alias("file_name"), "width", "height", F.col("nChannels").alias("n_channels"), "data")


#: Rows of one frame that goes back to the JVM: a frame costs about a millisecond, so small images share one.
ROWS = 1 << 16


def gathered(parts: Iterator[dict[str, object]]) -> Iterator[pd.DataFrame]:
    """Columns of one image each (arrays, or a value for all of it) as frames of about ``ROWS`` rows; larger images are cut."""
    columns: dict[str, list[np.ndarray]] = {}
    n = 0
    for part in parts:
        size = max(len(v) for v in part.values() if isinstance(v, np.ndarray))
        for a in range(0, size, ROWS):
            for k, v in part.items():
                columns.setdefault(k, []).append(v[a : a + ROWS] if isinstance(v, np.ndarray) else np.full(min(ROWS, size - a), v))
            n += min(ROWS, size - a)
            if n >= ROWS:
                yield pd.DataFrame({k: np.concatenate(v) for k, v in columns.items()})
                columns, n = {}, 0
    if n:
        yield pd.DataFrame({k: np.concatenate(v) for k, v in columns.items()})


def _pixels(frames):
    def each():
        for pdf in frames:
            for r in pdf.itertuples():
                raw = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.n_channels)
                y, x = np.mgrid[: r.height, : r.width]
                bgr = raw[..., :3] if r.n_channels >= 3 else np.repeat(raw[..., :1], 3, axis=2)
                alpha = raw[..., 3] if r.n_channels == 4 else np.full(raw.shape[:2], 255)
                yield {"image_id": r.image_id, "x": x.ravel(), "y": y.ravel(), "r": bgr[..., 2].ravel(), "g": bgr[..., 1].ravel(), "b": bgr[..., 0].ravel(), "a": alpha.ravel()}

    yield from gathered(each())


def pixels(decoded: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b, a: the image source keeps blue first."""
    ship(decoded.sparkSession)
    return decoded.mapInPandas(_pixels, "image_id long, x int, y int, r int, g int, b int, a int")


def _gray(r, most: int) -> tuple[int, int, bytes]:
    """Width, height and bytes of an image as grey, at nearest pixels where a side is longer than ``most``; sizes in single precision, as in the reference."""
    one, w, h = np.float32, r.width, r.height
    if max(w, h) > most:
        scale = one(most) / one(max(w, h))
        w, h = int(one(w) * scale), int(one(h) * scale)
    if not w or not h:
        return 0, 0, b""
    at = lambda n, size: np.minimum((np.arange(n, dtype=one) * (one(size) / one(n))).astype(int), size - 1)
    raw = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.n_channels)
    raw = raw[at(h, r.height)][:, at(w, r.width)].astype(np.uint16)
    v = (raw[..., 2] * 77 + raw[..., 1] * 150 + raw[..., 0] * 29) >> 8 if r.n_channels >= 3 else raw[..., 0]
    return w, h, v.astype(np.uint8).tobytes()


def grays(decoded: DataFrame, most: int = MAX_SIDE) -> DataFrame:
    """image_id, file_name, full_width, full_height, and width, height and gray (bytes) of what features are sought in."""
    ship(decoded.sparkSession)

    def run(frames):
        for pdf in frames:
            rows = [(r.image_id, r.file_name, r.width, r.height, *_gray(r, most)) for r in pdf.itertuples()]
            yield pd.DataFrame(rows, columns=["image_id", "file_name", "full_width", "full_height", "width", "height", "gray"])

    return decoded.mapInPandas(run, "image_id long, file_name string, full_width int, full_height int, width int, height int, gray binary")


def gray_pixels(grey: DataFrame) -> DataFrame:
    """image_id, width, height, x, y, v of every pixel of :func:`grays`."""
    ship(grey.sparkSession)

    def run(frames):
        def each():
            for pdf in frames:
                for r in pdf.itertuples():
                    y, x = np.mgrid[: r.height, : r.width]
                    yield {"image_id": r.image_id, "width": r.width, "height": r.height, "x": x.ravel(), "y": y.ravel(), "v": np.frombuffer(r.gray, np.uint8)}

        yield from gathered(each())

    return grey.mapInPandas(run, "image_id long, width int, height int, x int, y int, v int")


def calibration(lines: DataFrame) -> DataFrame:
    """name, k, r, t from lines (column value) of 22 tokens; shorter ones, such as the count, are skipped."""
    w = lines.select(F.split(F.trim("value"), r"\s+").alias("w")).where(F.size("w") >= 22)
    num = lambda a, n: F.transform(F.slice("w", a, n), lambda v: v.try_cast("double"))
    return w.select(F.col("w")[0].alias("name"), num(2, 9).alias("k"), num(11, 9).alias("r"), num(20, 3).alias("t"))


#: Sample sets: prefix, numbers (start, stop, step), digits, ending.
SETS = {"Skull": ("skull_", (1, 76, 3), 2, ".jpg"), "Bathroom": ("bathroom_", (1, 36, 1), 2, ".jpg"), "TempleRing": ("templeR", (1, 17, 1), 4, ".png"), "DinoSparseRing": ("dinoSR", (1, 17, 1), 4, ".png"), "SouthBuilding": ("south_", (1, 23, 1), 2, ".jpg")}


def sample_lists(names: DataFrame) -> DataFrame:
    """set, file_name of every set in a table of names (column ``set``); an unknown set has fourteen numbered images."""
    spark = names.sparkSession
    known = spark.createDataFrame([(k, p, *s, d, e) for k, (p, s, d, e) in SETS.items()], "set string, prefix string, start int, stop int, step int, digits int, ending string")
    j = names.select("set").distinct().join(F.broadcast(known), "set", "left")  # the known sets
    own = j.select("set", F.coalesce("prefix", F.concat(F.lower("set"), F.lit("_"))).alias("prefix"), F.coalesce("digits", F.lit(2)).alias("digits"), F.coalesce("ending", F.lit(".jpg")).alias("ending"),
                   F.explode(F.sequence(F.coalesce("start", F.lit(1)), F.coalesce("stop", F.lit(15)) - 1, F.coalesce("step", F.lit(1)))).alias("i"))
    return own.select("set", F.concat("prefix", F.lpad(F.col("i").cast("string"), F.col("digits"), F.lit("0")), "ending").alias("file_name"))


def sample_names(spark: SparkSession, name: str) -> DataFrame:
    """File names of a sample set; an unknown set has fourteen numbered images."""
    prefix, span, digits, ending = SETS.get(name, (name.lower() + "_", (1, 15, 1), 2, ".jpg"))
    return spark.range(*span).select(F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), digits, "0"), F.lit(ending)).alias("file_name"))


def intrinsics(images_: DataFrame) -> DataFrame:
    """fx, cx, cy by file-name prefix where the set is known, else 1.2 times the longer side and the middle."""
    n = F.lower("file_name")
    temple, dino = n.startswith("templer"), n.startswith("dinosr")
    pick = lambda a, b, c: F.when(temple, a).when(dino, b).otherwise(c)
    return images_.select("file_name", pick(1520.4, 3310.4, 1.2 * F.greatest("width", "height")).alias("fx"), pick(302.32, 316.73, F.col("width") / 2.0).alias("cx"), pick(246.87, 200.55, F.col("height") / 2.0).alias("cy"))


def with_truth(images_: DataFrame, truth: DataFrame) -> DataFrame:
    """Images with their calibration, null where there is none."""
    return images_.join(truth.withColumnRenamed("name", "file_name"), "file_name", "left")
