"""Scene files through Spark's own readers, for paths that only they can open, and text scenes split by bytes.

``text_scene`` reads text PLY with ``spark.read.text``: Spark splits files by bytes, each split counts its lines, and a line's number in
its file is its place in its split plus the lines of the splits before. Headers, the first bytes of each file, come to the driver through the
Hadoop file system. ``binary_scene`` reads whole binary files (up to 2 GB each, one row a file) with ``binaryFile`` and the table function
``parse_scene``, which also takes binaries from any column by a lateral join. The data sources ``ply`` and ``splat`` read ranges of larger
binary files on mounted folders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelloom.session import ship
from voxelloom.sources.ply import COLUMNS, PROPERTIES, SCHEMA, Header, _column
from voxelloom.sources.splat import decode

#: Bytes in which a header must end.
HEAD = 1 << 16


def _files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the file, or of the folder's files but hidden ones."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    status = fs.globStatus(p)
    if status is None or not len(status):
        raise FileNotFoundError(path)
    out = []
    for s in status:
        inner = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        out += [f.getPath().toString() for f in inner if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    return sorted(out)


def header_of(spark: SparkSession, path: str) -> Header:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(p)
    try:
        return Header(bytes(stream.readNBytes(HEAD)))
    finally:
        stream.close()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (0, 1, ... in its file), value. Splits count their lines first; no file is read by one task."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = counts.select("file", "block", (before - F.col("first")).alias("shift"))
    return raw.join(offset, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def text_scene(spark: SparkSession, path: str) -> DataFrame:
    """Splats of text PLY files: the first ``count`` lines after each header, numbers by property name; missing or unreadable ones are 0."""
    heads = []
    for f in _files(spark, path):
        h = header_of(spark, f)
        if h.format != "ascii":
            raise ValueError(f"{f}: not a text PLY")
        names = [n for n, _ in h.props]
        heads.append((f, h.lines + h.lines_before, h.count, [names.index(p) if p in names else -1 for p in PROPERTIES], [dict(h.props).get(p) == "u1" for p in PROPERTIES]))
    spec = spark.createDataFrame(heads, "head string, skip long, count long, at array<int>, bytes array<boolean>")
    # A file's path is written with one or three slashes by different readers.
    plain = lambda c: F.regexp_replace(c, r"^(\w+):/+", "$1:/")
    lines = numbered_lines(spark, path).join(spec, plain(F.col("file")) == plain(F.col("head")))
    row = lines.withColumn("splat_id", F.col("line") - F.col("skip")).where((F.col("splat_id") >= 0) & (F.col("splat_id") < F.col("count")))
    row = row.withColumn("w", F.split(F.trim("value"), r"\s+"))

    def value(i: int):
        at = F.col("at")[i]
        v = F.coalesce(F.when(at >= 0, F.get("w", at)).try_cast("float"), F.lit(0.0).cast("float"))
        return F.when(F.col("bytes")[i], v / 255).otherwise(v).cast("float")

    return row.select("splat_id", *[value(i).alias(c) for i, c in enumerate(COLUMNS)])


class ParseScene:
    """Rows of one binary scene: PLY by its header, anything else as rows of 32 bytes."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        if content[:3] == b"ply":
            h = Header(content)
            if h.format == "ascii":
                raise ValueError("text scenes are read line by line")
            kinds, size = dict(h.props), h.dtype.itemsize
            start = h.start + h.before
            rows = np.frombuffer(content[start : start + (len(content) - start) // size * size], h.dtype)[: h.count]
            cols = [_column(rows, p, kinds.get(p)).tolist() for p in PROPERTIES]
        else:
            cols = [c.to_pylist() for c in decode(content).columns[1:]]
        yield from zip(range(len(cols[0])), *cols)


def register_functions(spark: SparkSession) -> None:
    """Makes ``parse_scene(binary)`` known to SQL."""
    ship(spark)
    spark.udtf.register("parse_scene", F.udtf(ParseScene, returnType=SCHEMA, useArrow=True))


def parsed(binaries: DataFrame, content: str) -> DataFrame:
    """The rows of ``binaries`` but ``content``, each with every splat of its binary: a lateral join with ``parse_scene``."""
    spark = binaries.sparkSession
    register_functions(spark)
    rest = ", ".join(f"b.`{c}`" for c in binaries.columns if c != content)
    return spark.sql(f"SELECT {rest + ', ' if rest else ''}s.* FROM {{b}} b, LATERAL parse_scene(b.`{content}`) s", b=binaries)


def binary_scene(spark: SparkSession, path: str) -> DataFrame:
    """Splats of whole binary files, by any file system that Spark opens."""
    return parsed(spark.read.format("binaryFile").load(path).select("content"), "content")
