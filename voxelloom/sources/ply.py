"""PLY point and splat files as a Spark data source: ``format("ply")``.

The header is self-describing; properties bind by name, unknown ones are skipped, missing ones are 0. Rows
have fixed strides in binary files, so partitions are row ranges that seek to their own bytes. ASCII files
are one partition per file. Big-endian files and files without a header end are refused.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "splat_id long, x float, y float, z float, scale_x float, scale_y float, scale_z float, rot_w float, rot_x float, rot_y float, rot_z float, opacity_logit float, sh_dc_r float, sh_dc_g float, sh_dc_b float"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")][1:]
# Property names of splat files, in the order of the columns.
PROPERTIES = ["x", "y", "z", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3", "opacity", "f_dc_0", "f_dc_1", "f_dc_2"]
# Type names of the format.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
ROWS = 1 << 18


class Header:
    """Format, vertex count, vertex properties, where the data start, and bytes of elements before the vertices."""

    def __init__(self, head: bytes):
        end = head.find(b"end_header")
        if not head.startswith(b"ply") or end < 0:
            raise ValueError("not a PLY file: no end_header")
        stop = end + len(b"end_header")
        self.start = stop + (2 if head[stop : stop + 2] == b"\r\n" else 1)
        self.lines = head[: self.start].count(b"\n")
        self.format, self.count, self.props, self.before = "ascii", 0, [], 0
        self.lines_before = 0
        element, pending = None, (0, 0)
        for line in head[:end].decode("ascii", "replace").splitlines():
            w = line.split()
            if not w:
                continue
            if w[0] == "format":
                self.format = w[1]
            elif w[0] == "element":
                self.before += pending[0] * pending[1]
                element, pending = w[1], (0, 0)
                if element == "vertex":
                    self.count, pending = int(w[2]), (0, 0)
                elif not self.props:
                    pending = (int(w[2]), 0)
                    self.lines_before += int(w[2])
            elif w[0] == "property" and element == "vertex":
                if w[1] == "list":
                    raise ValueError("list properties of vertices have no fixed stride")
                self.props.append((w[2], TYPES[w[1]]))
            elif w[0] == "property" and pending[0]:
                if w[1] == "list":
                    raise ValueError("an element with lists stands before the vertices")
                pending = (pending[0], pending[1] + np.dtype(TYPES[w[1]]).itemsize)
        if self.format not in ("ascii", "binary_little_endian"):
            raise ValueError(f"PLY format {self.format} is not supported")
        self.dtype = np.dtype([(n, t) for n, t in self.props])


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        head = f.read(1 << 16)
        while b"end_header" not in head and (more := f.read(1 << 16)):
            head += more
    return Header(head)


def _column(rows: np.ndarray, name: str, kind: str | None) -> np.ndarray:
    if kind is None:
        return np.zeros(len(rows), np.float32)
    v = rows[name].astype(np.float32)
    return v / np.float32(255) if kind == "u1" else v


def _batch(first: int, cols: list[np.ndarray]) -> pa.RecordBatch:
    n = len(cols[0])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), *[pa.array(np.ascontiguousarray(c, np.float32)) for c in cols]], ["splat_id", *COLUMNS])


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return 0.0


class Part(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


def paths_of(options: dict, ending: str) -> list[str]:
    p = options["path"].removeprefix("file://").removeprefix("file:")
    found = sorted(glob.glob(os.path.join(p, f"*{ending}"))) if os.path.isdir(p) else sorted(glob.glob(p))
    if not found:
        raise FileNotFoundError(p)
    return found


class PlyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.rows = options, int(options.get("rowsPerPartition", ROWS))

    def partitions(self) -> list[Part]:
        out = []
        for path in paths_of(self.options, ".ply"):
            h = read_header(path)
            step = self.rows if h.format != "ascii" else max(h.count, 1)
            out += [Part(path, a, min(step, h.count - a)) for a in range(0, h.count, step)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        h = read_header(part.path)
        kinds = dict(h.props)
        with open(part.path, "rb") as f:
            if h.format == "ascii":
                f.seek(h.start)
                lines = [line.decode("ascii", "replace").split() for line in f.read().splitlines()[h.lines_before :]][: h.count]
                at = [[n for n, _ in h.props].index(p) if p in kinds else None for p in PROPERTIES]
                cols = [np.array([_number(w[i]) if i is not None and i < len(w) else 0.0 for w in lines], np.float32) for i in at]
                yield _batch(0, cols)
                return
            size = h.dtype.itemsize
            f.seek(h.start + h.before + part.first * size)
            raw = f.read(part.count * size)
            rows = np.frombuffer(raw[: len(raw) // size * size], h.dtype)
            yield _batch(part.first, [_column(rows, p, kinds.get(p)) for p in PROPERTIES])


class _Message(WriterCommitMessage):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows


class PartWriter(DataSourceArrowWriter):
    """One file per task in the folder ``path``, complete only under its final name."""

    ending = ""

    def __init__(self, options: dict, overwrite: bool):
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        os.makedirs(self.folder, exist_ok=True)
        if overwrite:
            for old in glob.glob(os.path.join(self.folder, f"*{self.ending}")):
                os.remove(old)

    def encode(self, table: pa.Table) -> bytes:
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Message:
        from pyspark import TaskContext

        batches = list(batches)
        if not batches:
            return _Message("", 0)
        t = pa.Table.from_batches(batches)
        ctx = TaskContext.get()
        final = os.path.join(self.folder, f"part-{ctx.partitionId():05d}{self.ending}")
        spare = f"{final}.{ctx.taskAttemptId()}.tmp"
        with open(spare, "wb") as f:
            f.write(self.encode(t))
        os.replace(spare, final)
        return _Message(final, len(t))

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class PlyWriter(PartWriter):
    ending = ".ply"

    def encode(self, table: pa.Table) -> bytes:
        props = "".join(f"property float {p}\n" for p in PROPERTIES)
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(table)}\n{props}end_header\n"
        rows = np.stack([table[c].to_numpy().astype("<f4") for c in COLUMNS], 1)
        return head.encode() + rows.tobytes()


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlyReader:
        return PlyReader(self.options)

    def writer(self, schema, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options, overwrite)
