"""Headerless 32-byte splat files as a Spark data source: ``format("splat")``.

A row is three float32 of position, three of log scale, four bytes of colour and opacity and four of
rotation. Partitions are row ranges; a trailing partial row is dropped, and a file below one row is refused.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader

from voxelloom.functions.splat import SH0
from voxelloom.sources.ply import COLUMNS, ROWS, SCHEMA, Part, PartWriter, paths_of

ROW = np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 4), ("q", "u1", 4)])


def decode(raw: bytes, first: int = 0) -> pa.RecordBatch:
    rows = np.frombuffer(raw[: len(raw) // 32 * 32], ROW)
    q = rows["q"].astype(np.int8).astype(np.float32) / 128
    n = np.linalg.norm(q, axis=1, keepdims=True)
    q = np.where(n > 0, q / np.where(n > 0, n, 1), np.array([1, 0, 0, 0], np.float32))
    a = rows["c"][:, 3].astype(np.float32) / 255
    inner = np.clip(a, 0.001, 0.999)
    logit = np.where(a > 0.999, 5.0, np.where(a < 0.001, -5.0, np.log(inner / (1 - inner))))
    sh = (rows["c"][:, :3].astype(np.float32) / 255 - 0.5) / np.float32(SH0)
    cols = [*rows["p"].T, *rows["s"].T, *q.T, logit, *sh.T]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows))), *[pa.array(np.ascontiguousarray(c, np.float32)) for c in cols]], ["splat_id", *COLUMNS])


def encode(table: pa.Table) -> bytes:
    g = {c: table[c].to_numpy().astype(np.float64) for c in COLUMNS}
    rows = np.zeros(len(table), ROW)
    rows["p"] = np.stack([g[a] for a in "xyz"], 1)
    rows["s"] = np.stack([g[f"scale_{a}"] for a in "xyz"], 1)
    rgb = np.stack([0.5 + SH0 * g[f"sh_dc_{c}"] for c in "rgb"] + [1 / (1 + np.exp(-g["opacity_logit"]))], 1)
    rows["c"] = np.clip(np.round(rgb * 255), 0, 255)
    q = np.stack([g[f"rot_{a}"] for a in "wxyz"], 1)
    n = np.linalg.norm(q, axis=1, keepdims=True)
    q = np.where(n > 0, q / np.where(n > 0, n, 1), [1.0, 0, 0, 0])
    rows["q"] = np.clip(np.round(q * 128), -128, 127).astype(np.int8).view(np.uint8)
    return rows.tobytes()


def pack24(packed: pa.Table) -> bytes:
    """Renderer vertices: float32 position, colour and opacity as bytes, float16 scale (its fourth is 0)."""
    out = np.zeros(len(packed), np.dtype([("p", "<f4", 3), ("c", "u1", 4), ("s", "<f2", 4)]))
    col = lambda c: packed[c].to_numpy().astype(np.float64)
    out["p"] = np.stack([col(a) for a in "xyz"], 1)
    out["c"] = np.clip(np.round(np.stack([col(c) for c in ("r", "g", "b", "opacity")], 1) * 255), 0, 255)
    out["s"][:, :3] = np.stack([col(f"scale_{a}") for a in "xyz"], 1)
    return out.tobytes()


class SplatReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.rows = options, int(options.get("rowsPerPartition", ROWS))

    def partitions(self) -> list[Part]:
        out = []
        for path in paths_of(self.options, ".splat"):
            n = os.path.getsize(path) // 32
            if not n:
                raise ValueError(f"{path}: less than one splat")
            out += [Part(path, a, min(self.rows, n - a)) for a in range(0, n, self.rows)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as f:
            f.seek(part.first * 32)
            yield decode(f.read(part.count * 32), part.first)


class SplatWriter(PartWriter):
    ending = ".splat"

    def encode(self, table: pa.Table) -> bytes:
        return encode(table)


class SplatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "splat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SplatReader:
        return SplatReader(self.options)

    def writer(self, schema, overwrite: bool) -> SplatWriter:
        return SplatWriter(self.options, overwrite)
