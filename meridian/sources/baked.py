"""Baked wind caches: a header and a zstandard stream of u, v doubles, time innermost.

Reading and writing work on one file a task; a cache is bounded by the 1024 cells a side
of a bake. Parquet with a sidecar of the grid is the engine's own form.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession

# The header.
MAGIC, VERSION = b"WBAKED01", 1
HEADER = struct.Struct("<8sI3Q5d")
LEVEL = 11


@dataclass(frozen=True)
class Baked:
    """uv[iy, ix, frame, 2] with the place of its first cell, its steps and the divisor of its coordinates."""

    uv: np.ndarray
    lon: float
    lat: float
    step: float
    step_s: float
    scale: float = 1.0

    @property
    def crossfade_s(self) -> float:
        """Not stored: five frames."""
        return 5 * self.step_s


def encode(baked: Baked) -> bytes:
    ny, nx, nt, _ = baked.uv.shape
    head = HEADER.pack(MAGIC, VERSION, nx, ny, nt, baked.lon, baked.lat, baked.step, baked.step_s, baked.scale)
    return head + zstandard.ZstdCompressor(level=LEVEL).compress(np.ascontiguousarray(baked.uv, "<f8").tobytes())


def decode(raw: bytes) -> Baked:
    """ValueError for anything that is not a whole cache of this version."""
    if len(raw) < HEADER.size:
        raise ValueError("the header is cut off")
    magic, version, nx, ny, nt, *rest = HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a baked wind cache")
    if version != VERSION:
        raise ValueError(f"version {version} is not known")
    size = nx * ny * nt * 16
    body = zstandard.ZstdDecompressor().decompressobj().decompress(raw[HEADER.size :])
    if len(body) != size:
        raise ValueError(f"{len(body)} bytes of grid, expected {size}")
    return Baked(np.frombuffer(body, "<f8").reshape(ny, nx, nt, 2).copy(), *rest)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, ix, iy, f, u, v) of all caches at a path; one task a file."""

    def cells(batches):
        for files in batches:
            for p, content in zip(files["path"], files["content"], strict=True):
                b = decode(content)
                ny, nx, nt, _ = b.uv.shape
                for iy in range(ny):  # a row of cells at a time
                    ix, f = np.divmod(np.arange(nx * nt), nt)
                    flat = b.uv[iy].reshape(-1, 2)
                    yield pd.DataFrame({"path": p, "ix": ix.astype(np.int32), "iy": np.int32(iy), "f": f.astype(np.int32), "u": flat[:, 0], "v": flat[:, 1]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "path string, ix int, iy int, f int, u double, v double")
