"""Loading a wind file by its name's ending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.functions.geo import Box
from meridian.sources import baked, files, grib

FORMATS = {"grib2": "grib2", "grb2": "grib2", "grib": "grib2", "wbaked": "baked", "bk1": "baked", "json": "rows", "jsonl": "rows", "parquet": "parquet"}


def format_of(path: str) -> str:
    """The format of a path by its ending, in any case; ValueError for one that is not known."""
    end = path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    if end not in FORMATS:
        raise ValueError(f"unknown extension {end!r}")
    return FORMATS[end]


def load(spark: SparkSession, path: str, step: int | None = None, box: Box | None = None) -> DataFrame:
    """The rows of a wind file; step and box are for forecasts only, ValueError elsewhere."""
    kind = format_of(path)
    if kind == "grib2":
        return grib.load(spark, path, step or 1, box)
    if step is not None or box is not None:
        raise ValueError(f"step and box do not apply to {kind}")
    if kind == "baked":
        return baked.read(spark, path)
    return spark.read.parquet(path) if kind == "parquet" else files.read_rows(spark, path)
