"""Streaming ingest of forecasts: for each valid time and cell the value of the latest cycle.

An extension of the engine; forecasts overlap, and later cycles replace earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

FORECAST = "valid timestamp, cycle timestamp, i int, j int, speed double, direction double"


def forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Forecast rows as their files arrive."""
    return spark.readStream.schema(FORECAST).parquet(path)


def latest(rows: DataFrame) -> DataFrame:
    """Of a batch or of a whole table: the row of the latest cycle for each (valid, i, j)."""
    order = Window.partitionBy("valid", "i", "j").orderBy(F.col("cycle").desc())
    return rows.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def deduplicated(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Rows without repeats of the same (valid, i, j, cycle); state older than the watermark is dropped."""
    return stream.withWatermark("cycle", late).dropDuplicatesWithinWatermark(["valid", "i", "j", "cycle"])


def hourly(stream: DataFrame, late: str = "6 hours") -> DataFrame:
    """(start, i, j, n, speed): mean speed of each cell by hour of validity."""
    grouped = stream.withWatermark("valid", late).groupBy(F.window("valid", "1 hour"), "i", "j")
    return grouped.agg(F.count("*").alias("n"), F.avg("speed").alias("speed")).select(F.col("window.start").alias("start"), "i", "j", "n", "speed")


def upsert(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps the latest forecasts at a path, a folder a batch; read_latest() sees them as one."""

    def write(batch: DataFrame, epoch: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")  # the same epoch again writes the same folder

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark.read.parquet(path).drop("batch"))
