"""What the training-data operators share: word rules, stable storage, exact distributed order statistics."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the contracts; words are the runs of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine gets a default where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        known = spark.sparkContext.getCheckpointDir()
    return known


def tidy(work):
    """A function of Arrow batches whose process gives freed memory back to the system once its task is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:
                pass  # another C library

    return run


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Have shuffle files deleted that only stable()'s dropped lineage needs: Spark does so once the driver collects its
    garbage, which without a need of memory may be long after."""
    spark._jvm.System.gc()


_MADE: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """As stable(), as a written table: for wide rows, whose columns are then pruned and compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meridian-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_alone(make: Callable[[], DataFrame], spent: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """make()'s rows as stored(), and its folders; tables that make() stored on the way, and the spent ones that
    nothing reads any more, are deleted once the rows are written."""
    before = len(_MADE)
    out = stored(make())
    done = [*spent, *_MADE[before:-1]]
    own = _MADE[-1]
    del _MADE[before:]
    spark = out.sparkSession
    for name in done:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out, [own]


#: Keys that a filtering join may broadcast (16 MB of longs); more are joined by shuffling.
MOST_KEYS = 1_000_000


def filtered(df: DataFrame, keys: DataFrame, column: str, how: str) -> DataFrame:
    """df's rows whose column is (left_semi) or is not (left_anti) among keys, one stored column of that name.

    The keys are broadcast only if they are counted to be few, so that wide rows need not be shuffled.
    """
    few = keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    return df.join(F.broadcast(keys) if few else keys, column, how)
