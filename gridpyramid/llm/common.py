"""Helpers that the training-data operators share.

Null rules used by every operator unless its docstring says otherwise: a null
text counts as the empty text, a null id is an id of its own that sorts first,
and columns that an operator does not name are ignored or carried untouched.
Internal columns start with two underscores, so that callers' extra columns
cannot clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpyramid.functions.session import shared_folder, ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; other letters keep their case."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which executors and driver share; without that setting a local master takes one of this machine and a cluster raises an error."""
    return shared_folder(spark, name)


#: Of steps' files on file://, whose modes Hadoop without its native library sets by a process each: one such process a file instead of four, as there is no checksum file beside it, and no file that marks success.
SCRATCH = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def written(df: DataFrame, name: str, compression: str = "none") -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back.

    The files outlive any executor, so a lost one costs no recomputation. Most
    tables hold hashes, and native codecs hold memory outside the heap for each
    file, so only texts are worth a compression.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.options(**SCRATCH).option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty(df: DataFrame) -> bool:
    """Whether there are no rows, by one job."""
    return not df.limit(1).count()


def python_ready(spark: SparkSession, rows: int = 1000) -> None:
    """Call before a plan with Python code: ships this package to the workers and bounds an Arrow batch.

    The bound is in rows, so that long texts cannot fill a worker's memory.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    ship(spark)
