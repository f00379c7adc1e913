"""Intermediate tables in the folder that all executors share.

``cut`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it back: the lineage ends
there, a lost executor costs no recomputation, and a table that is read several times is computed once.
The folders of an application lie below one folder named after it and can go when it has ended.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Bytes that Spark hands to a Python worker at a time while a table is cut; else ten thousand rows, however long their texts.
BATCH = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


class TablePath(str):
    """Where a model's own table lies; it is copied when the model is stored."""


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset (tests, one machine) a local folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tidewatch-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs in here hands ``BATCH`` bytes to a Python worker at a time, unless the session has a limit of its own."""
    if spark.conf.get(_LIMIT, None) is not None:
        yield
        return
    spark.conf.set(_LIMIT, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(_LIMIT)


def cut(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The same rows, read back from a table in the shared folder."""
    return cut_to(df, new_path(df.sparkSession, name), compression)


def cut_to(df: DataFrame, path: str, compression: str = "zstd", group_rows: int | None = None) -> DataFrame:
    """As ``cut``, in a folder that the caller names and may ``drop``.

    ``group_rows``: rows of a row group at most, for rows of megabytes. Writers look at a group's size after a hundred rows only, and a reader
    takes up to a whole group at once, so that a task's memory would grow with its share of the table.
    """
    write = df.write.option("compression", compression)
    if group_rows:
        write = write.option("parquet.block.row.count.limit", str(group_rows))
    with small_batches(df.sparkSession):
        write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def enough(spark: SparkSession, rows: int, each: int = 1 << 21) -> int:
    """Partitions that keep at most about so many rows each, and no fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def bucketed_table(df: DataFrame, keys: list[str], name: str, n: int | None = None, dealt: bool = False) -> tuple[DataFrame, str, str]:
    """As ``cut``, as a table bucketed (n times; else by the session's setting) and sorted by keys: joins and groups on them don't move its rows again. Also its name and folder. dealt: ``df`` has n partitions by the keys."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"{name}_{path[-12:]}"
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark):
        (df if dealt else df.repartition(n, *keys)).write.option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table), table, path


def drop_table(spark: SparkSession, table: str, path: str) -> None:
    """Takes a bucketed table that is no longer read out of the catalog and removes its folder."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder that is no longer read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(df: DataFrame, mb: int = 64) -> int:
    """Enough shuffle partitions for the estimated size of a DataFrame, and no fewer than the session's setting."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, min(size // (mb << 20), 200_000)) if size < 1 << 60 else own
