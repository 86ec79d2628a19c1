"""Session factory and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seqlens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; local masters without one get a folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file:///tmp/checkpoints/seqlens-{os.getuid()}"


_written: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> int:
    """Delete the shared tables that this process wrote; call it when their results are no longer read."""
    count = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return count


def drop_shared(*tables: DataFrame) -> None:
    """Delete shared tables of which nothing will be read again."""
    for t in tables:
        _written.remove(t._shared_path)
        _delete(t.sparkSession, t._shared_path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files of an operator's own; release() deletes it."""
    _written.append(f"{shared_dir(spark)}/seqlens/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return the table read back: lineage ends there.

    release() deletes such tables. A lost executor costs only the tasks that were running; nothing is recomputed
    from the source. Column pruning and statistics of Parquet apply to every reader.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table
