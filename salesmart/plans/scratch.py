"""Intermediate tables in storage that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from salesmart.sinks.tables import read_table, write_replace

_SETTING = "spark.checkpoint.dir"
_handed_out: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The folder named by ``spark.checkpoint.dir``, else the one given to
    ``SparkContext.setCheckpointDir``, else a folder in the session's warehouse: all of
    them lie on storage that the executors share.
    """
    return (
        spark.conf.get(_SETTING, None)
        or spark.sparkContext.getCheckpointDir()
        or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared checkpoint folder."""
    path = f"{scratch_root(spark).rstrip('/')}/salesmart/{name}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what lies at the paths handed out so far, once no frame reads them any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _handed_out:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_handed_out.pop())
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    For results that several jobs read; ``release`` deletes them.  A stored table
    outlives the executors that made it, and unlike a checkpointed frame keeps column
    pruning, filter pushdown and the file sizes by which Spark decides on broadcasts.
    """
    path = scratch_path(df.sparkSession, name)
    write_replace(df, path)
    return read_table(df.sparkSession, path, df.schema)
