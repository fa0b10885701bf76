"""Number of shuffle partitions in proportion to the input, and of tasks to the cores."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_SETTING = "spark.sql.shuffle.partitions"
BYTES_PER_PARTITION = 128 * 1024**2


def partitions_for(
    size: int, bytes_per_partition: int = BYTES_PER_PARTITION, most: int | None = None
) -> int:
    """Partitions that ``size`` bytes of files want; ``most`` bounds it only if given.

    Files are compressed and rows in a shuffle are not, by a factor that differs between
    tables: a smaller ``bytes_per_partition`` makes up for it.
    """
    wanted = max(1, -(-size // bytes_per_partition))
    return wanted if most is None else min(wanted, most)


def size_of(spark: SparkSession, *paths: str) -> int:
    """Bytes of the files under ``paths``; paths that do not exist count as none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for path in paths:
        folder = hadoop(path)
        files = folder.getFileSystem(conf)
        if files.exists(folder):
            size += files.getContentSummary(folder).getLength()
    return size


@contextmanager
def short_tasks(spark: SparkSession, per_core: int = 4) -> Iterator[None]:
    """At least ``per_core`` tasks a core in jobs inside the block, where there are rows for them.

    Spark aims at one task a core, and misses by one or two: most cores then wait for those.
    Settings that the session has are left alone, and those made here are taken back.
    """
    made = [
        setting
        for setting in (
            "spark.sql.files.minPartitionNum",
            "spark.sql.adaptive.coalescePartitions.minPartitionNum",
        )
        if spark.conf.get(setting, None) is None
    ]
    for setting in made:
        spark.conf.set(setting, str(per_core * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        for setting in made:
            spark.conf.unset(setting)


@contextmanager
def fitted_shuffles(
    spark: SparkSession,
    *paths: str,
    bytes_per_partition: int = BYTES_PER_PARTITION,
    most: int | None = None,
) -> Iterator[int]:
    """Shuffle partitions to suit the files under ``paths`` while the block runs.

    Never fewer than the session has: adaptive execution merges partitions that turn out
    small, but splits large ones only for joins and rebalancing, not for aggregations.
    For jobs that run inside the block; the session is left as it was found.
    """
    before = spark.conf.get(_SETTING)
    wanted = max(
        int(before), partitions_for(size_of(spark, *paths), bytes_per_partition, most)
    )
    spark.conf.set(_SETTING, str(wanted))
    try:
        yield wanted
    finally:
        spark.conf.set(_SETTING, before)
