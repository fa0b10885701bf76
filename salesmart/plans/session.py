"""Session settings the plans are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan at run time: merge small shuffle partitions, split hot join keys and
    # hot write periods, turn joins with a small side into broadcasts by actual size.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Arithmetic and casts raise instead of returning NULL.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# For clusters reading tens of terabytes; pass to spark-submit next to the above.
LARGE_CLUSTER_SETTINGS = {
    # Fewer, longer map tasks: the blocks of a shuffle are maps x reduces.
    "spark.sql.files.maxPartitionBytes": "512m",
    # An executor that is told to leave hands its shuffle blocks over first.  One that is lost
    # without notice takes them along, and Spark runs those map tasks again.
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
}


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    partitions = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("salesmart")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", partitions)
    )
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
