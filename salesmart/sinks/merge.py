"""Tables kept up by key: hash buckets, of which a merge rewrites those that change.

A table lies in one folder a bucket, ``bucket_of_<n>=<i>``, so the number of buckets is read
from the folder names.  A merge replaces all rows of a key by the delivered ones (a slowly
changing dimension of type 1): it reads the buckets of the delivered keys, finds the keys whose
rows really change, and writes the buckets of those anew (copy on write).  All other buckets
keep their files.  A key may have several rows; equal rows of a key count by their number.  Null
is a key like others.

Buckets are replaced one after the other, so a merge that dies leaves some old and some new.
Its repetition compares again and does the rest.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from salesmart.plans.scratch import stored
from salesmart.plans.sizing import size_of
from salesmart.sinks.tables import (
    exists,
    folders_of,
    read_table,
    write_folders,
    write_replace,
)

#: Bytes of files that a bucket is meant for, and the fewest buckets of a table.
BYTES_PER_BUCKET = 64 * 1024**2
FEWEST_BUCKETS = 16

_NAME = "bucket_of_{}"


def bucket(key: str, buckets: int) -> Column:
    """The bucket of a key; null has one too."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_of(spark: SparkSession, path: str) -> int | None:
    """The number of buckets of the table at ``path``, None if it has no rows or is another kind."""
    found = {
        int(match[1])
        for name in folders_of(spark, path)
        if (match := re.fullmatch(r"bucket_of_(\d+)=\d+", name))
    }
    return found.pop() if len(found) == 1 else None


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int = FEWEST_BUCKETS) -> None:
    """Replace the whole table by ``df``."""
    name = _NAME.format(buckets)
    write_replace(df.withColumn(name, bucket(key, buckets)), path, name, [key])


def merge_by_key(
    delivered: DataFrame,
    path: str,
    key: str,
    schema: StructType,
    gone: DataFrame | None = None,
    complete: bool = False,
    noted: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Make the rows of each delivered key those in ``delivered``; return the keys that changed.

    Keys in ``gone`` (a column ``key``) that are not delivered lose their rows.  With ``complete``
    ``delivered`` is the whole table: keys that are not in it go.  ``noted`` is called with the
    changed keys before anything is written.
    """
    spark = delivered.sparkSession
    delivered = stored(delivered.select(*schema.names), "delivered")
    buckets = buckets_of(spark, path)
    if buckets is None:
        return _first(delivered, path, key, schema, noted)
    name = _NAME.format(buckets)
    mine = bucket(key, buckets)
    in_buckets = StructType([*schema.fields, StructField(name, IntegerType())])
    current = spark.read.schema(in_buckets).parquet(path)
    if not complete:
        asked = delivered.select(key)
        if gone is not None:
            asked = asked.unionByName(gone.select(key))
        asked = stored(asked.distinct(), "keys")
        current = _of_keys(current.where(F.col(name).isin(_buckets(asked, mine))), asked, key)
    changed = stored(_changed(current.drop(name), delivered, key), "changed")
    if noted is not None:
        noted(changed)
    touched = _buckets(changed, mine)
    if touched:
        old = spark.read.schema(in_buckets).parquet(path).where(F.col(name).isin(touched))
        new = _of_keys(delivered, changed, key).withColumn(name, mine)
        rows = _of_keys(old, changed, key, "left_anti").unionByName(new)
        # Stored first: Spark would read files that it is about to replace.
        rows = stored(rows, "merged")
        write_folders(rows, path, name, [key], [f"{name}={i}" for i in touched])
        _grow(spark, path, key, schema, buckets)
    return changed


def _first(delivered, path, key, schema, noted) -> DataFrame:
    """No table in buckets yet: all its keys, and those of a plain table there, may change."""
    spark = delivered.sparkSession
    keys = delivered.select(key)
    if exists(spark, path):
        keys = keys.unionByName(read_table(spark, path, schema).select(key))
    changed = stored(keys.distinct(), "changed")
    if noted is not None:
        noted(changed)
    write_bucketed(delivered, path, key, fitting_buckets(size_of(spark, path)))
    return changed


def _grow(spark: SparkSession, path: str, key: str, schema: StructType, buckets: int) -> None:
    """More buckets for a table that has outgrown its own."""
    wanted = fitting_buckets(size_of(spark, path))
    if wanted > 2 * buckets:
        write_bucketed(read_table(spark, path, schema), path, key, wanted)


def fitting_buckets(size: int) -> int:
    buckets = FEWEST_BUCKETS
    while buckets * BYTES_PER_BUCKET < size:
        buckets *= 2
    return buckets


def _buckets(keys: DataFrame, mine: Column) -> list[int]:
    """The buckets of some keys: at most as many as the table has."""
    return sorted(row[0] for row in keys.select(mine.alias("bucket")).distinct().collect())


def _of_keys(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    keys = keys.select(F.col(key).alias("_key"))
    return rows.join(keys, F.col(key).eqNullSafe(F.col("_key")), how)


def _changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ.  Rows that both sides have cancel out, in a single shuffle."""
    names = new.columns
    weighed = old.select(*names, F.lit(-1).alias("_n")).unionByName(
        new.select(*names, F.lit(1).alias("_n"))
    )
    differing = weighed.groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return differing.select(key).distinct()
