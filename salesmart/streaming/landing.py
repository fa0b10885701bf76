"""Landing folder to staging table, every file once, and a day's file again on demand."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from salesmart.operators.staging import stg_transactions
from salesmart.plans.sizing import short_tasks
from salesmart.schemas import RAW_SALES, STG_TRANSACTIONS_LOADED
from salesmart.sinks.tables import NO_DAY, delete, exists, files_below, read_table
from salesmart.sources.files import CSV_OPTIONS, SALES_FILE, SALES_FILES, SPELT, file_name
from salesmart.sources.quoted import ends_open, plain_path, read_quoted

# The day at the start of a file name; the second alternative swallows other names.
_FILE_DAY = r"^(\d{4})(\d{2})(\d{2})_.*$|^.*$"


def file_day(file: Column) -> Column:
    """The day in a file's name, NULL if it has none."""
    return F.regexp_replace(file, _FILE_DAY, "$1-$2-$3").try_cast("date")


def _named(raw: DataFrame, file: Column) -> DataFrame:
    """Adds ``load_file`` and ``load_date``, the day in its name."""
    return raw.withColumns({"load_date": file_day(file), "load_file": file})


def _spelt(spark: SparkSession, path: str) -> str:
    """The name of a file as it stands in a URL."""
    url = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()
    return url.rsplit("/", 1)[-1]


def _named_by_file(raw: DataFrame, paths: list[str]) -> DataFrame:
    """``_named`` of the rows of plain files: a name is taken apart once a file, not once a row.

    A name that Spark spells in another way than here is taken apart in each row.
    """
    spark = raw.sparkSession
    named = [{"_spelt": _spelt(spark, path), "load_file": path.rsplit("/", 1)[-1]} for path in paths]
    pairs = F.from_json(F.lit(json.dumps(named)), "array<struct<_spelt string, load_file string>>")
    files = spark.range(1, numPartitions=1).select(F.inline(pairs))
    files = files.withColumn("load_date", file_day(F.col("load_file")))
    rows = raw.withColumn("_spelt", F.col(SPELT))
    rows = rows.join(F.broadcast(files), "_spelt", "left")  # a row a file
    unknown, own = F.col("load_file").isNull(), file_name("_spelt")
    return rows.withColumns(
        {
            "load_date": F.when(unknown, file_day(own)).otherwise(F.col("load_date")),
            "load_file": F.when(unknown, own).otherwise(F.col("load_file")),
        }
    ).drop("_spelt")


def landed_files(
    spark: SparkSession, landing: str, archive: str | None = None, files: str = SALES_FILES
) -> DataFrame:
    """Stream of the lines of the files that arrive in ``landing``: ``_by_file`` sums them up.

    With ``archive``, a file is moved there by the run after the one that read it; the
    folder must not lie under ``landing``.
    """
    reader = (
        spark.readStream.option("pathGlobFilter", files)
        .option("lineSep", "\n")
        # A file may arrive long after the newest one; the default skips week-old files.
        # The price is a name kept for every file taken: a few a day.
        .option("maxFileAge", "36500d")
    )
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return _open_lines(reader.text(landing))


def _open_lines(lines: DataFrame) -> DataFrame:
    """Of each line its file, as it stands in a URL, and whether the line ends open."""
    return lines.select(F.col(SPELT).alias("spelt"), ends_open(F.col("value")).alias("open"))


def _by_file(lines: DataFrame) -> DataFrame:
    """A row for each file of ``_open_lines``: file, and whether a line ends open."""
    files = lines.groupBy("spelt").agg(F.max("open").alias("open"))
    return files.select(file_name("spelt").alias("file"), "open")


def read_landed(spark: SparkSession, landing: str, files: DataFrame) -> DataFrame | None:
    """Raw sales of ``files`` (``_by_file``); None without files.

    Files with line breaks inside quotes are put together from their lines, all others are read
    as they are.
    """
    found = files.select("file", "open").collect()  # a row a file
    parts = []
    if plain := sorted(f"{landing}/{file}" for file, breaks in found if not breaks):
        reader = spark.read.schema(RAW_SALES).options(**CSV_OPTIONS)
        rows = reader.csv([plain_path(path) for path in plain])
        parts.append(_named_by_file(rows, plain))
    if broken := sorted(f"{landing}/{file}" for file, breaks in found if breaks):
        rows = read_quoted(spark, broken, RAW_SALES.toDDL(), CSV_OPTIONS)
        parts.append(_named(rows, F.col("file")).drop("file"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def ingest_available_now(
    spark: SparkSession,
    landing: str,
    target: str,
    checkpoint: str,
    archive: str | None = None,
    files: str = SALES_FILES,
    taken: Callable[[DataFrame], None] | None = None,
) -> None:
    """Clean every file not taken before into the staging table at ``target``, then return.

    The checkpoint remembers the files.  Each file is a partition of the table, replaced as
    a whole, so a batch that died half-way is repeated by the next run without loss or
    doubles.  ``taken`` is called with the rows of every batch as they lie in the table, before
    the batch counts as done.
    """

    def take(batch: DataFrame, _: int) -> None:
        raw = read_landed(spark, landing.rstrip("/"), _by_file(batch))
        if raw is None:
            return
        rows = replace_loads(stg_transactions(raw, "load_date", "load_file"), target)
        if taken is not None and rows is not None:
            taken(rows)

    with short_tasks(spark):
        query = (
            landed_files(spark, landing, archive, files)
            .writeStream.foreachBatch(take)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def reload_day(
    spark: SparkSession,
    landing: str,
    target: str,
    day: date,
    taken: Callable[[DataFrame], None] | None = None,
) -> None:
    """Take the file of ``day`` again, whatever was taken under its name or day before.

    For corrected files: a stream never takes a name twice.  ``taken`` is called with the
    rows that lay there, and then with those that lie there now.
    """
    before = _of_day(spark, target, day)
    if taken is not None and before is not None:
        taken(before)
    folder = f"{target}/load_date={day.isoformat()}"
    old = set(files_below(spark, folder))
    lines = (
        spark.read.option("pathGlobFilter", SALES_FILE.format(day=day))
        .option("lineSep", "\n")
        .text(landing)
    )
    with short_tasks(spark):
        raw = read_landed(spark, landing.rstrip("/"), _by_file(_open_lines(lines)))
        if raw is not None:
            replace_loads(stg_transactions(raw, "load_date", "load_file"), target)
    kept = set(files_below(spark, folder))
    for file in old & kept:  # files of the day that the reload has not replaced
        delete(spark, f"{folder}/{file}")
    if taken is not None:
        now = _of_day(spark, target, day)
        if now is not None:
            taken(now)


def _of_day(spark: SparkSession, target: str, day: date) -> DataFrame | None:
    if not exists(spark, f"{target}/load_date={day.isoformat()}"):
        return None
    staging = read_table(spark, target, STG_TRANSACTIONS_LOADED)
    return staging.where(F.col("load_date") == F.lit(day))


def replace_loads(rows: DataFrame, target: str) -> DataFrame | None:
    """Write ``rows`` over the partitions of their files; return them as they lie there.

    Which files these are is observed on the way to the table, one entry a file, so that the
    folders of other batches need not be listed.
    """
    seen = Observation("loads")
    loads = F.collect_set(F.struct("load_date", "load_file"))
    (
        rows.observe(seen, loads.alias("loads"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("load_date", "load_file")
        .parquet(target)
    )
    found = seen.get["loads"]
    if not found:
        return None
    spark = rows.sparkSession
    days = sorted({NO_DAY if day is None else day.isoformat() for day, _ in found})
    written = (
        spark.read.schema(STG_TRANSACTIONS_LOADED)
        .option("basePath", target)
        .parquet(*[f"{target}/load_date={day}" for day in days])
    )
    return written.where(F.col("load_file").isin([file for _, file in found]))
