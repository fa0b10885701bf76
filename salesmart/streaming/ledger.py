"""Landing folder to staging by content: a file corrected under its old name is taken again.

The ledger is a table with a row for each file taken: name, length, time of change and a digest
of its records.  A run lists the folder and leaves alone what has the length and time that the
ledger has.  The rest is read for digests, in parts like any text; only files whose digest is
new are taken, so one that was merely copied again costs a scan.

The digest is of the records as a bag, with the header apart: a file whose rows stand in
another order says the same.  It is made of counts and sums of hashes, which tasks add up
before anything is shuffled, whatever the length of a file.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.operators.staging import stg_transactions
from salesmart.plans.scratch import stored
from salesmart.schemas import LEDGER, STG_TRANSACTIONS_LOADED
from salesmart.sinks.merge import merge_by_key
from salesmart.sinks.tables import NO_DAY, delete, exists, folders_of, read_table
from salesmart.sources.files import SALES_FILES, file_name
from salesmart.sources.quoted import ends_open, lines_of, records
from salesmart.streaming.landing import file_day, read_landed, replace_loads


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Of each file: file, open (whether a text in it has a line break), digest."""
    lines = lines_of(spark, paths)
    first_block = F.when(F.col("block") == 0, F.monotonically_increasing_id())
    by_line = _summed(lines.withColumn("rank", first_block), ends_open(F.col("value")))
    by_line = stored(by_line, "digests")
    named = {path.rsplit("/", 1)[-1]: path for path in paths}
    broken = [named[row["file"]] for row in by_line.where("open").collect()]  # a row a file
    if not broken:
        return by_line
    by_record = _summed(
        records(lines_of(spark, broken)).withColumnRenamed("record", "rank"), F.lit(True)
    )
    return by_line.where("NOT open").unionByName(by_record)


def _summed(values: DataFrame, is_open: Column) -> DataFrame:
    """The first value, by ``rank``, is the header."""

    def total(hashed: Column) -> Column:
        return F.sum(hashed.cast("decimal(20,0)"))

    value = F.col("value")
    return values.groupBy("file").agg(
        F.max(is_open).alias("open"),
        F.concat_ws(
            "/",
            F.count(F.lit(1)),
            F.min_by(F.xxhash64(value), "rank"),
            total(F.xxhash64(value)),
            total(F.xxhash64(F.lit("again"), value)),
        ).alias("digest"),
    )


def listed(spark: SparkSession, landing: str, files: str = SALES_FILES) -> DataFrame:
    """What lies in the landing folder: file, length and modified.  Reads no file.

    A file without a byte has not arrived yet: even a day without sales has a header row.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", files).load(landing)
    return found.select(
        file_name().alias("file"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    if not exists(spark, ledger):
        return spark.createDataFrame([], LEDGER)
    return read_table(spark, ledger, LEDGER)


def ingest_changed(
    spark: SparkSession,
    landing: str,
    target: str,
    ledger: str,
    files: str = SALES_FILES,
    taken: Callable[[DataFrame], None] | None = None,
) -> list[str]:
    """Clean every file with new content into the staging table at ``target``; return their names.

    Each file is a partition of the table, replaced as a whole; a file without a good row left
    loses its partition.  Files that have left the folder, for an archive or for good, stay in
    the table.  ``taken`` is called with the rows that lay there and with those that lie there
    now.  The ledger is written last: a run that died is repeated by the next one.
    """
    landing = landing.rstrip("/")
    known = read_ledger(spark, ledger)
    seen = known.select("file", "length", "modified")
    found = stored(
        listed(spark, landing, files).join(seen, ["file", "length", "modified"], "left_anti"),
        "landed",
    )
    names = [row["file"] for row in found.select("file").collect()]  # new to this run
    if not names:
        return []
    contents = digests(spark, [f"{landing}/{name}" for name in sorted(names)])
    found = stored(found.join(contents, "file"), "landed")
    changed = found.join(known.select("file", "digest"), ["file", "digest"], "left_anti")
    changed = changed.select("file", "open", file_day(F.col("file")).alias("day"))
    loads = [tuple(row) for row in stored(changed, "changed").collect()]
    if loads:
        _take(spark, landing, target, loads, taken)
    merge_by_key(found.select(*LEDGER.names), ledger, "file", LEDGER)
    return sorted(file for file, _, _ in loads)


def _take(spark, landing, target, loads, taken) -> None:
    old = _folders(spark, target, loads)
    if taken is not None and old:
        staging = read_table(spark, target, STG_TRANSACTIONS_LOADED)
        days = {day for _, _, day in loads}
        on = F.col("load_date").isin([day for day in days if day is not None])
        if None in days:
            on = on | F.col("load_date").isNull()
        taken(staging.where(on).where(F.col("load_file").isin(list(old))))
    lines = spark.createDataFrame([load[:2] for load in loads], "file string, open boolean")
    raw = read_landed(spark, landing, lines)
    rows = replace_loads(stg_transactions(raw, "load_date", "load_file"), target)
    left = set()
    if rows is not None:
        left = {row[0] for row in rows.select("load_file").distinct().collect()}  # a row a file
    for file in old.keys() - left:
        delete(spark, old[file])
    if taken is not None and rows is not None:
        taken(rows)


def _folders(spark: SparkSession, target: str, loads: list[tuple]) -> dict[str, str]:
    """The partition folders that some files have in staging."""
    wanted, found = {file for file, _, _ in loads}, {}
    for day in {NO_DAY if day is None else day.isoformat() for _, _, day in loads}:
        above = f"{target}/load_date={day}"
        for name in folders_of(spark, above):
            file = unquote(name.removeprefix("load_file="))
            if file in wanted:
                found[file] = f"{above}/{name}"
    return found
