"""Tables as Parquet folders: whole replacement, or replacement of some of their periods."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: How Spark names the folder of a null.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored table; naming the schema saves the job that would infer it.

    Folders may be named after other columns, such as buckets: those are left out.
    """
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def exists(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    return files.exists(folder)


def delete(spark: SparkSession, path: str) -> None:
    folder, files = _folder(spark, path)
    files.delete(folder, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a file or folder; folders above the new place are made."""
    old, files = _folder(spark, path)
    new, _ = _folder(spark, to)
    files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise OSError(f"could not move {path} to {to}")


def files_below(spark: SparkSession, path: str, ending: str = ".parquet") -> list[str]:
    """Paths of a table's files, relative to its folder; none if there is no folder."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    root, found = files.makeQualified(folder).toString().rstrip("/"), []
    statuses = files.listFiles(folder, True)
    while statuses.hasNext():
        name = statuses.next().getPath().toString()
        if name.endswith(ending):
            found.append(name[len(root) + 1 :])
    return found


def folders_of(spark: SparkSession, path: str) -> list[str]:
    """Names of a table's partition folders, those directly below it."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    return [name for name in _names(spark, files.listStatus(folder), path) if "=" in name]


def write_replace(
    df: DataFrame, path: str, partition_by: str | None = None, cluster_by: Sequence[str] = ()
) -> None:
    """Replace the whole table, also by nothing.

    The rows are written beside the table and take its place when all of them are there,
    so a run that fails leaves the table as it was, and ``df`` may read it.  Between the
    two steps of the swap there is a moment without a table.
    """
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}._new-{uuid.uuid4().hex}"
    if partition_by:
        # Folder by folder into place, where a plain write moves file by file.
        _write_partitions(df, beside, partition_by, cluster_by)
    else:
        df.write.parquet(beside)
    folder, files = _folder(spark, beside)
    files.mkdirs(folder)  # without rows there are no partitions
    delete(spark, path)
    rename(spark, beside, path)


def write_periods(
    df: DataFrame,
    path: str,
    period: str,
    cluster_by: Sequence[str],
    answers_for: Iterable[date | None] = (),
) -> None:
    """Replace the periods present in ``df`` and leave the others alone.

    Running a period again therefore changes nothing, where an append would double it.
    ``df`` speaks for the periods in ``answers_for`` too: those it has no rows of are
    removed.
    """
    folders = [f"{period}={NO_DAY if day is None else day.isoformat()}" for day in answers_for]
    write_folders(df, path, period, cluster_by, folders)


def write_folders(
    df: DataFrame, path: str, partition_by: str, cluster_by: Sequence[str], answers_for: Iterable[str]
) -> None:
    """Replace the partitions present in ``df``, and empty the others in ``answers_for``.

    They are removed last, so a run that dies before is made good by its repetition.
    """
    spark = df.sparkSession
    folders = list(answers_for)
    before = files_in(spark, path, folders)
    _write_partitions(df, path, partition_by, cluster_by)
    after = files_in(spark, path, list(before))
    for name, files in before.items():
        if after.get(name) == files:  # written files have new names
            delete(spark, f"{path}/{name}")


def _write_partitions(
    df: DataFrame, path: str, partition_by: str, cluster_by: Sequence[str]
) -> None:
    with _spread_out(df.sparkSession):
        (
            _gathered(df, partition_by, cluster_by)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(partition_by)
            .parquet(path)
        )


def _gathered(df: DataFrame, period: str, cluster_by: Sequence[str]) -> DataFrame:
    """Rows of a period together and sorted.

    REBALANCE makes few files, and lets adaptive execution cut up a period that outgrows one
    task.  The order within files lets Parquet statistics skip row groups by
    ``cluster_by``.
    """
    return df.hint("rebalance", period).sortWithinPartitions(period, *cluster_by)


@contextmanager
def _spread_out(spark: SparkSession) -> Iterator[None]:
    """Keeps as many writing tasks as there are cores.

    A file costs a task much more than the few rows of a small period.  Adaptive execution
    would hand all of them to a single task as long as they make up less than a megabyte.
    """
    setting = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1b")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, statuses, root: str) -> list[str]:
    """Paths relative to ``root``; none for null."""
    if statuses is None:
        return []
    folder, files = _folder(spark, root)
    above = files.makeQualified(folder).toString().rstrip("/")
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(statuses)
    return [path.toString()[len(above) + 1 :] for path in paths]


def files_in(spark: SparkSession, path: str, folders: Sequence[str]) -> dict[str, set[str]]:
    """The files in those folders of a table that exist, from one listing."""
    if not folders:
        return {}
    _, files = _folder(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    plain = re.sub(r"([][{}*?^,\\])", r"\\\1", path)  # no pattern
    wanted = hadoop(f"{plain}/{{{','.join(folders)}}}/*")
    found: dict[str, set[str]] = {}
    for name in _names(spark, files.globStatus(wanted), path):
        folder, file = name.rsplit("/", 1)
        found.setdefault(folder, set()).add(file)
    return found
