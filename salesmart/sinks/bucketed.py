"""Tables bucketed by a key, so that joins and sums on the key need no shuffle.

Spark knows of buckets through its catalog alone, so a table has a name there; its files lie at a
path of its own, and another session opens them by the same description.  A table may be
partitioned by a period as well: periods are then replaced one by one, and each holds all buckets.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from salesmart.sinks.tables import NO_DAY, delete, exists, files_in


@dataclass(frozen=True)
class BucketedTable:
    """Joins need no shuffle if both sides have the same number of buckets."""

    name: str
    path: str
    schema: StructType
    key: str
    buckets: int
    period: str | None = None

    def opened(self, spark: SparkSession) -> DataFrame:
        """The table, named in the session's catalog if it is not yet, also without rows."""
        if spark.catalog.tableExists(f"`{self.name}`"):
            return spark.table(f"`{self.name}`")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        by_period = f"PARTITIONED BY (`{self.period}`)" if self.period else ""
        path = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{self.name}` ({columns}) USING parquet {by_period} "
            f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS "
            f"LOCATION '{path}'"
        )
        self._match_partitions(spark)
        return spark.table(f"`{self.name}`")

    def write(self, rows: DataFrame, answers_for: Iterable[date | None] = ()) -> DataFrame:
        """Replace the periods that ``rows`` has or answers for; without a period, the table.

        A task writes a bucket, one file for each period.  ``rows`` should be summed up by key
        and period: all rows of a key go to one task.
        """
        spark = rows.sparkSession
        order = self.opened(spark).columns  # the period is last
        folders = [
            f"{self.period}={NO_DAY if day is None else day.isoformat()}" for day in answers_for
        ]
        before = files_in(spark, self.path, folders)
        gathered = rows.select(*order).repartition(self.buckets, self.key)
        setting = "spark.sql.sources.partitionOverwriteMode"
        mode = spark.conf.get(setting)
        spark.conf.set(setting, "dynamic" if self.period else "static")
        try:
            gathered.write.insertInto(f"`{self.name}`", overwrite=True)
        finally:
            spark.conf.set(setting, mode)
        after = files_in(spark, self.path, list(before))
        for folder, files in before.items():
            if after.get(folder) == files:  # written files have new names
                delete(spark, f"{self.path}/{folder}")
        self._match_partitions(spark)
        return spark.table(f"`{self.name}`")

    def _match_partitions(self, spark: SparkSession) -> None:
        """Those in the catalog become those on disk."""
        if self.period and exists(spark, self.path):
            spark.sql(f"MSCK REPAIR TABLE `{self.name}` SYNC PARTITIONS")
        spark.catalog.refreshTable(f"`{self.name}`")

    def forget(self, spark: SparkSession) -> None:
        """Take the name from the catalog; the files stay."""
        spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
