"""Monthly reports that join sales and dimensions without a shuffle.

Sales summed up by month and key, and the dimension of the key, are kept in the same number of
buckets of that key.  A report then sums and joins bucket by bucket; what it shuffles are its
own sums by segment, or the best few products of each bucket.  Sums come before buckets: a key
that has a third of all sales has one row a month here, not a third of a bucketed fact.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart import schemas
from salesmart.functions.dates import month_start
from salesmart.operators import marts
from salesmart.plans.scratch import scratch_path
from salesmart.plans.sizing import size_of
from salesmart.sinks.bucketed import BucketedTable
from salesmart.sinks.merge import fitting_buckets
from salesmart.sinks.tables import read_table, write_replace

_MONTH = "month_start_date"


@dataclass(frozen=True)
class Pair:
    """Sums by month and the dimension that they are joined with."""

    sums: BucketedTable
    dimension: BucketedTable


@dataclass(frozen=True)
class Colocated:
    customers: Pair
    products: Pair
    _spark: SparkSession = field(repr=False)

    def segments(self, month: date | None = None) -> DataFrame:
        """``marts.agg_customer_segments_monthly``."""
        sums, dimension = self._sides(self.customers, month)
        return marts.segment_report(sums, dimension)

    def top_products(self, month: date | None = None, n: int = 10) -> DataFrame:
        """``marts.top_n_products_monthly``.

        Texts join at once: that moves no row, and the best of a bucket are found after it.
        """
        sums, dimension = self._sides(self.products, month)
        best = marts.ranked(sums.join(dimension, "stock_code"), n)
        return best.select(*schemas.TOP_N_PRODUCTS_MONTHLY.names)

    def rewrite(self, fact: DataFrame, months: Iterable[date]) -> None:
        """Replace some months by those in ``fact``, which has all their sales."""
        months = [month.replace(day=1) for month in months]
        some = fact.where(month_start(F.col("invoice_day")).isin(months))
        self.customers.sums.write(marts.customer_months(some), months)
        self.products.sums.write(marts.product_months(some), months)

    def _sides(self, pair: Pair, month: date | None) -> tuple[DataFrame, DataFrame]:
        sums = pair.sums.opened(self._spark)
        if month is not None:
            sums = sums.where(F.col(_MONTH) == F.lit(month.replace(day=1)))
        # Both sides lie ready for it: a broadcast would move the dimension for nothing.
        return sums, pair.dimension.opened(self._spark).hint("merge")


def colocate(
    base: str, name: str, fact: DataFrame, customers: DataFrame, products: DataFrame
) -> Colocated:
    """Lay the tables down in buckets below ``base``, named ``<name>_...`` in the catalog."""

    def pair(what: str, key: str, sums: DataFrame, dimension: DataFrame, schema) -> Pair:
        rows = {what: dimension.select(*schema.names), f"{what[:-1]}_months": sums}
        held = {table: scratch_path(df.sparkSession, table) for table, df in rows.items()}
        for table, df in rows.items():
            write_replace(df, held[table])
        spark = fact.sparkSession
        buckets = max(fitting_buckets(size_of(spark, path)) for path in held.values())
        tables = []
        for table, df in rows.items():
            period = None if table == what else _MONTH
            laid = BucketedTable(f"{name}_{table}", f"{base}/{table}", df.schema, key, buckets, period)
            laid.write(read_table(spark, held[table], df.schema))
            tables.append(laid)
        return Pair(tables[1], tables[0])

    return Colocated(
        pair(
            "customers", "customer_id", marts.customer_months(fact), customers, schemas.DIM_CUSTOMERS
        ),
        pair("products", "stock_code", marts.product_months(fact), products, schemas.DIM_PRODUCTS),
        fact.sparkSession,
    )
