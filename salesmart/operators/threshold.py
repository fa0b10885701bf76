"""Exact top k of sums over many lists, from a small part of their rows.

The lists are the days of a month, each with a product's sales once.  Summing all of them
shuffles every row.  The three-phase uniform threshold algorithm reads the lists three times
but moves few rows:

1. The k best rows of each list.  Their sums bound the totals from below; the k-th highest sum,
   divided by the number of lists, is a threshold that a product in the top k must reach in
   some list.
2. All rows of at least that threshold.  Their sums are better lower bounds, and what a product
   may have in the lists where it was not seen, less than the threshold each, bounds its total
   from above.
3. The rows of the products whose upper bound reaches the k-th highest lower bound.

Values must not be negative, which sales are not.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.functions.amounts import total
from salesmart.functions.dates import month_start
from salesmart.plans.scratch import stored
from salesmart.schemas import MONEY

_GROUP, _LIST, _KEY, _VALUE = "month_start_date", "invoice_day", "stock_code", "amount"


def day_sales(fact: DataFrame, products: DataFrame) -> DataFrame:
    """The lists: sales by day and stock code, of products that have a dimension row."""
    sales = fact.groupBy(_LIST, _KEY).agg(total(F.col("line_item_total_amount")).alias(_VALUE))
    return sales.join(products.select(_KEY), _KEY, "left_semi").withColumn(
        _GROUP, month_start(F.col(_LIST))
    )


def _rank(*by: str, of: str) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(F.desc(of), _KEY))


def _kth(sums: DataFrame, k: int, name: str) -> DataFrame:
    """The k-th highest sum of each group; none for groups with fewer."""
    ranked = sums.withColumn("place", _rank(_GROUP, of="least")).where(F.col("place") <= k)
    return ranked.where(F.col("place") == k).select(_GROUP, F.col("least").alias(name))


def seen_rows(lists: DataFrame, k: int) -> DataFrame:
    """Phases 1 and 2: the rows of at least the threshold of their group, and that threshold.

    A group with fewer than k products among its lists' best has a threshold of 0.
    """
    best = lists.withColumn("place", _rank(_LIST, of=_VALUE)).where(F.col("place") <= k)
    sums = best.groupBy(_GROUP, _KEY).agg(total(F.col(_VALUE)).alias("least"))
    counts = lists.select(_GROUP, _LIST).distinct().groupBy(_GROUP).agg(
        F.count(F.lit(1)).alias("lists")
    )
    # Rounded down, so that less than the threshold in every list is less than the k-th sum.  (With
    # a digit less before the point, the difference keeps all nine after it.)
    share = (F.col("kth") / F.col("lists")).cast("decimal(37,9)") - F.lit(Decimal("1e-9"))
    thresholds = counts.join(_kth(sums, k, "kth"), _GROUP, "left").select(
        _GROUP,
        "lists",
        F.greatest(F.coalesce(share, F.lit(0)), F.lit(0)).cast(MONEY).alias("threshold"),
    )
    thresholds = stored(thresholds, "thresholds")  # a row for each group
    return lists.join(thresholds, _GROUP).where(F.col(_VALUE) >= F.col("threshold"))


def candidates(seen: DataFrame, k: int) -> DataFrame:
    """The (group, key) pairs whose total may be among the k highest."""
    sums = seen.groupBy(_GROUP, _KEY).agg(
        total(F.col(_VALUE)).alias("least"),
        F.count(F.lit(1)).alias("found"),
        F.first("lists").alias("lists"),
        F.first("threshold").alias("threshold"),
    )
    sums = stored(sums, "sums")
    unseen = (F.col("lists") - F.col("found")).cast("decimal(17,0)")
    most = F.col("least") + (F.col("threshold") * unseen).cast(MONEY)
    known = sums.join(_kth(sums, k, "kth"), _GROUP, "left")
    return known.where(F.col("kth").isNull() | (most >= F.col("kth"))).select(_GROUP, _KEY)


def top_k(lists: DataFrame, k: int = 10) -> DataFrame:
    """The k highest totals of each group: month, stock code, total, rank; ties by stock code.

    ``lists`` (``day_sales``) is read three times: pass a stored table.
    """
    some = stored(candidates(seen_rows(lists, k), k), "candidates")
    totals = (
        lists.join(some, [_GROUP, _KEY], "left_semi")
        .groupBy(_GROUP, _KEY)
        .agg(total(F.col(_VALUE)).alias("total_sales_this_month"))
    )
    rank = _rank(_GROUP, of="total_sales_this_month").cast("bigint")
    return totals.withColumn("rank_this_month", rank).where(F.col("rank_this_month") <= k)


def top_n_products_monthly(fact: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """``marts.top_n_products_monthly`` of all months, from stored sums of days."""
    best = top_k(stored(day_sales(fact, products), "day_sales"), n)
    return best.join(products, _KEY).select(
        _GROUP,
        _KEY,
        "description",
        "product_category",
        "total_sales_this_month",
        "rank_this_month",
    )
