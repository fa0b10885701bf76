"""Reports on the sales fact.

Each takes one period, or none for every period there is.  Rows of the fact are
summed up before they meet a dimension, so that a customer or product with a
large share of all sales is down to one row per period (or per invoice) when the
join sends everything with its key to the same place.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.functions.amounts import mean, per_unit, total
from salesmart.functions.dates import month_start
from salesmart.schemas import ANONYMOUS, TOP_N_PRODUCTS_MONTHLY


def _in_month(day: Column, month: date) -> Column:
    """Whether a day lies in the month of ``month``, as a range on the day itself
    so that it selects partitions and Parquet row groups."""
    first = month.replace(day=1)
    after = date(first.year + first.month // 12, first.month % 12 + 1, 1)
    return (day >= F.lit(first)) & (day < F.lit(after))


def named_sales(fact: DataFrame) -> DataFrame:
    """Sales of named customers.  The customer dimension has no others, so the join
    would drop the rest anyway, after moving all of it to the one task of that key."""
    return fact.where(F.col("customer_id") != ANONYMOUS)


def agg_daily_sales(
    fact: DataFrame, customers: DataFrame, sale_date: date | None = None
) -> DataFrame:
    """Sales, quantity, orders and average unit price by day and customer country.

    ``customers`` needs customer_id and country.  The average is over line items,
    not weighted by quantity.
    """
    if sale_date is not None:
        fact = fact.where(F.col("invoice_day") == F.lit(sale_date))
    amount, quantity = F.col("line_item_total_amount"), F.col("quantity")
    orders = (
        named_sales(fact)
        .groupBy("invoice_day", "customer_id", "invoice_no")
        .agg(
            total(amount).alias("amount"),
            F.sum(quantity).alias("quantity"),
            total(per_unit(amount, quantity)).alias("unit_prices"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
    return (
        orders.join(customers.select("customer_id", "country"), "customer_id")
        .groupBy(F.col("invoice_day").alias("sale_date"), "country")
        .agg(
            total(F.col("amount")).alias("total_daily_sales"),
            F.sum("quantity").alias("total_daily_quantity"),
            F.count_distinct("invoice_no").alias("total_daily_orders"),
            mean(F.sum("unit_prices"), F.sum("lines")).alias("average_unit_price"),
        )
    )


def agg_customer_segments_monthly(
    fact: DataFrame, customers: DataFrame, month: date | None = None
) -> DataFrame:
    """Customers, sales and average line item by month and RFM segment.

    ``customers`` needs customer_id and rfm_segment.  The last column is named
    after orders but averages line items.
    """
    if month is not None:
        fact = fact.where(_in_month(F.col("invoice_day"), month))
    return segment_report(customer_months(fact), customers)


def customer_months(fact: DataFrame) -> DataFrame:
    """Sales and line items of named customers by month: month_start_date, customer_id, amount,
    lines."""
    return (
        named_sales(fact)
        .groupBy(month_start(F.col("invoice_day")).alias("month_start_date"), "customer_id")
        .agg(
            total(F.col("line_item_total_amount")).alias("amount"),
            F.count(F.lit(1)).alias("lines"),
        )
    )


def segment_report(spending: DataFrame, customers: DataFrame) -> DataFrame:
    """``agg_customer_segments_monthly`` of ``customer_months``."""
    return (
        spending.join(customers.select("customer_id", "rfm_segment"), "customer_id")
        .groupBy("month_start_date", "rfm_segment")
        .agg(
            F.count_distinct("customer_id").alias("distinct_customers_in_segment"),
            total(F.col("amount")).alias("total_segment_sales"),
            mean(F.sum("amount"), F.sum("lines")).alias("average_order_value_in_segment"),
        )
    )


def top_n_products_monthly(
    fact: DataFrame, products: DataFrame, month: date | None = None, n: int = 10
) -> DataFrame:
    """The ``n`` products of each month that sold best, anonymous sales included.

    ``products`` has one row per stock code.  Equal sales rank by stock code.
    Spark keeps ``n`` rows a month in every task before it ranks across tasks.
    """
    if month is not None:
        fact = fact.where(_in_month(F.col("invoice_day"), month))
    # Only stock codes with a dimension row compete; their texts join the winners alone.
    sales = product_months(fact).join(products.select("stock_code"), "stock_code", "left_semi")
    return ranked(sales, n).join(products, "stock_code").select(*TOP_N_PRODUCTS_MONTHLY.names)


def product_months(fact: DataFrame) -> DataFrame:
    """Sales by month: month_start_date, stock_code, total_sales_this_month."""
    return fact.groupBy(
        month_start(F.col("invoice_day")).alias("month_start_date"), "stock_code"
    ).agg(total(F.col("line_item_total_amount")).alias("total_sales_this_month"))


def ranked(sales: DataFrame, n: int) -> DataFrame:
    """The ``n`` best rows of each month, with their rank."""
    best_first = W.partitionBy("month_start_date").orderBy(
        F.desc("total_sales_this_month"), "stock_code"
    )
    rank = F.row_number().over(best_first)
    best = sales.withColumn("rank_this_month", rank).where(F.col("rank_this_month") <= n)
    return best.withColumn("rank_this_month", F.col("rank_this_month").cast("bigint"))
