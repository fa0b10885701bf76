"""What the dimensions need of each load, small enough to be read again every day.

A load is what landed under one date.  Its partials hold every named and unnamed customer's
invoices (a row per customer, country, invoice and day instead of one per line) and the
smallest description of each product.  When a load is corrected its partials are replaced, so
that first and last days, which cannot be subtracted, survive the removal of rows: a customer's
measures are put together anew from the partials of all loads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.functions.amounts import line_amount, total
from salesmart.functions.rules import product_category
from salesmart.schemas import ANONYMOUS


def invoices_by_load(stg: DataFrame) -> DataFrame:
    """The amount of each invoice by load, customer, country and day.

    ``stg`` has the column load_date.  Summed up in the map tasks first, so that a customer
    with a large share of all lines is down to invoices before the shuffle.
    """
    return stg.groupBy(
        "load_date",
        "customer_id",
        "country",
        "invoice_no",
        F.to_date("invoice_date").alias("invoice_day"),
    ).agg(total(line_amount(F.col("quantity"), F.col("unit_price"))).alias("amount"))


def products_by_load(stg: DataFrame) -> DataFrame:
    """The smallest description of each stock code by load, none if it has none there."""
    spellings = stg.select("load_date", "stock_code", "description").distinct()
    return spellings.groupBy("load_date", "stock_code").agg(
        F.min_by("description", "description").alias("description")
    )


def customer_base(invoices: DataFrame) -> DataFrame:
    """The customers' purchase history, as ``customers.customer_base`` has it of staging."""
    return (
        _named(invoices)
        .groupBy("customer_id")
        .agg(
            F.min("invoice_day").alias("first_invoice_date"),
            F.max("invoice_day").alias("last_invoice_date"),
            F.count_distinct("invoice_no").alias("total_orders"),
            total(F.col("amount")).alias("total_spent"),
        )
    )


def customer_countries(invoices: DataFrame) -> DataFrame:
    """The distinct (customer, country) pairs of named customers."""
    return _named(invoices).select("customer_id", "country").distinct()


def dim_products(products: DataFrame) -> DataFrame:
    """The product dimension, as ``products.dim_products`` has it of staging."""
    return (
        products.groupBy("stock_code")
        .agg(F.min_by("description", "description").alias("description"))
        .withColumn("product_category", product_category(F.col("description")))
    )


def of_keys(partials: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The partials of some keys; null is a key like others."""
    keys = keys.select(F.col(key).alias("_key"))
    return partials.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def _named(invoices: DataFrame) -> DataFrame:
    return invoices.where(is_named())


def is_named() -> Column:
    return F.col("customer_id") != ANONYMOUS
