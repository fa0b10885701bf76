"""Customer dimension: purchase history, RFM scores and segments."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.amounts import line_amount, total
from salesmart.functions.dates import day_or_today
from salesmart.functions.rules import rfm_code, rfm_segment
from salesmart.operators.tiles import exact_ntiles
from salesmart.schemas import ANONYMOUS


def customer_base(stg: DataFrame) -> DataFrame:
    """First and last day, number of invoices and amount spent of each named customer.

    Cancellations count here, though the fact leaves them out.  Spark spreads the
    distinct count over (customer, invoice) first, so that a customer with a large
    share of all rows is already reduced when the rows of a customer come together.
    """
    return (
        stg.where(F.col("customer_id") != ANONYMOUS)
        .groupBy("customer_id")
        .agg(
            F.to_date(F.min("invoice_date")).alias("first_invoice_date"),
            F.to_date(F.max("invoice_date")).alias("last_invoice_date"),
            F.count_distinct("invoice_no").alias("total_orders"),
            total(line_amount(F.col("quantity"), F.col("unit_price"))).alias("total_spent"),
        )
    )


def customer_countries(stg: DataFrame) -> DataFrame:
    """The distinct (customer, country) pairs of named customers."""
    return (
        stg.where(F.col("customer_id") != ANONYMOUS).select("customer_id", "country").distinct()
    )


def rfm_measures(base: DataFrame, as_of: date | None = None) -> DataFrame:
    """Days since the last purchase, number of orders and amount spent."""
    return base.select(
        "customer_id",
        "first_invoice_date",
        "last_invoice_date",
        F.date_diff(day_or_today(as_of), F.col("last_invoice_date"))
        .cast("bigint")
        .alias("recency_days"),
        F.col("total_orders").alias("frequency"),
        F.col("total_spent").alias("monetary"),
    )


def rfm_scores(base: DataFrame, as_of: date | None = None) -> DataFrame:
    """Quintile scores 1 to 5, where 5 is the most recent, frequent and valuable fifth.

    Fewer days since the last purchase means a later last purchase, so recency is
    ranked by that date.  Ties go by customer number.  ``base`` is read several
    times: pass a stored table.
    """
    return exact_ntiles(
        rfm_measures(base, as_of),
        {
            "r_score": F.col("last_invoice_date"),
            "f_score": F.col("frequency"),
            "m_score": F.col("monetary"),
        },
        id_column="customer_id",
    )


def rfm_segments(scores: DataFrame) -> DataFrame:
    """The three-digit score code and the segment label."""
    rfm = [F.col(name) for name in ("r_score", "f_score", "m_score")]
    return scores.select(
        "customer_id",
        "first_invoice_date",
        "last_invoice_date",
        F.col("recency_days").alias("rfm_recency"),
        F.col("frequency").alias("rfm_frequency"),
        F.col("monetary").alias("rfm_monetary"),
        rfm_code(*rfm).alias("rfm_score"),
        rfm_segment(*rfm).alias("rfm_segment"),
    )


def dim_customers(segments: DataFrame, countries: DataFrame) -> DataFrame:
    """One row per named customer and country.

    A customer seen in two countries has two rows, and a join to this table then
    counts each of the customer's sales twice.  Both are part of the data model.
    """
    return segments.join(countries, "customer_id", "left").select(
        "customer_id",
        "country",
        "first_invoice_date",
        "last_invoice_date",
        "rfm_recency",
        "rfm_frequency",
        "rfm_monetary",
        "rfm_score",
        "rfm_segment",
    )
