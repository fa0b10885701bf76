"""Raw sales to clean transactions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.dates import parse_invoice_time
from salesmart.schemas import ANONYMOUS, UNIT_PRICE


def stg_transactions(raw: DataFrame, *keep: str) -> DataFrame:
    """Keep sound rows, give them types, and name customers that have no number.

    A sound row has a positive quantity and price, an invoice number and a
    readable invoice time.  ``keep`` carries extra columns of ``raw`` along.
    One narrow pass, so it also serves as the body of a streaming job.

    ``stack`` of one row makes the parsed time the output of a generator.  The test for
    null stays above it, where Spark would push it below a projection and parse each
    time in the filter and again for the result.
    """
    sound = raw.where(
        (F.col("Quantity") > 0) & (F.col("UnitPrice") > 0) & F.col("InvoiceNo").isNotNull()
    )
    parsed = sound.select(
        F.col("InvoiceNo").alias("invoice_no"),
        F.col("StockCode").alias("stock_code"),
        F.col("Description").alias("description"),
        F.col("Quantity").cast("bigint").alias("quantity"),
        F.stack(F.lit(1), parse_invoice_time(F.col("InvoiceDate"))).alias("invoice_date"),
        F.col("UnitPrice").cast(UNIT_PRICE).alias("unit_price"),
        F.coalesce("CustomerID", F.lit(ANONYMOUS)).alias("customer_id"),
        F.col("Country").alias("country"),
        *keep,
    )
    return parsed.where(F.col("invoice_date").isNotNull())
