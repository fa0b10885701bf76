"""Sales fact."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.amounts import line_amount
from salesmart.functions.dates import date_key, day_or_today


def fact_sales(stg: DataFrame, as_of: date | None = None) -> DataFrame:
    """Line items that were neither cancelled nor dated after ``as_of``.

    Invoice numbers of cancellations start with a capital C.  ``invoice_day`` is
    the partition column of the table.  A narrow pass: no shuffle until it is written.
    """
    day = F.to_date("invoice_date")
    return stg.where((day <= day_or_today(as_of)) & ~F.col("invoice_no").startswith("C")).select(
        date_key(day).alias("date_id"),
        "invoice_no",
        "invoice_date",
        "customer_id",
        "stock_code",
        "quantity",
        "unit_price",
        line_amount(F.col("quantity"), F.col("unit_price")).alias("line_item_total_amount"),
        day.alias("invoice_day"),
    )
