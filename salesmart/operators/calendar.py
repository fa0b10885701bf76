"""Calendar dimension."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.dates import date_key, week_from_sunday


def dim_dates(stg: DataFrame) -> DataFrame:
    """One row per day from the first to the last transaction day, gaps included.

    Only two values leave the scan; the days are spelled out from them.
    """
    ends = stg.agg(
        F.to_date(F.min("invoice_date")).alias("first"),
        F.to_date(F.max("invoice_date")).alias("last"),
    )
    days = ends.select(
        F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias("full_date")
    )
    day = F.col("full_date")
    weekday = F.dayofweek(day)  # Sunday is 1
    return days.select(
        date_key(day).alias("date_id"),
        day,
        F.date_format(day, "EEEE").alias("day_name"),
        weekday.cast("bigint").alias("day_of_week"),
        F.day(day).cast("bigint").alias("day_of_month"),
        week_from_sunday(day).alias("week_of_year"),
        F.month(day).cast("bigint").alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.quarter(day).cast("bigint").alias("quarter"),
        F.year(day).cast("bigint").alias("year"),
        weekday.isin(1, 7).alias("is_weekend"),
    )
