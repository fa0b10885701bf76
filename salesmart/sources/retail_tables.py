"""Raw sales drawn from order tables: one raw row per line item.

Gives the test tables the shape, and the faults, of the landed files: missing
invoice and customer numbers, returns, unreadable dates, zero prices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.schemas import UNIT_PRICE

# Appended to a part name by key modulo 17; the 17th has no description.
SUFFIXES = [
    "candle holder",
    "BAG",
    "jumbo sack",
    "storage box",
    "pencil case",
    "coffee mug",
    "cupboard",
    "heart",
    "christmas tree",
    "kitchen scale",
    "wall art",
    "poster",
    "vintage sign",
    "stand",
    "showcase bag",
    "plain",
]


def _invoice_time_text(time: Column) -> Column:
    """month/day/year hour:minute of a zoneless time.  (``date_format`` would take it
    through the session time zone.)"""
    return F.concat(
        F.month(time),
        F.lit("/"),
        F.day(time),
        F.lit("/"),
        F.lpad(F.year(time).cast("string"), 4, "0"),
        F.lit(" "),
        F.hour(time),
        F.lit(":"),
        F.lpad(F.minute(time).cast("string"), 2, "0"),
    )


def raw_sales(spark: SparkSession, tables: str) -> DataFrame:
    """Raw sales from the Parquet tables in the folder ``tables``.

    Line items meet their orders in a sort-merge join, since neither is ever a small
    side; adaptive execution splits the tasks of a hot order.  No join is told to
    broadcast: Spark does so below its size threshold only.  What an order or a
    part alone decides is worked out once for it, before its lines are joined to it; the
    other texts are built after the joins, from the narrow keys.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{tables}/{name}.parquet")

    order, part = F.col("o_orderkey"), F.col("p_partkey")
    time = F.col("o_orderdate") + F.make_dt_interval(mins=(order % 1440).cast("int"))
    orders = (
        table("orders")
        .join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            order,
            F.when(order % 53 == 0, "not a date")
            .otherwise(_invoice_time_text(time))
            .alias("InvoiceDate"),
            F.when(F.col("c_acctbal") < 0, None)
            .otherwise(F.col("c_custkey").cast("string"))
            .alias("CustomerID"),
            F.col("n_name").alias("Country"),
        )
    )
    price = F.when(part % 41 == 0, 0).otherwise(F.col("p_retailprice"))
    parts = table("part").select(part, "p_name", price.cast(UNIT_PRICE).alias("UnitPrice"))
    lines = (
        table("lineitem")
        .hint("merge")
        .join(orders, F.col("l_orderkey") == order)
        .join(parts, F.col("l_partkey") == part)
    )

    returned = F.when(F.col("l_returnflag") == "R", "C").otherwise("")
    quantity = F.col("l_quantity").cast("bigint")
    suffix = F.get(F.array(*map(F.lit, SUFFIXES)), (part % 17).cast("int"))
    return lines.select(
        F.when(order % 97 != 0, F.concat(returned, order.cast("string"))).alias("InvoiceNo"),
        part.cast("string").alias("StockCode"),
        F.concat("p_name", F.lit(" "), suffix).alias("Description"),
        F.when(order % 31 == 0, -quantity).otherwise(quantity).alias("Quantity"),
        "InvoiceDate",
        "UnitPrice",
        "CustomerID",
        "Country",
    )
