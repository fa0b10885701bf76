"""Exact distinct counts that add up: bitmaps over numbered keys.

Counts of distinct invoices of days do not add up to those of a month, as an invoice can have
lines on two days.  Bitmaps do: each key gets a number, in the order of the days, so that the
keys of a day lie in few bitmaps of 32,768 bits, and a month's bitmaps are its days' bitmaps
or-ed.  The roll-up shuffles bitmaps, never keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.operators.marts import named_sales
from salesmart.plans.scratch import stored

#: Keys that a window numbers in one task.
KEYS_PER_TASK = 500_000


def number_keys(
    keyed: DataFrame, key: str, order: str, known: DataFrame | None = None
) -> DataFrame:
    """A number from 1 for each distinct ``key``, without gaps, by the least ``order`` of its rows.

    (key, order, number).  ``known``, an earlier result, keeps its numbers; new keys follow
    it.  Keys of one ``order`` value are dealt to as many parts as they need, the parts' sizes
    are added up, and only rows of a part are sorted together.  Null keys get no number.
    """
    firsts = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
    last = 0
    if known is not None:
        firsts = firsts.join(known.select(key), key, "left_anti")
        last = known.agg(F.max("number")).first()[0] or 0
    firsts = stored(firsts, "first_seen")
    sizes = firsts.groupBy(order).agg(
        F.ceil(F.count(F.lit(1)) / KEYS_PER_TASK).cast("int").alias("parts")
    )
    part = F.pmod(F.xxhash64(key), F.col("parts")).cast("int")
    same_order = F.col(order).eqNullSafe(F.col("_order"))
    dealt = stored(
        firsts.join(sizes.withColumnRenamed(order, "_order"), same_order)
        .withColumn("part", part)
        .select(key, order, "part"),
        "dealt",
    )
    # A row for each part: as many as tasks are needed, and orders (days) at least.
    before = W.orderBy(order, "part").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        dealt.groupBy(order, "part")
        .agg(F.count(F.lit(1)).alias("size"))
        .select(
            F.col(order).alias("_order"),
            F.col("part").alias("_part"),
            F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"),
        )
    )
    within = W.partitionBy(order, "part").orderBy(key)
    new = (
        dealt.withColumn("place", F.row_number().over(within))
        .join(bases, same_order & (F.col("part") == F.col("_part")))
        .select(key, order, (F.lit(last) + F.col("base") + F.col("place")).alias("number"))
    )
    return new if known is None else known.unionByName(new)


def bitmaps(numbered: DataFrame, *by: str) -> DataFrame:
    """The numbers of each group as bitmaps: ``by``, bucket, bitmap."""
    return (
        numbered.withColumns(
            {
                "bucket": F.bitmap_bucket_number("number"),
                "bit": F.bitmap_bit_position("number"),
            }
        )
        .groupBy(*by, "bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def rolled_up(maps: DataFrame, **by: Column) -> DataFrame:
    """The bitmaps of coarser groups, each named and made of columns of finer ones."""
    groups = [column.alias(name) for name, column in by.items()]
    return maps.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def counted(maps: DataFrame, *by: str, into: str) -> DataFrame:
    """How many distinct keys each group has."""
    return maps.groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).alias(into))


def daily_orders(fact: DataFrame, countries: DataFrame, numbers: DataFrame) -> DataFrame:
    """Bitmaps of the invoices of named customers by day and country of the customer.

    ``numbers`` has the numbers of all these invoices.  A line is reduced to its day, customer
    and invoice before it is joined, like in the daily report.
    """
    orders = named_sales(fact).select("invoice_day", "customer_id", "invoice_no").distinct()
    return bitmaps(
        orders.join(numbers.select("invoice_no", "number"), "invoice_no")
        .join(countries, "customer_id")
        .withColumnRenamed("invoice_day", "sale_date"),
        "sale_date",
        "country",
    )
