"""Distinct counts that add up, and top sums from a small part of the rows."""

import random
import re
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesmart import schemas
from salesmart.functions.dates import month_start
from salesmart.operators import distinct, threshold
from salesmart.plans.scratch import stored


def exchanges(df):
    """What each shuffle of the plan is keyed by and what its rows are."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)?", plan), plan


def _orders(spark, seed, days, per_day):
    draw = random.Random(seed)
    rows = []
    for d in range(days):
        for _ in range(per_day):
            # A third of all rows are one order of one country.
            order = "hot" if draw.random() < 1 / 3 else f"o{draw.randrange(per_day * days)}"
            rows.append((date(2010, 1, 30) + timedelta(d), draw.choice("ab"), order))
    rows.append((None, "a", "no day"))
    rows.append((date(2010, 1, 30), "a", None))
    return rows, spark.createDataFrame(rows, "day date, country string, order string")


def test_numbers_are_dense_and_follow_the_days(spark, monkeypatch):
    monkeypatch.setattr(distinct, "KEYS_PER_TASK", 7)  # many parts
    rows, df = _orders(spark, 1, 6, 50)
    numbered = distinct.number_keys(df, "order", "day").collect()
    assert sorted(r.number for r in numbered) == list(range(1, len(numbered) + 1))
    assert {r.order for r in numbered} == {o for _, _, o in rows if o is not None}
    by_number = sorted(numbered, key=lambda r: r.number)
    days = [r.day or date.min for r in by_number]
    assert days == sorted(days)


def test_new_keys_follow_the_known(spark):
    rows, df = _orders(spark, 2, 3, 30)
    first = stored(distinct.number_keys(df, "order", "day"), "numbers")
    more = spark.createDataFrame(
        [(date(2010, 1, 1), "a", "earlier"), (date(2010, 1, 1), "a", "hot")], df.schema
    )
    both = distinct.number_keys(more, "order", "day", known=first).collect()
    assert {(r.order, r.number) for r in first.collect()} < {(r.order, r.number) for r in both}
    assert {r.order: r.number for r in both}["earlier"] == first.count() + 1


def test_rolled_up_counts_are_exact_and_move_no_keys(spark):
    rows, df = _orders(spark, 3, 40, 60)
    numbers = distinct.number_keys(df, "order", "day")
    daily = stored(
        distinct.bitmaps(df.join(numbers.select("order", "number"), "order"), "day", "country"), "maps"
    )
    monthly = distinct.counted(
        distinct.rolled_up(daily, month=month_start(F.col("day"))), "month", into="orders"
    )
    keys, plan = exchanges(monthly)
    assert keys and all("order" not in key and "number" not in key for key in keys)
    assert "order" not in plan.replace("orders", "")
    theirs = defaultdict(set)
    for day, _, order in rows:
        if order is not None:
            theirs[day and day.replace(day=1)].add(order)
    assert {r.month: r.orders for r in monthly.collect()} == {m: len(o) for m, o in theirs.items()}


def test_more_keys_than_a_bitmap_holds(spark):
    df = spark.range(100_000).selectExpr("CAST(id AS STRING) AS k", "DATE'2010-01-01' AS day")
    numbers = distinct.number_keys(df, "k", "day")
    maps = stored(distinct.bitmaps(numbers, "day"), "maps")
    assert maps.count() == 4
    assert distinct.counted(maps, "day", into="n").first().n == 100_000


def test_no_keys(spark):
    df = spark.createDataFrame([], "k string, day date")
    numbers = distinct.number_keys(df, "k", "day")
    assert distinct.counted(distinct.bitmaps(numbers, "day"), "day", into="n").collect() == []


def _lists(spark, rows):
    schema = "invoice_day date, stock_code string, amount decimal(38,9)"
    df = spark.createDataFrame(rows, schema)
    return stored(df.withColumn("month_start_date", month_start(F.col("invoice_day"))), "lists")


def _plain(rows, k):
    sums = defaultdict(Counter)
    for day, code, amount in rows:
        sums[day.replace(day=1)][code] += amount
    return {
        (month, code, amount, i + 1)
        for month, found in sums.items()
        for i, (code, amount) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k])
    }


def _found(df):
    columns = ("month_start_date", "stock_code", "total_sales_this_month", "rank_this_month")
    return {tuple(row) for row in df.select(*columns).collect()}


def _zipf(seed, days, products):
    draw = random.Random(seed)
    return [
        (date(2010, 1, 1) + timedelta(d), f"p{p}",
         (Decimal(10_000) / (p + 1) * Decimal(draw.uniform(0.5, 1.5))).quantize(Decimal("1e-9")))
        for d in range(days) for p in range(products)
    ]


@pytest.mark.parametrize("seed, days, products", [(1, 40, 80), (2, 1, 30), (3, 62, 12), (4, 5, 3)])
def test_the_top_is_exact(spark, seed, days, products):
    rows = _zipf(seed, days, products)
    assert _found(threshold.top_k(_lists(spark, rows), 10)) == _plain(rows, 10)


def test_ties_zeros_and_products_that_are_nowhere_best(spark):
    """Middling every day and best in the month; equal totals; sums of nothing."""
    rows = [(date(2010, 1, d), f"day{d}-{i}", Decimal(50 - i)) for d in range(1, 29) for i in range(12)]
    rows += [(date(2010, 1, d), code, Decimal(20)) for d in range(1, 29) for code in ("even", "same")]
    rows += [(date(2010, 2, 1), f"z{i}", Decimal(0)) for i in range(15)]
    found = _found(threshold.top_k(_lists(spark, rows), 10))
    assert found == _plain(rows, 10)
    assert {("even", 1), ("same", 2)} <= {(row[1], row[3]) for row in found}
    assert _found(threshold.top_k(_lists(spark, rows), 1)) == _plain(rows, 1)


def test_few_rows_are_moved(spark):
    rows = _zipf(5, 31, 3_000)
    lists = _lists(spark, rows)
    seen = stored(threshold.seen_rows(lists, 10), "seen")
    some = threshold.candidates(seen, 10)
    assert seen.count() < len(rows) / 20
    assert some.count() < 20
    assert lists.join(some, ["month_start_date", "stock_code"], "left_semi").count() < len(rows) / 100
    assert _found(threshold.top_k(lists, 10)) == _plain(rows, 10)


def test_lists_of_the_fact(spark):
    day = date(2010, 12, 1)
    fact = spark.createDataFrame(
        [(20101201, str(i), None, "7", code, 1, Decimal(1), Decimal(i), day)
         for i, code in enumerate(["A", "A", "B", "gone"], 1)],
        schemas.FACT_SALES,
    )
    products = spark.createDataFrame(
        [("A", "mug", "Mugs & Cups"), ("B", None, "Other")], schemas.DIM_PRODUCTS
    )
    found = threshold.top_n_products_monthly(fact, products).collect()
    assert [(r.stock_code, r.total_sales_this_month, r.rank_this_month) for r in found] == [
        ("A", 3, 1),
        ("B", 3, 2),
    ]
    assert threshold.top_n_products_monthly(fact.limit(0), products).collect() == []
