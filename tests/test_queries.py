"""Every registered query against its SQL twin, and against recorded totals."""

from collections import Counter, namedtuple
from decimal import Decimal
from functools import cache

import pytest
from comparison import engine, rows_of_frame, rows_of_sql

import __spark_entry__ as registry

# Those of the training-data subpackage have tests of their own.
LLM = {*registry.llm.queries(), "pipeline"} if registry.llm else set()
OWN = [name for name in registry.queries() if name not in LLM]

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_every_query_has_a_twin():
    assert set(OWN) == registry.oracle_sql().keys() - LLM


@pytest.fixture(scope="module")
def result(spark):
    """Names and rows of a query, run once."""

    @cache
    def run(name, tables):
        return rows_of_frame(registry.queries()[name](spark, tables))

    return run


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(result, name):
    # A file per day at either scale, and slow on a local disk.
    slow = ("fact_sales_partition_rerun", "refreshed_late_rows", "refreshed_earlier_as_of")
    tables = SMALL if name in slow else MIDDLE
    ours = result(name, tables)
    theirs = rows_of_sql(engine(tables), registry.oracle_sql()[name])
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


def test_backfills_are_of_all_rows(result):
    """The daily runs are compared on rows, and the earlier last day takes some away."""
    def rows(name):
        return result(name, SMALL)[1]

    assert rows("refreshed_late_rows") == rows("agg_daily_sales_history")
    assert rows("refreshed_late_rows").total() == 1_199
    whole, earlier = rows("fact_sales"), rows("refreshed_earlier_as_of")
    assert whole.total() == 3_721
    assert 0 < earlier.total() < whole.total() and earlier <= whole
    day = result("fact_sales", SMALL)[0].index("invoice_day")
    assert earlier == Counter(
        {row: n for row, n in whole.items() if row[day] <= registry.EARLIER}
    )


def test_entry(spark):
    assert registry.entry(spark).count() == 439


def test_recorded_totals(result):
    def rows(name):
        names, counted = result(name, MIDDLE)
        return list(map(namedtuple("Row", names)._make, counted.elements()))

    fact = rows("fact_sales")
    assert len(fact) == 36_562
    assert sum(r.line_item_total_amount for r in fact) == Decimal("883240856.7")

    daily = rows("agg_daily_sales_history")
    assert len(daily) == 10_849
    assert sum(r.total_daily_sales for r in daily) == Decimal("810114013.5")
    assert sum(r.total_daily_quantity for r in daily) == 852_724
    assert sum(r.total_daily_orders for r in daily) == 11_990

    top = rows("top_n_products_monthly_history")
    assert (len(top), sum(r.rank_this_month for r in top)) == (798, 4_381)

    scores = rows("rfm_scores")
    assert sum(100 * r.r_score + 10 * r.f_score + r.m_score for r in scores) == 458_541

    assert Counter(r.rfm_segment for r in rows("rfm_segments")) == {
        "Champions": 241,
        "Loyal Customers": 266,
        "Potential Loyalists": 100,
        "New Customers": 41,
        "Promising": 134,
        "At Risk": 220,
        "Hibernating": 246,
        "Other": 130,
    }
    assert Counter(r.product_category for r in rows("dim_products")) == {
        "Candles": 115,
        "Bags": 344,
        "Boxes & Cases": 231,
        "Mugs & Cups": 230,
        "Heart Items": 115,
        "Christmas": 115,
        "Kitchenware": 115,
        "Wall Art": 230,
        "Vintage": 114,
        "Holders & Stands": 114,
        "Other": 228,
    }
