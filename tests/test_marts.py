from datetime import date
from decimal import Decimal

import pytest

from salesmart import schemas
from salesmart.operators import customers, marts
from salesmart.operators.facts import fact_sales
from salesmart.operators.products import dim_products

AS_OF = date(2011, 1, 1)


def table(df):
    return {tuple(row) for row in df.collect()}


@pytest.fixture
def layers(staged):
    """Fact, customer dimension and product dimension of some staging rows."""

    def make(*rows):
        stg = staged(*rows)
        base = customers.customer_base(stg)
        segments = customers.rfm_segments(customers.rfm_scores(base, AS_OF))
        dim = customers.dim_customers(segments, customers.customer_countries(stg))
        return fact_sales(stg, AS_OF), dim, dim_products(stg)

    return make


def test_schemas(layers):
    fact, dim, products = layers(("1", "A", "7", "France", "2010-12-01", 1, "1"))
    for frame, schema in (
        (fact, schemas.FACT_SALES),
        (dim, schemas.DIM_CUSTOMERS),
        (products, schemas.DIM_PRODUCTS),
        (marts.agg_daily_sales(fact, dim), schemas.AGG_DAILY_SALES),
        (
            marts.agg_customer_segments_monthly(fact, dim),
            schemas.AGG_CUSTOMER_SEGMENTS_MONTHLY,
        ),
        (marts.top_n_products_monthly(fact, products), schemas.TOP_N_PRODUCTS_MONTHLY),
    ):
        assert [(f.name, f.dataType) for f in frame.schema] == [
            (f.name, f.dataType) for f in schema
        ]


def test_cancelled_and_future_sales_are_no_facts(staged):
    fact = fact_sales(
        staged(
            ("1", "A", "7", "France", "2011-01-01T23:59", 3, "1.000000001"),
            ("C1", "A", "7", "France", "2010-12-01", 1, "1"),
            ("c1", "A", "7", "France", "2010-12-01", 1, "1"),
            ("2", "A", "7", "France", "2011-01-02", 1, "1"),
        ),
        AS_OF,
    )
    assert {(r.invoice_no, r.date_id, r.line_item_total_amount) for r in fact.collect()} == {
        ("1", 20110101, Decimal("3.000000003")),
        ("c1", 20101201, Decimal(1)),
    }


def test_customer_base_counts_cancellations_but_not_anonymous_sales(staged):
    base = customers.customer_base(
        staged(
            ("1", "A", "7", "France", "2010-12-01T08:00", 2, "1.5"),
            ("1", "B", "7", "France", "2010-12-01T09:00", 1, "1"),
            ("C2", "A", "7", "France", "2010-11-30", 1, "2"),
            ("3", "A", "ANONYMOUS", "France", "2010-12-05", 1, "1"),
        )
    )
    assert table(base) == {("7", date(2010, 11, 30), date(2010, 12, 1), 2, Decimal(6))}


def test_scores(staged):
    """Five customers, ranked the other way round by each measure but recency."""
    rows = []
    for i in range(1, 6):
        for order in range(6 - i):
            rows.append((f"{i}-{order}", "A", f"c{i}", "France", f"2010-12-{i:02}", i, "1"))
    base = customers.customer_base(staged(*rows))
    scores = customers.rfm_scores(base, AS_OF).select(
        "customer_id", "recency_days", "r_score", "f_score", "m_score"
    )
    # Amounts are 5, 8, 9, 8, 5: equal ones go by customer.
    assert table(scores) == {
        ("c1", 31, 1, 5, 1),
        ("c2", 30, 2, 4, 3),
        ("c3", 29, 3, 3, 5),
        ("c4", 28, 4, 2, 4),
        ("c5", 27, 5, 1, 2),
    }


def test_a_customer_of_two_countries_counts_twice(layers):
    fact, dim, _ = layers(
        ("1", "A", "7", "France", "2010-12-01", 2, "5"),
        ("2", "A", "7", "Spain", "2010-12-02", 1, "3"),
        ("3", "A", "8", None, "2010-12-02", 1, "1"),
    )
    assert {(r.customer_id, r.country) for r in dim.collect()} == {
        ("7", "France"),
        ("7", "Spain"),
        ("8", None),
    }
    daily = marts.agg_daily_sales(fact, dim)
    assert table(daily) == {
        (date(2010, 12, 1), "France", Decimal(10), 2, 1, Decimal(5)),
        (date(2010, 12, 1), "Spain", Decimal(10), 2, 1, Decimal(5)),
        (date(2010, 12, 2), "France", Decimal(3), 1, 1, Decimal(3)),
        (date(2010, 12, 2), "Spain", Decimal(3), 1, 1, Decimal(3)),
        (date(2010, 12, 2), None, Decimal(1), 1, 1, Decimal(1)),
    }
    # Both customers are in the lowest segment; the lines are 10, 10, 3, 3 and 1.
    assert table(marts.agg_customer_segments_monthly(fact, dim)) == {
        (date(2010, 12, 1), "Hibernating", 2, Decimal(27), Decimal("5.4"))
    }


def test_an_invoice_of_two_customers_is_one_order(layers):
    fact, dim, _ = layers(
        ("1", "A", "7", "France", "2010-12-01", 1, "1"),
        ("1", "A", "8", "France", "2010-12-01", 1, "1"),
        ("1", "B", "8", "France", "2010-12-01", 10, "3"),
    )
    # The average is over line items: (1 + 1 + 3) / 3.
    assert table(marts.agg_daily_sales(fact, dim)) == {
        (date(2010, 12, 1), "France", Decimal(32), 12, 1, Decimal("1.666666667"))
    }


def test_anonymous_sales_are_in_the_top_products_only(layers):
    fact, dim, products = layers(
        ("1", "A", "7", "France", "2010-12-01", 1, "1"),
        ("2", "B", "ANONYMOUS", "France", "2010-12-01", 1, "9"),
    )
    assert [r.total_daily_sales for r in marts.agg_daily_sales(fact, dim).collect()] == [1]
    (segment,) = marts.agg_customer_segments_monthly(fact, dim).collect()
    assert segment.total_segment_sales == 1
    assert table(marts.top_n_products_monthly(fact, products)) == {
        (date(2010, 12, 1), "B", "thing B", "Other", Decimal(9), 1),
        (date(2010, 12, 1), "A", "thing A", "Other", Decimal(1), 2),
    }


def test_top_products(layers):
    sales = [
        (str(i), f"S{i:02}", "7", "France", "2010-12-01", 1, str(1 + i // 2)) for i in range(24)
    ]
    fact, _, products = layers(*sales, ("n", None, "7", "France", "2010-12-01", 1, "99"))
    best = marts.top_n_products_monthly(fact, products).orderBy("rank_this_month").collect()
    # Equal sales go by stock code; a sale without a stock code finds no product.
    assert [r.stock_code for r in best] == [
        "S22", "S23", "S20", "S21", "S18", "S19", "S16", "S17", "S14", "S15",
    ]
    assert [r.rank_this_month for r in best] == list(range(1, 11))
    assert marts.top_n_products_monthly(fact, products, n=3).count() == 3


@pytest.mark.parametrize("run_date", [date(2010, 12, 31), date(2010, 12, 1), date(2010, 11, 30)])
def test_a_period_is_a_part_of_the_history(layers, run_date):
    fact, dim, products = layers(
        ("1", "A", "7", "France", "2010-11-30T23:59", 1, "1"),
        ("2", "A", "7", "France", "2010-12-01T00:00", 1, "1"),
        ("3", "B", "8", "Spain", "2010-12-31T23:59", 2, "1"),
        ("4", "B", "8", "Spain", "2011-01-01T00:00", 2, "1"),
    )
    month = run_date.replace(day=1)
    for mart, other, period in (
        (marts.agg_daily_sales, dim, run_date),
        (marts.agg_customer_segments_monthly, dim, month),
        (marts.top_n_products_monthly, products, month),
    ):
        history = {row for row in table(mart(fact, other)) if row[0] == period}
        assert table(mart(fact, other, run_date)) == history != set()
