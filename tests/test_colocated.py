"""Reports from bucketed tables: equal to the others, and joined without a shuffle."""

from datetime import date

import pytest
from test_files import rows
from test_plans import plan

from salesmart import schemas
from salesmart.operators import customers, facts, marts, products
from salesmart.plans.colocated import colocate
from salesmart.sinks.bucketed import BucketedTable

AS_OF = date(2010, 12, 31)


@pytest.fixture(scope="module")
def sales(spark):
    """Staging rows of 40 customers, 30 products and 4 months; customer 7 has most sales."""
    made = spark.range(6_000).selectExpr(
        "CAST(1000 + id DIV 3 AS STRING) invoice_no",
        "CONCAT('P', id * id % 31) stock_code",
        "CONCAT('thing ', id * id % 31) description",
        "1 + id % 9 quantity",
        "CAST(DATE_ADD(DATE'2010-09-01', CAST(id * 7 % 120 AS INT)) AS TIMESTAMP_NTZ) invoice_date",
        "CAST(1 + id % 13 AS DECIMAL(20,9)) unit_price",
        "CASE WHEN id % 11 = 0 THEN 'ANONYMOUS' WHEN id % 3 > 0 THEN '7' "
        "ELSE CAST(id % 41 AS STRING) END customer_id",
        "IF(id % 2 = 0, 'Spain', 'France') country",
    )
    return made.select(*schemas.STG_TRANSACTIONS.names)


@pytest.fixture(scope="module")
def tables(spark, sales, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sales"))
    sales.write.mode("overwrite").parquet(path)
    stg = spark.read.parquet(path)
    fact, product = facts.fact_sales(stg, AS_OF), products.dim_products(stg)
    segments = customers.rfm_segments(customers.rfm_scores(customers.customer_base(stg), AS_OF))
    customer = customers.dim_customers(segments, customers.customer_countries(stg))
    base = str(tmp_path_factory.mktemp("it's co located"))
    return fact, customer, product, colocate(base, "tested", fact, customer, product)


def below_join(df):
    """The executed plan below its join."""
    text = plan(df, run=True)
    text = text.split("== Initial Plan ==")[0]
    assert text.count("SortMergeJoin") == 1, text
    return text.split("SortMergeJoin")[1]


@pytest.mark.parametrize("month", [None, date(2010, 10, 5), date(2012, 1, 1)])
def test_reports_equal_and_join_in_place(tables, month):
    fact, customer, product, laid = tables
    segments, top = laid.segments(month), laid.top_products(month)
    assert rows(segments) == rows(marts.agg_customer_segments_monthly(fact, customer, month))
    assert rows(top) == rows(marts.top_n_products_monthly(fact, product, month))
    assert segments.columns == marts.agg_customer_segments_monthly(fact, customer).columns
    if segments.isEmpty():  # no sales that month: adaptive execution joins nothing at all
        return
    for report in (segments, top):
        assert "Exchange" not in below_join(report)
        if month is not None:
            assert "PartitionFilters: [isnotnull(month_start_date" in below_join(report)


def test_a_hot_customer_is_one_row_a_month(tables):
    fact, _, _, laid = tables
    hot = laid.customers.sums.opened(fact.sparkSession).where("customer_id = '7'")
    assert fact.where("customer_id = '7'").count() > fact.count() / 3
    assert hot.count() == 4


def test_months_are_replaced_one_by_one(spark, tables, tmp_path):
    fact, customer, product, _ = tables
    laid = colocate(str(tmp_path), "replaced", fact, customer, product)
    # October loses some sales, November all of them; September is not spoken for.
    left = fact.where("invoice_day < '2010-11-01' OR invoice_day >= '2010-12-01'")
    left = left.where("invoice_day < '2010-10-01' OR quantity > 2")
    laid.rewrite(left.where("invoice_day >= '2010-10-01'"), [date(2010, m, 9) for m in (10, 11, 12)])
    assert rows(laid.segments()) == rows(marts.agg_customer_segments_monthly(left, customer))
    assert rows(laid.top_products()) == rows(marts.top_n_products_monthly(left, product))
    # Another session has the files, not the name.
    for table in (laid.customers.sums, laid.customers.dimension):
        table.forget(spark)
    again = laid.segments()
    assert rows(again) == rows(marts.agg_customer_segments_monthly(left, customer))
    assert "Exchange" not in below_join(again)


def test_a_table_without_rows(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, n long, day date").schema
    table = BucketedTable("without_rows", str(tmp_path / "t"), schema, "k", 4, "day")
    assert table.opened(spark).count() == 0
    none = spark.createDataFrame([], schema)
    assert table.write(none).count() == 0
    day = date(2010, 1, 1)
    some = spark.createDataFrame([(None, 1, day), ("a", 2, day), ("a", 3, None)], schema)
    assert rows(table.write(some)) == rows(some)
    assert rows(table.write(none, [None])) == rows(some.where("day IS NOT NULL"))
