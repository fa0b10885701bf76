"""Physical plans: what is read, what is shuffled, and what happens to hot keys."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from salesmart import schemas
from salesmart.operators import customers, facts, marts, products
from salesmart.plans import sizing
from salesmart.sinks.tables import read_table, write_periods, write_replace
from salesmart.sources import retail_tables

SMALL = "/root/testdata/sf0.001"
RUN_DATE = date(1998, 6, 15)


def plan(df, run=False):
    """The physical plan; with ``run``, the one adaptive execution arrived at."""
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored_tables(spark, tmp_path_factory):
    """Staging of the small tables and 40 days of its fact, on disk."""
    base = str(tmp_path_factory.mktemp("tables"))
    stg = registry.stg_transactions(spark, SMALL)
    write_replace(stg, f"{base}/stg")
    stg = read_table(spark, f"{base}/stg", schemas.STG_TRANSACTIONS)
    fact = facts.fact_sales(stg, registry.AS_OF)
    some = fact.where(F.col("invoice_day").between(date(1998, 5, 20), date(1998, 6, 28)))
    write_periods(some, f"{base}/fact", "invoice_day", ["customer_id", "stock_code"])
    return stg, read_table(spark, f"{base}/fact", schemas.FACT_SALES)


def test_scans_read_only_what_is_needed(stored_tables):
    stg, _ = stored_tables
    text = plan(customers.customer_countries(stg))
    assert "ReadSchema: struct<customer_id:string,country:string>" in text
    assert "Not(EqualTo(customer_id,ANONYMOUS))" in text
    text = plan(facts.fact_sales(stg, date(1998, 6, 15)).where("invoice_day = '1998-06-15'"))
    assert "GreaterThanOrEqual(invoice_date,1998-06-15T00:00)" in text


@pytest.mark.parametrize("mart", ["daily", "segments", "top"])
def test_a_period_reads_its_partitions_only(stored_tables, mart):
    stg, fact = stored_tables
    dim = customers.customer_countries(stg).withColumn("rfm_segment", F.lit("x"))
    frame = {
        "daily": lambda: marts.agg_daily_sales(fact, dim, RUN_DATE),
        "segments": lambda: marts.agg_customer_segments_monthly(fact, dim, RUN_DATE),
        "top": lambda: marts.top_n_products_monthly(fact, products.dim_products(stg), RUN_DATE),
    }[mart]()
    bounds = r"invoice_day#\d+ = 1998-06-15" if mart == "daily" else r"invoice_day#\d+ >= 1998-06-01"
    assert re.search(rf"PartitionFilters: \[.*{bounds}", plan(frame))


def test_anonymous_sales_are_dropped_before_the_shuffle(stored_tables):
    """Also when the dimension comes from a table, where Spark cannot infer it."""
    _, fact = stored_tables
    dim = fact.sparkSession.createDataFrame(
        [("1", "France", "x")], "customer_id string, country string, rfm_segment string"
    )
    for frame in (
        marts.agg_daily_sales(fact, dim),
        marts.agg_customer_segments_monthly(fact, dim),
    ):
        assert "Not(EqualTo(customer_id,ANONYMOUS))" in plan(frame)


def test_top_products_are_cut_before_the_shuffle(stored_tables):
    stg, fact = stored_tables
    text = plan(marts.top_n_products_monthly(fact, products.dim_products(stg)))
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_customer_dimension_never_gathers_all_customers(spark):
    for query in (registry.dim_customers, registry.agg_customer_segments_monthly_history):
        assert "SinglePartition" not in plan(query(spark, SMALL))


def test_no_query_forces_a_broadcast_or_crosses(spark):
    for name in ("stg_transactions", "dim_customers", "agg_daily_sales_history"):
        frame = registry.queries()[name](spark, SMALL)
        assert "strategy=broadcast" not in frame._jdf.queryExecution().logical().toString()
        assert not re.search("CartesianProduct|NestedLoop", plan(frame))


def test_descriptions_are_hashed_before_they_are_sorted(stored_tables):
    stg, _ = stored_tables
    lowest = plan(products.dim_products(stg)).rstrip().splitlines()
    scan = next(i for i, line in enumerate(lowest) if "FileScan" in line)
    above = [line for line in lowest[:scan] if "Aggregate" in line or "Sort" in line]
    assert "HashAggregate(keys=[stock_code" in above[-1] and "Sort" not in above[-1]


@pytest.fixture
def skewed(staged, spark):
    """A third of all rows belong to one customer, one product and one invoice's day."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, 90_000, 1, 8).select(
        F.concat(F.lit("i"), (F.col("id") / 2).cast("long")).alias("invoice_no"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("stock_code"),
        F.lit("mug").alias("description"),
        (F.col("id") % 7 + 1).alias("quantity"),
        F.expr("TIMESTAMP_NTZ'2010-12-01 00:00:00' + MAKE_DT_INTERVAL(CAST(id % 60 AS INT))").alias(
            "invoice_date"
        ),
        F.lit(1.5).cast("decimal(20,9)").alias("unit_price"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 1000)).alias("customer_id"),
        F.when(hot, "UK").otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("country"),
    )


def test_a_hot_customer_is_split_in_the_join(skewed, with_settings):
    """One customer with a third of the invoices does not become one task."""
    fact, dim = facts.fact_sales(skewed, date(2012, 1, 1)), customers.customer_countries(skewed)
    plain = sorted(map(tuple, marts.agg_daily_sales(fact, dim).collect()), key=str)
    with_settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="100k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="200k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
    )
    daily = marts.agg_daily_sales(fact, dim)
    assert "skew=true" in plan(daily, run=True)
    assert sorted(map(tuple, daily.collect()), key=str) == plain


def test_a_hot_order_and_a_hot_part_are_split(spark, tmp_path, with_settings):
    """The joins that make up the raw sales, with a third of all line items on one key."""
    for name in ("orders", "customer", "nation", "part"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    hot = F.col("id") % 3 == 0
    spark.range(0, 120_000, 1, 8).select(
        F.when(hot, 5).otherwise(F.col("id") % 1500).alias("l_orderkey"),
        F.when(hot, 7).otherwise(F.col("id") % 200).alias("l_partkey"),
        (F.col("id") % 50 + 1).cast("double").alias("l_quantity"),
        F.when(F.col("id") % 4 == 0, "R").otherwise("A").alias("l_returnflag"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")

    def summary(df):
        return df.groupBy("InvoiceNo", "StockCode").agg(F.sum("Quantity"), F.count("*")).collect()

    plain = sorted(summary(retail_tables.raw_sales(spark, str(tmp_path))), key=str)
    assert sum(row[3] for row in plain) == 120_000
    with_settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="40k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
    )
    raw = retail_tables.raw_sales(spark, str(tmp_path))
    assert plan(raw, run=True).count("skew=true") >= 2
    assert sorted(summary(raw), key=str) == plain


@pytest.mark.parametrize("mart", ["segments", "top"])
def test_a_hot_key_is_summed_up_before_the_join(skewed, mart):
    """What reaches the join is one row per month and key, however hot the key."""
    fact = facts.fact_sales(skewed, date(2012, 1, 1))
    dim = customers.customer_countries(skewed).withColumn("rfm_segment", F.lit("x"))
    if mart == "segments":
        frame = marts.agg_customer_segments_monthly(fact, dim)
    else:
        frame = marts.top_n_products_monthly(fact, products.dim_products(skewed))
    _, below = re.split(r"Join \[", plan(frame), maxsplit=1)
    key = "customer_id" if mart == "segments" else "stock_code"
    assert re.search(
        rf"HashAggregate\(keys=\[_groupingexpression#\d+, {key}#\d+\], functions=\[partial_sum", below
    )


def test_shuffles_grow_with_the_input(spark, with_settings):
    assert sizing.partitions_for(0) == 1
    assert sizing.partitions_for(100 * 10**12) == 745_059  # no ceiling unless one is given
    assert sizing.partitions_for(100 * 10**12, most=50_000) == 50_000
    with_settings(spark__sql__shuffle__partitions="8")
    with sizing.fitted_shuffles(spark, SMALL, "/no/such/path") as fitted:
        assert fitted == 8
    with sizing.fitted_shuffles(spark, SMALL, bytes_per_partition=10_000) as fitted:
        assert fitted > 8 and spark.conf.get("spark.sql.shuffle.partitions") == str(fitted)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_every_invoice_time_is_parsed_once(spark):
    """Counted in the plan of staging and in that of the fact on top of it."""
    stg = registry.stg_transactions(spark, SMALL)
    for frame in (stg, registry.fact_sales(spark, SMALL)):
        text = plan(frame)
        assert text.count("regexp_replace(") == 1, text


def test_top_products_join_texts_after_the_cut(stored_tables):
    stg, fact = stored_tables
    text = plan(marts.top_n_products_monthly(fact, products.dim_products(stg)))
    cut, semi = text.index("WindowGroupLimit"), text.index("LeftSemi")
    assert text.index("Join") < cut < semi  # texts join on top, codes below


def test_stored_staging_has_the_columns_that_are_read(spark):
    stg = registry._stored_stg(spark, SMALL, *registry._OF_CUSTOMERS)
    assert stg.columns == list(registry._OF_CUSTOMERS)
    assert "description" not in stg.columns and "stock_code" not in stg.columns


def test_what_an_order_decides_is_worked_out_before_its_lines_are_joined(spark):
    raw = retail_tables.raw_sales(spark, "/root/testdata/sf0.001")
    above, below = plan(raw).split("SortMergeJoin", 1)
    for text in ("not a date", "p_retailprice"):
        assert text in below and text not in above


def test_tasks_are_more_than_cores(spark):
    settings = (
        "spark.sql.files.minPartitionNum",
        "spark.sql.adaptive.coalescePartitions.minPartitionNum",
    )
    cores = spark.sparkContext.defaultParallelism
    with sizing.short_tasks(spark):
        with sizing.short_tasks(spark, 9):  # the settings are there already
            assert [spark.conf.get(s) for s in settings] == [str(4 * cores)] * 2
        assert [spark.conf.get(s) for s in settings] == [str(4 * cores)] * 2
    assert [spark.conf.get(s, None) for s in settings] == [None, None]
