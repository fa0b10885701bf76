"""Registered queries, and the same queries as plain SQL for a second engine.

Every query starts from the given tables and runs over all of their rows.  The
ones that need a result more than once write it to scratch storage in between
(``salesmart.plans.scratch``), as a run on disk does with its tables.
"""

from __future__ import annotations

import os
import sys
import warnings
from collections.abc import Callable
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HOME = str(Path(__file__).resolve().parent)
sys.path.insert(0, _HOME)
# Python workers started from here on find the package too.
os.environ["PYTHONPATH"] = os.pathsep.join(
    dict.fromkeys([_HOME, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))])
)

from salesmart import schemas  # noqa: E402
from salesmart.operators import (  # noqa: E402
    calendar,
    customers,
    distinct,
    facts,
    marts,
    products,
    staging,
    threshold,
)
from salesmart.plans.colocated import Colocated, colocate  # noqa: E402
from salesmart.plans.refresh import Warehouse, build_dimensions, refresh, take_in  # noqa: E402
from salesmart.plans.scratch import scratch_path, stored  # noqa: E402
from salesmart.plans.sizing import short_tasks  # noqa: E402
from salesmart.sinks.merge import merge_by_key  # noqa: E402
from salesmart.sinks.tables import (  # noqa: E402
    delete,
    files_below,
    read_table,
    rename,
    write_periods,
)
from salesmart.sources import retail_tables  # noqa: E402
from salesmart.sources.files import CSV_OPTIONS, CSV_WRITE_OPTIONS, read_raw_sales  # noqa: E402
from salesmart.sources.quoted import read_quoted  # noqa: E402
from salesmart.streaming.landing import ingest_available_now  # noqa: E402
from salesmart.streaming.ledger import ingest_changed  # noqa: E402

try:  # the operators for training data and their pipeline may be left out
    import corpus_pipeline  # noqa: E402
    from salesmart.llm import queries as llm  # noqa: E402
except ImportError as missing:  # also of a package that only they need
    warnings.warn(f"without the queries for training data: {missing}", stacklevel=1)
    corpus_pipeline = llm = None

AS_OF = date(2001, 8, 2)
RUN_DATE = date(1998, 6, 15)
# Later invoices come with a second delivery.
SECOND = date(1998, 1, 1)
# The last days of two backfills: all rows go through the first, and the second removes some.
LATER, EARLIER = AS_OF, date(2001, 3, 15)


def _raw(spark: SparkSession, tables: str) -> DataFrame:
    return retail_tables.raw_sales(spark, tables)


def _stg(spark: SparkSession, tables: str) -> DataFrame:
    return staging.stg_transactions(_raw(spark, tables))


def _stored_raw(spark: SparkSession, tables: str) -> DataFrame:
    with short_tasks(spark):
        return stored(_raw(spark, tables), "raw_sales")


def _stored_stg(spark: SparkSession, tables: str, *columns: str) -> DataFrame:
    """Staging in scratch storage, with the columns that its readers need."""
    with short_tasks(spark):
        return stored(_stg(spark, tables).select(*columns), "stg_transactions")


# What the fact reads; what the customer measures and reports on customers read.
_OF_FACT = (
    "invoice_no", "invoice_date", "customer_id", "stock_code", "quantity", "unit_price",
)
_OF_CUSTOMERS = (
    "invoice_no", "invoice_date", "customer_id", "quantity", "unit_price", "country",
)


def _fact(stg: DataFrame) -> DataFrame:
    """The sales fact; of staging without stock codes, one with null ones."""
    if "stock_code" not in stg.columns:
        stg = stg.withColumn("stock_code", F.lit(None).cast("string"))
    return facts.fact_sales(stg, AS_OF)


def _scores(stg: DataFrame) -> DataFrame:
    return customers.rfm_scores(stored(customers.customer_base(stg), "customer_base"), AS_OF)


def _customers(stg: DataFrame) -> DataFrame:
    return customers.dim_customers(
        customers.rfm_segments(_scores(stg)), customers.customer_countries(stg)
    )


def raw_sales_csv(spark: SparkSession, tables: str) -> DataFrame:
    """All raw sales, written as CSV and read back with the landed-file reader."""
    path = scratch_path(spark, "raw_sales_csv")
    _raw(spark, tables).write.options(**CSV_WRITE_OPTIONS).csv(path)
    return read_raw_sales(spark, path)


def raw_sales_with_breaks(spark: SparkSession, tables: str) -> DataFrame:
    """All raw sales, some descriptions on two lines, written as CSV and read back in parts."""
    path = scratch_path(spark, "raw_sales_csv")
    raw = _raw(spark, tables)
    longer = F.concat("Description", F.lit('\nsecond "line", of two'))
    broken = F.when(F.length("StockCode") % 2 == 0, longer).otherwise(F.col("Description"))
    raw.withColumn("Description", broken).write.options(**CSV_WRITE_OPTIONS).csv(path)
    files = [f"{path}/{file}" for file in files_below(spark, path, ".csv")]
    return read_quoted(spark, files, schemas.RAW_SALES.toDDL(), CSV_OPTIONS).drop("file")


def stg_transactions(spark: SparkSession, tables: str) -> DataFrame:
    return _stg(spark, tables)


def _land(raw: DataFrame, landing: str, mark: str = "") -> None:
    """Raw sales as landed files of the last day of each invoice year, in parts."""
    spark = raw.sparkSession
    written = scratch_path(spark, "to_land")
    year = F.regexp_extract("InvoiceDate", r"/(\d{4}) ", 1)
    raw.withColumn("year", year).write.options(**CSV_WRITE_OPTIONS).partitionBy("year").csv(written)
    for n, file in enumerate(sorted(files_below(spark, written, ".csv"))):
        of_year = file.removeprefix("year=")[:4]
        rename(spark, f"{written}/{file}", f"{landing}/{of_year}1231_{n}_{mark}sales.csv")


def _is_early() -> Column:
    return F.regexp_extract("InvoiceDate", r"/(\d{4}) ", 1) < "1996"


def ingest_landed(spark: SparkSession, tables: str) -> DataFrame:
    """All raw sales, landed as files named by date and streamed into the staging table.

    They arrive in two portions.  The second run takes what is new; the third finds no
    new file and must add nothing.
    """
    landing, target, checkpoint = (
        scratch_path(spark, name) for name in ("landing", "staging", "checkpoint")
    )
    raw = _stored_raw(spark, tables)
    for arrival in (raw.where(_is_early()), raw.where(~_is_early()), None):
        if arrival is not None:
            _land(arrival, landing)
        ingest_available_now(spark, landing, target, checkpoint)
    return read_table(spark, target, schemas.STG_TRANSACTIONS_LOADED).drop("load_file")


def _correct(spark: SparkSession, landing: str, corrected: dict[str, Column]) -> None:
    """Put corrected files in the place of the landed ones, under the same names."""
    written = scratch_path(spark, "corrected")
    raw = read_raw_sales(spark, landing).withColumn("file", F.col("_metadata.file_name"))
    rows = raw.withColumns(corrected).repartition("file")  # one part a file
    rows.write.options(**CSV_WRITE_OPTIONS).partitionBy("file").csv(written)
    for file in files_below(spark, written, ".csv"):
        name = file.split("/")[0].removeprefix("file=")
        delete(spark, f"{landing}/{name}")
        rename(spark, f"{written}/{file}", f"{landing}/{name}")


def ingest_corrected(spark: SparkSession, tables: str) -> DataFrame:
    """All raw sales, landed, corrected under their old names, and landed again by content.

    All files are written anew.  The corrections take back all rows of 1996 and the cancellations
    of 1997; the files of other years say what they said and are not taken again.
    """
    landing, target, ledger = (
        scratch_path(spark, name) for name in ("landing", "staging", "ledger")
    )
    _land(_stored_raw(spark, tables), landing)
    ingest_changed(spark, landing, target, ledger)
    year = F.regexp_extract("InvoiceDate", r"/(\d{4}) ", 1)
    back = (year == "1996") | ((year == "1997") & F.col("InvoiceNo").startswith("C"))
    quantity = F.when(back, -F.abs("Quantity")).otherwise(F.col("Quantity"))
    _correct(spark, landing, {"Quantity": quantity})
    for _ in range(2):  # the second run has nothing to take
        ingest_changed(spark, landing, target, ledger)
    return read_table(spark, target, schemas.STG_TRANSACTIONS_LOADED).drop("load_file")


def _is_late() -> Column:
    """Every seventh invoice."""
    return F.pmod(F.crc32(F.col("InvoiceNo").cast("binary")), F.lit(7)) == 0


def refreshed_late_rows(spark: SparkSession, tables: str) -> DataFrame:
    """The daily report after a backfill without, and a daily run with, late rows."""
    base, landing = scratch_path(spark, "warehouse"), scratch_path(spark, "landing")
    raw = _stored_raw(spark, tables)
    _land(raw.where(~_is_late()), landing)
    refresh(spark, base, landing, as_of=LATER)
    _land(raw.where(_is_late()), landing, "late_")
    house = refresh(spark, base, landing, RUN_DATE, LATER)
    return read_table(spark, house.agg_daily_sales, schemas.AGG_DAILY_SALES)


def refreshed_earlier_as_of(spark: SparkSession, tables: str) -> DataFrame:
    """The fact after a backfill up to one day, and then one up to an earlier day."""
    base, landing = scratch_path(spark, "warehouse"), scratch_path(spark, "landing")
    _land(_raw(spark, tables), landing)
    for as_of in (LATER, EARLIER):
        house = refresh(spark, base, landing, as_of=as_of)
    return read_table(spark, house.fact_sales, schemas.FACT_SALES)


def customer_base_merged(spark: SparkSession, tables: str) -> DataFrame:
    """The history of customers in early invoices, with that of later ones merged in by key."""
    path = scratch_path(spark, "customer_base")
    stg = _stored_stg(spark, tables, *_OF_CUSTOMERS)
    later = F.to_date("invoice_date") >= F.lit(SECOND)
    for delivery in (stg.where(~later), stg.where(later)):
        base = customers.customer_base(delivery)
        merge_by_key(base, path, "customer_id", schemas.CUSTOMER_BASE)
    return read_table(spark, path, schemas.CUSTOMER_BASE)


def _discard(spark: SparkSession, landing: str, year: int) -> None:
    for file in files_below(spark, landing, ".csv"):
        if file.startswith(str(year)):
            delete(spark, f"{landing}/{file}")


def customer_base_kept(spark: SparkSession, tables: str) -> DataFrame:
    """The customers' history kept up from partials of loads.

    After late rows have come, the files of 1997 have lost their cancellations and those of 1996
    all their rows.
    """
    house, landing = Warehouse(scratch_path(spark, "warehouse")), scratch_path(spark, "landing")
    raw = _stored_raw(spark, tables)
    _land(raw.where(~_is_late()), landing)
    take_in(spark, house, landing)
    build_dimensions(spark, house, AS_OF)
    delete(spark, house.pending)
    _land(raw.where(_is_late()), landing, "late_")
    take_in(spark, house, landing)
    for year in (1996, 1997):
        _discard(spark, landing, year)
    of_1997 = F.regexp_extract("InvoiceDate", r"/(\d{4}) ", 1) == "1997"
    _land(raw.where(of_1997 & ~F.col("InvoiceNo").startswith("C")), landing, "corrected_")
    for year in (1996, 1997):
        take_in(spark, house, landing, date(year, 12, 31), reload=True)
    build_dimensions(spark, house, AS_OF, whole=False)
    return read_table(spark, house.customer_base, schemas.CUSTOMER_BASE)


def orders_rolled_up(spark: SparkSession, tables: str) -> DataFrame:
    """Orders by day, by month and in all, of each country, from one set of daily bitmaps."""
    stg = _stored_stg(spark, tables, *_OF_CUSTOMERS)
    fact = _fact(stg)
    numbers = distinct.number_keys(marts.named_sales(fact), "invoice_no", "invoice_day")
    daily = stored(
        distinct.daily_orders(fact, customers.customer_countries(stg), numbers), "daily_orders"
    )
    month = F.trunc("sale_date", "month")
    levels = {"day": F.col("sale_date"), "month": month, "all": F.lit(None).cast("date")}
    counts = [
        distinct.counted(
            distinct.rolled_up(daily, period=period, country=F.col("country")),
            "period",
            "country",
            into="orders",
        ).select(F.lit(level).alias("level"), "period", "country", "orders")
        for level, period in levels.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def top_n_products_by_threshold(spark: SparkSession, tables: str) -> DataFrame:
    """The top products of all months, from sums of days by the uniform threshold algorithm."""
    stg = _stored_stg(spark, tables, *_OF_FACT, "description")
    return threshold.top_n_products_monthly(_fact(stg), products.dim_products(stg))


def dim_dates(spark: SparkSession, tables: str) -> DataFrame:
    return calendar.dim_dates(_stg(spark, tables))


def dim_products(spark: SparkSession, tables: str) -> DataFrame:
    return products.dim_products(_stg(spark, tables))


def customer_base(spark: SparkSession, tables: str) -> DataFrame:
    return customers.customer_base(_stg(spark, tables))


def customer_countries(spark: SparkSession, tables: str) -> DataFrame:
    return customers.customer_countries(_stg(spark, tables))


def rfm_measures(spark: SparkSession, tables: str) -> DataFrame:
    return customers.rfm_measures(customers.customer_base(_stg(spark, tables)), AS_OF)


def rfm_scores(spark: SparkSession, tables: str) -> DataFrame:
    return _scores(_stg(spark, tables))


def rfm_segments(spark: SparkSession, tables: str) -> DataFrame:
    return customers.rfm_segments(_scores(_stg(spark, tables)))


def dim_customers(spark: SparkSession, tables: str) -> DataFrame:
    return _customers(_stored_stg(spark, tables, *_OF_CUSTOMERS))


def fact_sales(spark: SparkSession, tables: str) -> DataFrame:
    return _fact(_stg(spark, tables))


def fact_sales_partition_rerun(spark: SparkSession, tables: str) -> DataFrame:
    """The fact as a stored table after one of its days was written a second time."""
    path = scratch_path(spark, "fact_sales")
    cluster = ("customer_id", "stock_code")
    fact = _fact(_stored_stg(spark, tables, *_OF_FACT))
    write_periods(fact, path, "invoice_day", cluster)
    write_periods(fact.where(fact.invoice_day == RUN_DATE), path, "invoice_day", cluster)
    return read_table(spark, path, schemas.FACT_SALES)


def _daily(spark: SparkSession, tables: str, day: date | None) -> DataFrame:
    stg = _stored_stg(spark, tables, *_OF_CUSTOMERS)
    fact, of_customer = _fact(stg), stg
    if day is not None:  # the countries of that day's customers only
        fact = fact.where(F.col("invoice_day") == F.lit(day))
        of_customer = stg.join(fact.select("customer_id").distinct(), "customer_id", "left_semi")
    return marts.agg_daily_sales(fact, customers.customer_countries(of_customer), day)


def _segments(spark: SparkSession, tables: str, month: date | None) -> DataFrame:
    stg = _stored_stg(spark, tables, *_OF_CUSTOMERS)
    return marts.agg_customer_segments_monthly(_fact(stg), _customers(stg), month)


def _top(spark: SparkSession, tables: str, month: date | None) -> DataFrame:
    stg = _stored_stg(spark, tables, *_OF_FACT, "description")
    return marts.top_n_products_monthly(_fact(stg), products.dim_products(stg), month)


def agg_daily_sales(spark: SparkSession, tables: str) -> DataFrame:
    return _daily(spark, tables, RUN_DATE)


def agg_daily_sales_history(spark: SparkSession, tables: str) -> DataFrame:
    return _daily(spark, tables, None)


def agg_customer_segments_monthly(spark: SparkSession, tables: str) -> DataFrame:
    return _segments(spark, tables, RUN_DATE)


def agg_customer_segments_monthly_history(spark: SparkSession, tables: str) -> DataFrame:
    return _segments(spark, tables, None)


def top_n_products_monthly(spark: SparkSession, tables: str) -> DataFrame:
    return _top(spark, tables, RUN_DATE)


def top_n_products_monthly_history(spark: SparkSession, tables: str) -> DataFrame:
    return _top(spark, tables, None)


def _colocated(spark: SparkSession, tables: str) -> Colocated:
    stg = _stored_stg(spark, tables, *dict.fromkeys((*_OF_FACT, *_OF_CUSTOMERS, "description")))
    base = scratch_path(spark, "colocated")
    name = base.rsplit("/", 1)[1].replace("-", "_")
    return colocate(base, name, _fact(stg), _customers(stg), products.dim_products(stg))


def segments_colocated(spark: SparkSession, tables: str) -> DataFrame:
    """Segment performance over all months, from bucketed tables without a shuffle for joins."""
    return _colocated(spark, tables).segments()


def top_products_colocated(spark: SparkSession, tables: str) -> DataFrame:
    """The top products of all months, likewise."""
    return _colocated(spark, tables).top_products()


def entry(spark: SparkSession) -> DataFrame:
    """Segment performance over all months: touches every layer."""
    return agg_customer_segments_monthly_history(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {
        query.__name__: query
        for query in (
            raw_sales_csv,
            raw_sales_with_breaks,
            stg_transactions,
            ingest_landed,
            ingest_corrected,
            dim_dates,
            dim_products,
            customer_base,
            customer_countries,
            rfm_measures,
            rfm_scores,
            rfm_segments,
            dim_customers,
            fact_sales,
            fact_sales_partition_rerun,
            refreshed_late_rows,
            refreshed_earlier_as_of,
            customer_base_merged,
            customer_base_kept,
            orders_rolled_up,
            top_n_products_by_threshold,
            agg_daily_sales,
            agg_daily_sales_history,
            agg_customer_segments_monthly,
            agg_customer_segments_monthly_history,
            top_n_products_monthly,
            top_n_products_monthly_history,
            segments_colocated,
            top_products_colocated,
        )
    }
    if llm is None:
        return own
    return own | llm.queries() | {"pipeline": corpus_pipeline.run}


# --------------------------------------------------------------------------------------
# The same in SQL.  Named parts are put together into one statement per query; each part
# lists the parts it reads.

_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw": (
        (),
        """
        SELECT
          CASE WHEN o_orderkey % 97 = 0 THEN NULL
               WHEN l_returnflag = 'R' THEN 'C' || CAST(o_orderkey AS VARCHAR)
               ELSE CAST(o_orderkey AS VARCHAR) END AS "InvoiceNo",
          CAST(l_partkey AS VARCHAR) AS "StockCode",
          CASE WHEN p_partkey % 17 < 16 THEN p_name || ' ' ||
            ['candle holder', 'BAG', 'jumbo sack', 'storage box', 'pencil case', 'coffee mug',
             'cupboard', 'heart', 'christmas tree', 'kitchen scale', 'wall art', 'poster',
             'vintage sign', 'stand', 'showcase bag', 'plain'][CAST(p_partkey % 17 + 1 AS INTEGER)]
            END AS "Description",
          CASE WHEN o_orderkey % 31 = 0 THEN -CAST(l_quantity AS BIGINT)
               ELSE CAST(l_quantity AS BIGINT) END AS "Quantity",
          CASE WHEN o_orderkey % 53 = 0 THEN 'not a date'
               ELSE strftime(o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)),
                             '%-m/%-d/%Y %-H:%M') END AS "InvoiceDate",
          CASE WHEN l_partkey % 41 = 0 THEN CAST(0 AS DECIMAL(20,9))
               ELSE CAST(p_retailprice AS DECIMAL(20,9)) END AS "UnitPrice",
          CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS "CustomerID",
          n_name AS "Country"
        FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey
        JOIN part ON l_partkey = p_partkey
        JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "stg": (
        ("raw",),
        """
        SELECT "InvoiceNo" AS invoice_no, "StockCode" AS stock_code,
          "Description" AS description, "Quantity" AS quantity,
          try_strptime("InvoiceDate", '%m/%d/%Y %H:%M') AS invoice_date,
          "UnitPrice" AS unit_price, COALESCE("CustomerID", 'ANONYMOUS') AS customer_id,
          "Country" AS country
        FROM raw
        WHERE "Quantity" > 0 AND "UnitPrice" > 0 AND "InvoiceNo" IS NOT NULL
          AND try_strptime("InvoiceDate", '%m/%d/%Y %H:%M') IS NOT NULL""",
    ),
    "dates": (
        ("stg",),
        """
        SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_id, d AS full_date,
          strftime(d, '%A') AS day_name, CAST(dayofweek(d) + 1 AS BIGINT) AS day_of_week,
          CAST(day(d) AS BIGINT) AS day_of_month, CAST(strftime(d, '%U') AS BIGINT) AS week_of_year,
          CAST(month(d) AS BIGINT) AS month, strftime(d, '%B') AS month_name,
          CAST(quarter(d) AS BIGINT) AS quarter, CAST(year(d) AS BIGINT) AS year,
          dayofweek(d) IN (0, 6) AS is_weekend
        FROM (SELECT CAST(unnest(generate_series(
                CAST(min(invoice_date) AS DATE), CAST(max(invoice_date) AS DATE),
                INTERVAL 1 DAY)) AS DATE) AS d FROM stg)""",
    ),
    "products": (
        ("stg",),
        """
        SELECT stock_code, description,
          CASE WHEN lower(description) LIKE '%candle%' THEN 'Candles'
               WHEN regexp_matches(lower(description), 'bag|sack') THEN 'Bags'
               WHEN regexp_matches(lower(description), 'box|case') THEN 'Boxes & Cases'
               WHEN regexp_matches(lower(description), 'mug|cup') THEN 'Mugs & Cups'
               WHEN lower(description) LIKE '%heart%' THEN 'Heart Items'
               WHEN lower(description) LIKE '%christmas%' THEN 'Christmas'
               WHEN lower(description) LIKE '%kitchen%' THEN 'Kitchenware'
               WHEN regexp_matches(lower(description), 'wall art|poster') THEN 'Wall Art'
               WHEN lower(description) LIKE '%vintage%' THEN 'Vintage'
               WHEN regexp_matches(lower(description), 'holder|stand') THEN 'Holders & Stands'
               ELSE 'Other' END AS product_category
        FROM (SELECT stock_code, min(description) AS description FROM stg GROUP BY stock_code)""",
    ),
    "base": (
        ("stg",),
        """
        SELECT customer_id, CAST(min(invoice_date) AS DATE) AS first_invoice_date,
          CAST(max(invoice_date) AS DATE) AS last_invoice_date,
          count(DISTINCT invoice_no) AS total_orders,
          CAST(sum(CAST(quantity AS DECIMAL(17,0)) * unit_price) AS DECIMAL(38,9)) AS total_spent
        FROM stg WHERE customer_id <> 'ANONYMOUS' GROUP BY customer_id""",
    ),
    "merged": (
        ("stg",),
        """
        SELECT customer_id, CAST(min(invoice_date) AS DATE) AS first_invoice_date,
          CAST(max(invoice_date) AS DATE) AS last_invoice_date,
          count(DISTINCT invoice_no) AS total_orders,
          CAST(sum(CAST(quantity AS DECIMAL(17,0)) * unit_price) AS DECIMAL(38,9)) AS total_spent
        FROM (SELECT *, max(invoice_date) OVER (PARTITION BY customer_id) >= DATE '1998-01-01'
              AS comes_again FROM stg WHERE customer_id <> 'ANONYMOUS')
        WHERE NOT comes_again OR invoice_date >= DATE '1998-01-01'
        GROUP BY customer_id""",
    ),
    "orders": (
        ("fact", "countries"),
        """
        SELECT CASE WHEN grouping(sale_date) = 0 THEN 'day' WHEN grouping(month) = 0 THEN 'month'
            ELSE 'all' END AS level,
          coalesce(sale_date, month) AS period, country,
          count(DISTINCT invoice_no) AS orders
        FROM (SELECT invoice_day AS sale_date, CAST(date_trunc('month', invoice_day) AS DATE) AS month,
                country, invoice_no FROM fact JOIN countries USING (customer_id))
        GROUP BY GROUPING SETS ((sale_date, country), (month, country), (country))""",
    ),
    "countries": (
        ("stg",),
        "SELECT DISTINCT customer_id, country FROM stg WHERE customer_id <> 'ANONYMOUS'",
    ),
    "measures": (
        ("base",),
        """
        SELECT customer_id, first_invoice_date, last_invoice_date,
          CAST(date_diff('day', last_invoice_date, DATE '2001-08-02') AS BIGINT) AS recency_days,
          total_orders AS frequency, total_spent AS monetary
        FROM base""",
    ),
    "scores": (
        ("measures",),
        """
        SELECT *,
          CAST(ntile(5) OVER (ORDER BY recency_days DESC, customer_id) AS BIGINT) AS r_score,
          CAST(ntile(5) OVER (ORDER BY frequency, customer_id) AS BIGINT) AS f_score,
          CAST(ntile(5) OVER (ORDER BY monetary, customer_id) AS BIGINT) AS m_score
        FROM measures""",
    ),
    "segments": (
        ("scores",),
        """
        SELECT customer_id, first_invoice_date, last_invoice_date,
          recency_days AS rfm_recency, frequency AS rfm_frequency, monetary AS rfm_monetary,
          CAST(100 * r_score + 10 * f_score + m_score AS VARCHAR) AS rfm_score,
          CASE WHEN least(r_score, f_score, m_score) >= 4 THEN 'Champions'
               WHEN least(r_score, f_score, m_score) >= 3 THEN 'Loyal Customers'
               WHEN r_score >= 4 AND least(f_score, m_score) >= 2 THEN 'Potential Loyalists'
               WHEN r_score >= 4 AND greatest(f_score, m_score) <= 1 THEN 'New Customers'
               WHEN r_score >= 3 AND greatest(f_score, m_score) <= 2 THEN 'Promising'
               WHEN r_score <= 2 AND least(f_score, m_score) >= 3 THEN 'At Risk'
               WHEN r_score <= 2 AND least(f_score, m_score) >= 4 THEN 'Can''t Lose Them'
               WHEN greatest(r_score, f_score, m_score) <= 2 THEN 'Hibernating'
               ELSE 'Other' END AS rfm_segment
        FROM scores""",
    ),
    "customers": (
        ("segments", "countries"),
        """
        SELECT customer_id, country, first_invoice_date, last_invoice_date, rfm_recency,
          rfm_frequency, rfm_monetary, rfm_score, rfm_segment
        FROM segments LEFT JOIN countries USING (customer_id)""",
    ),
    "fact": (
        ("stg",),
        """
        SELECT CAST(strftime(invoice_date, '%Y%m%d') AS BIGINT) AS date_id, invoice_no,
          invoice_date, customer_id, stock_code, quantity, unit_price,
          CAST(CAST(quantity AS DECIMAL(17,0)) * unit_price AS DECIMAL(38,9))
            AS line_item_total_amount,
          CAST(invoice_date AS DATE) AS invoice_day
        FROM stg
        WHERE CAST(invoice_date AS DATE) <= DATE '2001-08-02' AND invoice_no NOT LIKE 'C%'""",
    ),
    # Averages below are taken in whole billionths, half up, since this engine's avg
    # and division of decimals are floating point.
    "daily": (
        ("fact", "countries"),
        """
        SELECT invoice_day AS sale_date, country,
          CAST(sum(line_item_total_amount) AS DECIMAL(38,9)) AS total_daily_sales,
          CAST(sum(quantity) AS BIGINT) AS total_daily_quantity,
          count(DISTINCT invoice_no) AS total_daily_orders,
          CAST(CAST((2 * sum(nano // quantity) + count(*)) // (2 * count(*)) AS DECIMAL(28,0))
            * CAST('0.000000001' AS DECIMAL(10,9)) AS DECIMAL(38,9)) AS average_unit_price
        FROM (SELECT *, quantity * CAST(unit_price * 1000000000 AS HUGEINT) AS nano FROM fact)
        JOIN countries USING (customer_id)
        GROUP BY 1, 2""",
    ),
    "segments_monthly": (
        ("fact", "customers"),
        """
        SELECT CAST(date_trunc('month', invoice_day) AS DATE) AS month_start_date, rfm_segment,
          count(DISTINCT customer_id) AS distinct_customers_in_segment,
          CAST(sum(line_item_total_amount) AS DECIMAL(38,9)) AS total_segment_sales,
          CAST(CAST((2 * sum(nano) + count(*)) // (2 * count(*)) AS DECIMAL(28,0))
            * CAST('0.000000001' AS DECIMAL(10,9)) AS DECIMAL(38,9))
            AS average_order_value_in_segment
        FROM (SELECT *, quantity * CAST(unit_price * 1000000000 AS HUGEINT) AS nano FROM fact)
        JOIN customers USING (customer_id)
        GROUP BY 1, 2""",
    ),
    "top": (
        ("fact", "products"),
        """
        SELECT *, row_number() OVER (PARTITION BY month_start_date
            ORDER BY total_sales_this_month DESC, stock_code) AS rank_this_month
        FROM (SELECT CAST(date_trunc('month', invoice_day) AS DATE) AS month_start_date,
                stock_code, description, product_category,
                CAST(sum(line_item_total_amount) AS DECIMAL(38,9)) AS total_sales_this_month
              FROM fact JOIN products USING (stock_code) GROUP BY 1, 2, 3, 4)
        QUALIFY rank_this_month <= 10""",
    ),
}


def _sql(part: str, where: str = "") -> str:
    """``SELECT * FROM part`` with the parts it rests on spelled out before it."""
    needed: dict[str, str] = {}

    def require(name: str) -> None:
        reads, text = _PARTS[name]
        for read in reads:
            require(read)
        needed.setdefault(name, text)

    require(part)
    named = ",\n".join(f"{name} AS ({text})" for name, text in needed.items())
    return f"WITH {named}\nSELECT * FROM {part} {where}".rstrip()


def oracle_sql() -> dict[str, str]:
    day = "WHERE sale_date = DATE '1998-06-15'"
    month = "WHERE month_start_date = DATE '1998-06-01'"
    own = {
        "raw_sales_csv": _sql("raw"),
        "raw_sales_with_breaks": _sql("raw").replace(
            "SELECT * FROM raw",
            """SELECT * REPLACE (CASE WHEN length("StockCode") % 2 = 0
                THEN "Description" || chr(10) || 'second "line", of two'
                ELSE "Description" END AS "Description") FROM raw""",
        ),
        "stg_transactions": _sql("stg"),
        "ingest_landed": _sql("stg").replace(
            "SELECT * FROM stg",
            "SELECT *, make_date(year(invoice_date), 12, 31) AS load_date FROM stg",
        ),
        "dim_dates": _sql("dates"),
        "dim_products": _sql("products"),
        "customer_base": _sql("base"),
        "customer_countries": _sql("countries"),
        "rfm_measures": _sql("measures"),
        "rfm_scores": _sql("scores"),
        "rfm_segments": _sql("segments"),
        "dim_customers": _sql("customers"),
        "fact_sales": _sql("fact"),
        "fact_sales_partition_rerun": _sql("fact"),
        "refreshed_late_rows": _sql("daily").replace(str(AS_OF), str(LATER)),
        "refreshed_earlier_as_of": _sql("fact").replace(str(AS_OF), str(EARLIER)),
        "agg_daily_sales": _sql("daily", day),
        "agg_daily_sales_history": _sql("daily"),
        "agg_customer_segments_monthly": _sql("segments_monthly", month),
        "agg_customer_segments_monthly_history": _sql("segments_monthly"),
        "top_n_products_monthly": _sql("top", month),
        "top_n_products_monthly_history": _sql("top"),
    }
    base = "FROM stg WHERE customer_id <> 'ANONYMOUS'"
    kept = "year(invoice_date) <> 1996 AND (year(invoice_date) <> 1997 OR invoice_no NOT LIKE 'C%')"
    loaded = own["ingest_landed"]
    own |= {
        "ingest_corrected": f"{loaded} WHERE {kept}",
        "customer_base_merged": _sql("merged"),
        "customer_base_kept": _sql("base").replace(base, f"{base} AND {kept}"),
        "orders_rolled_up": _sql("orders"),
        "top_n_products_by_threshold": _sql("top"),
        "segments_colocated": _sql("segments_monthly"),
        "top_products_colocated": _sql("top"),
    }
    if llm is None:
        return own
    piped = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return own | llm.oracle_sql() | piped
