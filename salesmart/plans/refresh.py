"""The daily run: landed files to staging, star schema and marts on disk."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart import schemas
from salesmart.functions.dates import month_start
from salesmart.operators import calendar, customers, facts, marts, partials
from salesmart.plans.scratch import stored
from salesmart.plans.sizing import fitted_shuffles
from salesmart.sinks.merge import merge_by_key
from salesmart.sinks.tables import delete, exists, read_table, write_periods, write_replace
from salesmart.streaming.landing import ingest_available_now, reload_day
from salesmart.streaming.ledger import ingest_changed

_FACT_CLUSTER = ("customer_id", "stock_code")


@dataclass(frozen=True)
class Warehouse:
    """Where the tables lie: three layers under one folder."""

    base: str

    def path(self, layer: str, table: str) -> str:
        return f"{self.base}/{layer}/{table}"

    @property
    def stg_transactions(self) -> str:
        return self.path("staging", "stg_transactions")

    @property
    def checkpoint(self) -> str:
        return self.path("staging", "_checkpoint")

    @property
    def ledger(self) -> str:
        """Landed files by content; only runs that take files by content keep it."""
        return self.path("staging", "_ledger")

    @property
    def pending(self) -> str:
        """What tables still have to be brought up to date for; empty between runs."""
        return self.path("staging", "_pending")

    @property
    def invoices_by_load(self) -> str:
        return self.path("dwh", "invoices_by_load")

    @property
    def products_by_load(self) -> str:
        return self.path("dwh", "products_by_load")

    @property
    def customer_base(self) -> str:
        return self.path("dwh", "customer_base")

    @property
    def dim_dates(self) -> str:
        return self.path("dwh", "dim_dates")

    @property
    def dim_products(self) -> str:
        return self.path("dwh", "dim_products")

    @property
    def dim_customers(self) -> str:
        return self.path("dwh", "dim_customers")

    @property
    def fact_sales(self) -> str:
        return self.path("dwh", "fact_sales")

    @property
    def agg_daily_sales(self) -> str:
        return self.path("analytics", "agg_daily_sales")

    @property
    def agg_customer_segments_monthly(self) -> str:
        return self.path("analytics", "agg_customer_segments_monthly")

    @property
    def top_n_products_monthly(self) -> str:
        return self.path("analytics", "top_n_products_monthly")


def refresh(
    spark: SparkSession,
    base: str,
    landing: str,
    run_date: date | None = None,
    as_of: date | None = None,
    archive: str | None = None,
    reload: bool = False,
    by_content: bool = False,
) -> Warehouse:
    """Take in what has landed and bring every table up to date.

    With ``run_date`` the loads just taken are read for their partials, and merged by key
    into the dimensions for the customers and products they touch.  That day and every day
    found in these loads are rewritten in the fact, and in the reports the months of
    them and of all sales whose customer or product has changed in the dimensions.  So, run
    after run with one ``as_of``, the tables equal a backfill, however late rows and files
    come, but of staging only the loads that hold rows of these days are read.  ``reload``
    takes the file of ``run_date`` again; with ``by_content`` every file is taken whose content
    is not the one taken before.  Without ``run_date`` every table is replaced as a whole: the
    backfill, also for an earlier ``as_of``.

    Any run may be repeated.  What a run has still to do is written down before the tables
    it follows from are touched, so the next run makes up for one that died.
    """
    house = Warehouse(base)
    if as_of is None:
        as_of = spark.sql("SELECT current_date()").first()[0]

    take_in(spark, house, landing, run_date, archive, reload, by_content)
    with fitted_shuffles(spark, house.stg_transactions):
        build_dimensions(spark, house, as_of, whole=run_date is None)
        if run_date is None:
            build_fact(spark, house, as_of)
            build_marts(spark, house)
        else:
            days = _pending(spark, house, "days", "day date").unionByName(
                spark.createDataFrame([(run_date,)], "day date")
            )
            days = stored(days.distinct(), "days")
            build_fact(spark, house, as_of, days)
            build_marts(spark, house, days)
    delete(spark, house.pending)
    return house


def take_in(
    spark: SparkSession,
    house: Warehouse,
    landing: str,
    run_date: date | None = None,
    archive: str | None = None,
    reload: bool = False,
    by_content: bool = False,
) -> None:
    """Bring what has landed into staging, and note what follows from it.

    ``by_content`` asks the ledger which files are new or corrected, instead of the stream's
    checkpoint; it moves no file to ``archive``.
    """

    def taken(rows: DataFrame) -> None:
        _note(house, "days", rows.select(F.to_date("invoice_date").alias("day")).distinct())
        _note(house, "loads", rows.select("load_date").distinct())

    if by_content:
        ingest_changed(spark, landing, house.stg_transactions, house.ledger, taken=taken)
    else:
        ingest_available_now(
            spark, landing, house.stg_transactions, house.checkpoint, archive, taken=taken
        )
    if reload and run_date is not None:
        reload_day(spark, landing, house.stg_transactions, run_date, taken)


def _note(house: Warehouse, what: str, rows: DataFrame) -> None:
    rows.write.mode("append").parquet(f"{house.pending}/{what}")


def _pending(spark: SparkSession, house: Warehouse, what: str, schema: str) -> DataFrame:
    path = f"{house.pending}/{what}"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).distinct()


def _staging(spark: SparkSession, house: Warehouse) -> DataFrame:
    return read_table(spark, house.stg_transactions, schemas.STG_TRANSACTIONS_LOADED)


def _invoices(spark: SparkSession, house: Warehouse) -> DataFrame:
    return read_table(spark, house.invoices_by_load, schemas.INVOICES_BY_LOAD)


def _products(spark: SparkSession, house: Warehouse) -> DataFrame:
    return read_table(spark, house.products_by_load, schemas.PRODUCTS_BY_LOAD)


def build_partials(spark: SparkSession, house: Warehouse, whole: bool = False) -> bool:
    """Bring the partials of the loads just taken up to date; whether it was those of all.

    Reads no other load.  The customers and products of these loads, before and after, are
    noted first.
    """
    tables = (
        (partials.invoices_by_load, house.invoices_by_load, "customer_id", "touched_customers"),
        (partials.products_by_load, house.products_by_load, "stock_code", "touched_products"),
    )
    if whole or not all(exists(spark, path) for _, path, _, _ in tables):
        stg = _staging(spark, house)
        for summed, path, key, _ in tables:
            write_replace(summed(stg), path, "load_date", [key])
        return True
    loads = _dates(_pending(spark, house, "loads", "load_date date"), "load_date")
    if loads:
        stg = _staging(spark, house).where(_is_one_of("load_date", loads))
        for (summed, path, key, noted), read in zip(tables, (_invoices, _products)):
            new = stored(summed(stg), "partials")
            old = read(spark, house).where(_is_one_of("load_date", loads))
            _note(house, noted, old.select(key).unionByName(new.select(key)).distinct())
            write_periods(new, path, "load_date", [key], loads)
    return False


def _is_one_of(column: str, days: list[date | None]) -> Column:
    """Whether a partition column has one of these values, null among them or not."""
    known = F.col(column).isin([day for day in days if day is not None])
    return known | F.col(column).isNull() if None in days else known


def build_dimensions(
    spark: SparkSession, house: Warehouse, as_of: date, whole: bool = True
) -> None:
    """Bring the three dimensions up to date from the partials.

    Unless ``whole``, only the customers and products of the loads just taken are put together
    anew, and merged into the others.
    """
    whole = build_partials(spark, house, whole)
    invoices = _invoices(spark, house)
    days = invoices.select(F.col("invoice_day").alias("invoice_date"))
    write_replace(calendar.dim_dates(days), house.dim_dates)

    def note(keys: DataFrame, what: str) -> None:
        _note(house, what, keys)

    def merged(new, rows, what, key, path, schema, noted=None) -> None:
        touched = None
        if not whole:
            touched = stored(_pending(spark, house, f"touched_{what}", f"{key} string"), "touched")
            rows = partials.of_keys(rows, touched, key)
        merge_by_key(new(rows), path, key, schema, touched, complete=whole, noted=noted)

    merged(
        partials.dim_products,
        _products(spark, house),
        "products",
        "stock_code",
        house.dim_products,
        schemas.DIM_PRODUCTS,
        lambda keys: note(keys, "products"),
    )
    merged(
        partials.customer_base,
        invoices,
        "customers",
        "customer_id",
        house.customer_base,
        schemas.CUSTOMER_BASE,
    )
    # Scores rank all customers, so that any of them may change.
    base = read_table(spark, house.customer_base, schemas.CUSTOMER_BASE)
    segments = customers.rfm_segments(customers.rfm_scores(base, as_of))
    merge_by_key(
        customers.dim_customers(segments, partials.customer_countries(invoices)),
        house.dim_customers,
        "customer_id",
        schemas.DIM_CUSTOMERS,
        complete=True,
        noted=lambda keys: note(keys, "customers"),
    )


def build_fact(
    spark: SparkSession, house: Warehouse, as_of: date, days: DataFrame | None = None
) -> None:
    """Rewrite the fact for ``days`` (a column day), or replace it as a whole.

    A day rewritten takes all its rows, whichever file they came in: the partials tell which
    loads have some.  The range lets Parquet skip the row groups of other days.
    """
    stg = _staging(spark, house)
    if days is None:
        write_replace(
            facts.fact_sales(stg, as_of), house.fact_sales, "invoice_day", _FACT_CLUSTER
        )
        return
    first, last = days.agg(F.min("day"), F.max("day")).first()
    day = F.to_date("invoice_date")
    sold = _invoices(spark, house).join(days, F.col("invoice_day") == F.col("day"), "left_semi")
    loads = _dates(sold.select("load_date").distinct(), "load_date")
    some = (
        stg.where(_is_one_of("load_date", loads))
        .where(day.between(F.lit(first), F.lit(last)))
        .join(days, day == F.col("day"), "left_semi")
    )
    write_periods(
        facts.fact_sales(some, as_of),
        house.fact_sales,
        "invoice_day",
        _FACT_CLUSTER,
        _dates(days, "day"),
    )


def _dates(periods: DataFrame, column: str) -> list[date | None]:
    """Days or months as a list: partitions, which the driver lists whenever it reads."""
    return [row[0] for row in periods.select(column).collect()]


def build_marts(spark: SparkSession, house: Warehouse, days: DataFrame | None = None) -> None:
    """Rewrite the marts for ``days`` and what changed in the dimensions, or replace them.

    All of them are kept by month, and rewritten for the months touched.
    """
    fact = read_table(spark, house.fact_sales, schemas.FACT_SALES)
    customer = read_table(spark, house.dim_customers, schemas.DIM_CUSTOMERS)
    product = read_table(spark, house.dim_products, schemas.DIM_PRODUCTS)
    tables = (
        (_daily_by_month, customer, house.agg_daily_sales, "sale_month", "sale_date"),
        (
            marts.agg_customer_segments_monthly,
            customer,
            house.agg_customer_segments_monthly,
            "month_start_date",
            "rfm_segment",
        ),
        (
            marts.top_n_products_monthly,
            product,
            house.top_n_products_monthly,
            "month_start_date",
            "rank_this_month",
        ),
    )
    if days is None:
        for mart, dimension, path, period, cluster in tables:
            write_replace(mart(fact, dimension), path, period, [cluster])
        return
    by_customer = _days_sold(spark, house, fact, "customers", "customer_id")
    by_product = _days_sold(spark, house, fact, "products", "stock_code")
    for mart, dimension, path, period, cluster in tables:
        touched = days.unionByName(by_product if dimension is product else by_customer)
        touched = touched.select(month_start(F.col("day")).alias("period")).distinct()
        touched = stored(touched, "periods")
        # A semi-join on the partition column: Spark reads those partitions only.
        within = F.explode(F.sequence("period", F.last_day("period"))).alias("_day")
        some = fact.join(touched.select(within), F.col("invoice_day") == F.col("_day"), "left_semi")
        write_periods(mart(some, dimension), path, period, [cluster], _dates(touched, "period"))


def _daily_by_month(fact: DataFrame, customer: DataFrame) -> DataFrame:
    """The daily report, which has a folder a month: a day has a row for each country only."""
    daily = marts.agg_daily_sales(fact, customer)
    return daily.withColumn("sale_month", month_start(F.col("sale_date")))


def _days_sold(
    spark: SparkSession, house: Warehouse, fact: DataFrame, what: str, key: str
) -> DataFrame:
    """Days on which the changed customers or products had sales."""
    changed = _pending(spark, house, what, f"{key} string")
    sold = fact.join(changed, key, "left_semi").select(F.col("invoice_day").alias("day"))
    return stored(sold.distinct(), f"days_of_{what}")
