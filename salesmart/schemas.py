"""Column layout of every table, from the landed files to the marts.

All whole numbers are BIGINT and all money is DECIMAL(38,9), so that sums,
quotients and averages keep nine decimals all the way through.  Unit prices
are DECIMAL(20,9) and quantities enter a product as DECIMAL(17,0): the product
is then exactly DECIMAL(38,9) and Spark never trades decimals for digits.
"""

from pyspark.sql import types as T

UNIT_PRICE = T.DecimalType(20, 9)
MONEY = T.DecimalType(38, 9)

#: Fixed value: stands in for a missing customer number.
ANONYMOUS = "ANONYMOUS"


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_TEXT, _LONG, _DATE, _TIME = T.StringType(), T.LongType(), T.DateType(), T.TimestampNTZType()

RAW_SALES = _table(
    InvoiceNo=_TEXT,
    StockCode=_TEXT,
    Description=_TEXT,
    Quantity=_LONG,
    InvoiceDate=_TEXT,
    UnitPrice=UNIT_PRICE,
    CustomerID=_TEXT,
    Country=_TEXT,
)

CATEGORY_NAMES = _table(product_category_name=_TEXT, product_category_name_english=_TEXT)

STG_TRANSACTIONS = _table(
    invoice_no=_TEXT,
    stock_code=_TEXT,
    description=_TEXT,
    quantity=_LONG,
    invoice_date=_TIME,
    unit_price=UNIT_PRICE,
    customer_id=_TEXT,
    country=_TEXT,
)

#: Staging as it lies on disk: one partition per landed file, below its day.
STG_TRANSACTIONS_LOADED = T.StructType(
    [
        *STG_TRANSACTIONS.fields,
        T.StructField("load_date", _DATE),
        T.StructField("load_file", T.StringType()),
    ]
)

#: The landed files taken, by content (``streaming.ledger``).
LEDGER = _table(file=_TEXT, length=_LONG, modified=T.TimestampType(), digest=_TEXT)

DIM_DATES = _table(
    date_id=_LONG,
    full_date=_DATE,
    day_name=_TEXT,
    day_of_week=_LONG,
    day_of_month=_LONG,
    week_of_year=_LONG,
    month=_LONG,
    month_name=_TEXT,
    quarter=_LONG,
    year=_LONG,
    is_weekend=T.BooleanType(),
)

DIM_PRODUCTS = _table(stock_code=_TEXT, description=_TEXT, product_category=_TEXT)

CUSTOMER_BASE = _table(
    customer_id=_TEXT,
    first_invoice_date=_DATE,
    last_invoice_date=_DATE,
    total_orders=_LONG,
    total_spent=MONEY,
)

#: Partials of a load (``operators.partials``).
INVOICES_BY_LOAD = _table(
    customer_id=_TEXT,
    country=_TEXT,
    invoice_no=_TEXT,
    invoice_day=_DATE,
    amount=MONEY,
    load_date=_DATE,
)

PRODUCTS_BY_LOAD = _table(stock_code=_TEXT, description=_TEXT, load_date=_DATE)

DIM_CUSTOMERS = _table(
    customer_id=_TEXT,
    country=_TEXT,
    first_invoice_date=_DATE,
    last_invoice_date=_DATE,
    rfm_recency=_LONG,
    rfm_frequency=_LONG,
    rfm_monetary=MONEY,
    rfm_score=_TEXT,
    rfm_segment=_TEXT,
)

FACT_SALES = _table(
    date_id=_LONG,
    invoice_no=_TEXT,
    invoice_date=_TIME,
    customer_id=_TEXT,
    stock_code=_TEXT,
    quantity=_LONG,
    unit_price=UNIT_PRICE,
    line_item_total_amount=MONEY,
    invoice_day=_DATE,
)

AGG_DAILY_SALES = _table(
    sale_date=_DATE,
    country=_TEXT,
    total_daily_sales=MONEY,
    total_daily_quantity=_LONG,
    total_daily_orders=_LONG,
    average_unit_price=MONEY,
)

AGG_CUSTOMER_SEGMENTS_MONTHLY = _table(
    month_start_date=_DATE,
    rfm_segment=_TEXT,
    distinct_customers_in_segment=_LONG,
    total_segment_sales=MONEY,
    average_order_value_in_segment=MONEY,
)

TOP_N_PRODUCTS_MONTHLY = _table(
    month_start_date=_DATE,
    stock_code=_TEXT,
    description=_TEXT,
    product_category=_TEXT,
    total_sales_this_month=MONEY,
    rank_this_month=_LONG,
)
