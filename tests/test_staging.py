from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesmart import schemas
from salesmart.functions.dates import parse_invoice_time
from salesmart.operators.staging import stg_transactions

TIMES = {
    "12/1/2010 8:26": datetime(2010, 12, 1, 8, 26),
    "01/02/2010 08:05": datetime(2010, 1, 2, 8, 5),
    "  12/1/2010   8:26 ": datetime(2010, 12, 1, 8, 26),
    "12/1/2010 8:5": datetime(2010, 12, 1, 8, 5),
    "2/29/2012 23:59": datetime(2012, 2, 29, 23, 59),
    "3/11/2007 2:30": datetime(2007, 3, 11, 2, 30),  # does not exist in New York
    "13/1/2010 8:26": None,
    "2/30/2010 8:26": None,
    "12/1/2010 24:00": None,
    "12/1/2010 8:60": None,
    "12/1/2010": None,
    "12/1/10 8:26": None,
    "12/1/2010 8:26:00": None,
    "2010-12-01 08:26": None,
    "not a date": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_invoice_time(spark, with_settings, zone):
    with_settings(spark__sql__session__timeZone=zone)
    texts = spark.createDataFrame([(text,) for text in TIMES], "text string")
    parsed = texts.select("text", parse_invoice_time(F.col("text")).alias("time")).collect()
    assert {row.text: row.time for row in parsed} == TIMES


def test_only_sound_rows_are_kept(spark):
    good = ("1", "A", "thing", 2, "12/1/2010 8:26", Decimal("2.55"), "7", "France")

    def but(**changes):
        return tuple({**dict(zip(schemas.RAW_SALES.names, good)), **changes}.values())

    raw = spark.createDataFrame(
        [
            good,
            but(CustomerID=None),
            but(InvoiceNo="C2", Description=None, Country=None),
            but(InvoiceNo=None),
            but(Quantity=0),
            but(Quantity=-2),
            but(Quantity=None),
            but(UnitPrice=Decimal(0)),
            but(UnitPrice=None),
            but(InvoiceDate="13/1/2010 8:26"),
            but(InvoiceDate=None),
        ],
        schemas.RAW_SALES,
    )
    clean = stg_transactions(raw)
    assert [f.dataType for f in clean.schema] == [f.dataType for f in schemas.STG_TRANSACTIONS]
    time, price = datetime(2010, 12, 1, 8, 26), Decimal("2.55")
    assert [tuple(row) for row in clean.collect()] == [
        ("1", "A", "thing", 2, time, price, "7", "France"),
        ("1", "A", "thing", 2, time, price, "ANONYMOUS", "France"),
        ("C2", "A", None, 2, time, price, "7", None),
    ]
