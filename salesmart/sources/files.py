"""Readers of landed CSV files.

A row is a line: files are read in parts, from any line on.  A text with a line break in it
breaks its row in two, neither of which fits the schema, and so stops the job.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.schemas import CATEGORY_NAMES, RAW_SALES

# Fixed value: the landed file of a day is named after it.
SALES_FILE = "{day:%Y%m%d}_*sales.csv"  # also its parts, like 20101201_2_sales.csv
SALES_FILES = "*_sales.csv"

# Comma-separated, one header row, a quote inside quotes is doubled.
CSV_FORMAT = {"header": "true", "sep": ",", "quote": '"', "escape": '"'}

# A row that does not fit the schema stops the job, where the default would turn a bad
# number into NULL and let the quality filters drop the row unseen.  (Staging reads both
# number columns.)  The parser takes all columns so that a row of the wrong width is
# noticed whichever columns a query reads.
# A bare empty field is NULL, a quoted one is an empty text: by default Spark takes both
# for NULL, unless the mark for NULL is something else, here a text that cannot occur.
CSV_OPTIONS = {**CSV_FORMAT, "mode": "FAILFAST", "columnPruning": "false", "nullValue": "\0"}


# Spark trims texts when it writes, unless told not to.
CSV_WRITE_OPTIONS = {
    **CSV_FORMAT,
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


#: The name of the file that a row was read from, as it stands in a URL.
SPELT = "_metadata.file_name"


def file_name(spelt: str = SPELT) -> Column:
    """The name of the file that a row was read from.  Spark has it as it stands in a URL."""
    return F.url_decode(F.replace(spelt, F.lit("+"), F.lit("%2B")))


def read_raw_sales(spark: SparkSession, path: str, day: date | None = None) -> DataFrame:
    """Raw sales of one day's file, or of every file in the folder."""
    reader = spark.read.schema(RAW_SALES).options(**CSV_OPTIONS)
    if day is not None:
        reader = reader.option("pathGlobFilter", SALES_FILE.format(day=day))
    return reader.csv(path)


def read_category_names(spark: SparkSession, path: str) -> DataFrame:
    """Lookup of product category names and their English names."""
    return spark.read.schema(CATEGORY_NAMES).options(**CSV_OPTIONS).csv(path)
