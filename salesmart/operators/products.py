"""Product dimension."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.rules import product_category


def dim_products(stg: DataFrame) -> DataFrame:
    """One row per stock code, with one of its descriptions and the category of that.

    Any description would do; the smallest is taken so that runs agree.  The
    distinct step comes first because Spark sorts its input for a minimum of texts:
    distinct hashes the whole scan down to the few spellings of each code, and only
    those are sorted.  (With MIN, which duplicates cannot change, the optimizer would
    drop the distinct step as redundant; MIN_BY gives the same text and keeps it.)
    """
    spellings = stg.select("stock_code", "description").distinct()
    return (
        spellings.groupBy("stock_code")
        .agg(F.min_by("description", "description").alias("description"))
        .withColumn("product_category", product_category(F.col("description")))
    )
