from datetime import date, timedelta

from pyspark.sql import functions as F

from salesmart import schemas
from salesmart.functions.dates import week_from_sunday
from salesmart.operators.calendar import dim_dates


def test_weeks_around_new_year(spark):
    days = [
        date(year, 1, 1) + timedelta(days=offset)
        for year in range(1995, 2013)
        for offset in range(-7, 8)
    ]
    frame = spark.createDataFrame([(day,) for day in days], "day date")
    weeks = frame.select("day", week_from_sunday(F.col("day")).alias("week")).collect()
    assert {row.day: row.week for row in weeks} == {d: int(d.strftime("%U")) for d in days}
    assert {row.week for row in weeks} >= {0, 53}


def test_every_day_once(spark, staged):
    stg = staged(
        ("1", "A", "7", "France", "2011-12-30T23:59", 1, "1"),
        ("2", "A", "7", "France", "2012-03-01T00:00", 1, "1"),
    )
    calendar = dim_dates(stg)
    assert [f.dataType for f in calendar.schema] == [f.dataType for f in schemas.DIM_DATES]
    rows = {row.full_date: row for row in calendar.collect()}
    expected = [date(2011, 12, 30) + timedelta(days=i) for i in range(63)]
    assert sorted(rows) == expected and calendar.count() == 63
    assert tuple(rows[date(2012, 1, 1)]) == (
        20120101, date(2012, 1, 1), "Sunday", 1, 1, 1, 1, "January", 1, 2012, True,
    )
    assert tuple(rows[date(2012, 2, 29)]) == (
        20120229, date(2012, 2, 29), "Wednesday", 4, 29, 9, 2, "February", 1, 2012, False,
    )


def test_no_transactions(staged):
    assert dim_dates(staged().limit(0)).count() == 0
