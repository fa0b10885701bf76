"""Reading landed files, writing tables, and the daily run between them."""

from collections import Counter
from datetime import date
from pathlib import Path

import pytest
from pyspark.errors import PySparkException

from salesmart import schemas
from salesmart.operators import marts
from salesmart.operators.staging import stg_transactions
from salesmart.plans import refresh as daily
from salesmart.plans.scratch import release, stored
from salesmart.sinks.tables import read_table, write_periods
from salesmart.sources.files import CSV_WRITE_OPTIONS, read_category_names, read_raw_sales
from salesmart.streaming import landing
from salesmart.streaming.landing import ingest_available_now

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
DAYS = {
    "20101201": ["1,A,mug,2,12/1/2010 8:26,2.55,7,France", "2,B,bag,1,12/1/2010 9:00,1,,France"],
    "20101202": ["3,A,mug,1,12/2/2010 8:26,2.55,8,Spain", "C4,A,mug,1,12/2/2010 8:30,2.55,8,Spain"],
    # A late row of the first day.
    "20101203": ["5,B,bag,4,12/3/2010 8:26,1,7,France", "6,A,mug,1,12/1/2010 9:30,2.55,9,Italy"],
}


def land(folder: Path, day: str):
    folder.mkdir(exist_ok=True)
    (folder / f"{day}_sales.csv").write_text(HEADER + "\n".join(DAYS[day]) + "\n")


def rows(df):
    return Counter(tuple(row) for row in df.collect())


def test_raw_sales_of_a_day_and_of_all_days(spark, tmp_path):
    for day in DAYS:
        land(tmp_path, day)
    one = read_raw_sales(spark, str(tmp_path), date(2010, 12, 2))
    assert one.schema == schemas.RAW_SALES
    assert [r.InvoiceNo for r in one.collect()] == ["3", "C4"]
    assert read_raw_sales(spark, str(tmp_path)).count() == 6


def test_quotes_and_empty_fields(spark, tmp_path):
    (tmp_path / "20101201_sales.csv").write_text(
        HEADER + '1,A,"HEART 12"" , RED",2,12/1/2010 8:26,2.55,,\n2,A,"",2,12/1/2010 8:26,1,7,UK\n'
    )
    first, second = read_raw_sales(spark, str(tmp_path)).collect()
    assert first.Description == 'HEART 12" , RED'
    assert (first.CustomerID, first.Country, second.Description) == (None, None, "")


@pytest.mark.parametrize("line", ["1,A,mug,many,12/1/2010 8:26,1,7,UK", "1,A,mug"])
def test_a_bad_line_stops_the_job(spark, tmp_path, line):
    (tmp_path / "20101201_sales.csv").write_text(HEADER + line + "\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        stg_transactions(read_raw_sales(spark, str(tmp_path))).select("country").collect()


def test_category_names(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text(
        "﻿product_category_name,product_category_name_english\njardim,garden\n",
        encoding="utf-8",
    )
    names = read_category_names(spark, str(path))
    assert [tuple(row) for row in names.collect()] == [("jardim", "garden")]


def test_files_are_taken_once_and_archived_by_the_next_run(spark, tmp_path):
    landing, archive = tmp_path / "landing", tmp_path / "archive"
    target, checkpoint = str(tmp_path / "staging"), str(tmp_path / "checkpoint")
    counts, waiting = [], []
    for day in DAYS:
        land(landing, day)
        ingest_available_now(spark, str(landing), target, checkpoint, str(archive))
        staging = read_table(spark, target, schemas.STG_TRANSACTIONS_LOADED)
        counts.append(staging.count())
        waiting.append(sorted(p.name[:8] for p in landing.glob("*.csv")))
    assert counts == [2, 4, 6]
    assert waiting == [["20101201"], ["20101202"], ["20101203"]]
    archived = sorted(p.name[:8] for p in archive.rglob("*.csv"))
    assert archived == ["20101201", "20101202"]
    assert Counter(r.load_date.strftime("%Y%m%d") for r in staging.collect()) == {
        day: 2 for day in DAYS
    }
    # Nothing new: nothing changes.
    ingest_available_now(spark, str(landing), target, checkpoint, str(archive))
    assert read_table(spark, target, schemas.STG_TRANSACTIONS_LOADED).count() == 6


def test_a_failed_run_is_made_good(spark, tmp_path):
    landing, target, checkpoint = tmp_path / "landing", tmp_path / "staging", tmp_path / "check"
    land(landing, "20101201")
    bad = landing / "20101202_sales.csv"
    bad.write_text(HEADER + "3,A,mug,many,12/2/2010 8:26,2.55,8,Spain\n")
    with pytest.raises(PySparkException):
        ingest_available_now(spark, str(landing), str(target), str(checkpoint))
    land(landing, "20101202")
    ingest_available_now(spark, str(landing), str(target), str(checkpoint))
    staging = read_table(spark, str(target), schemas.STG_TRANSACTIONS_LOADED)
    assert Counter(r.invoice_no for r in staging.collect()) == Counter(["1", "2", "3", "C4"])


def test_writing_a_period_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "day date, k long"
    both = spark.createDataFrame([(date(2010, 1, d), k) for d in (1, 2) for k in (3, 1, 2)], schema)
    write_periods(both, path, "day", ["k"])
    write_periods(both.where("day = '2010-01-02'"), path, "day", ["k"])
    found = spark.read.parquet(path)
    assert rows(found.select("day", "k")) == rows(both)
    assert len(list(Path(path).rglob("*.parquet"))) == 2
    # A period written anew is replaced as a whole.
    write_periods(both.where("day = '2010-01-02' AND k = 3"), path, "day", ["k"])
    assert spark.read.parquet(path).count() == 4


def test_a_hot_period_is_cut_up_and_stays_sorted(spark, tmp_path, with_settings):
    with_settings(
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20k",
    )
    path = str(tmp_path / "t")
    big = spark.range(0, 60_000, 1, 16).selectExpr(
        "IF(id % 3 = 0, DATE'2010-01-01', DATE_ADD(DATE'2010-01-02', CAST(id % 20 AS INT))) AS day",
        "HASH(id) AS k",
    )
    write_periods(big, path, "day", ["k"])
    files = Counter(p.parent.name for p in Path(path).rglob("*.parquet"))
    assert files["day=2010-01-01"] > 1
    for file in Path(path).glob("day=2010-01-01/*.parquet"):
        keys = [row.k for row in spark.read.parquet(str(file)).collect()]
        assert keys == sorted(keys)
    assert rows(spark.read.parquet(path).select("day", "k")) == rows(big)


def test_stored_tables_lie_in_the_shared_folder(spark):
    kept = stored(spark.range(5), "numbers")
    assert sorted(row.id for row in kept.collect()) == list(range(5))
    folder = spark.conf.get("spark.checkpoint.dir")
    files = kept.inputFiles()
    assert files and all(f.startswith(f"file://{folder}/salesmart/numbers-") for f in files)
    release(spark)
    assert not any(Path(file.removeprefix("file://")).exists() for file in files)


TABLES = (
    ("dim_dates", schemas.DIM_DATES),
    ("dim_products", schemas.DIM_PRODUCTS),
    ("dim_customers", schemas.DIM_CUSTOMERS),
    ("fact_sales", schemas.FACT_SALES),
    ("agg_daily_sales", schemas.AGG_DAILY_SALES),
    ("agg_customer_segments_monthly", schemas.AGG_CUSTOMER_SEGMENTS_MONTHLY),
    ("top_n_products_monthly", schemas.TOP_N_PRODUCTS_MONTHLY),
)
AS_OF = date(2010, 12, 31)


def contents(spark, house):
    return {
        name: rows(read_table(spark, getattr(house, name), schema).select(schema.names))
        for name, schema in TABLES
    }


def day_of(name: str) -> date:
    return date(int(name[:4]), int(name[4:6]), int(name[6:8]))


def test_daily_runs_add_up_to_a_backfill(spark, tmp_path):
    """Late rows, two files before one run, an unreadable day, and a run without a file."""
    landing = tmp_path / "landing"
    base = str(tmp_path / "daily")
    land(landing, "20101201")
    daily.refresh(spark, base, str(landing), date(2010, 12, 1), AS_OF)
    land(landing, "20101202")
    land(landing, "20101203")  # holds a late row, of a new customer, of the first day
    (landing / "undated_sales.csv").write_text(
        HEADER + "7,B,bag,4,11/30/2010 8:26,1,7,Norway\n"  # a second country for a customer
    )
    house = daily.refresh(spark, base, str(landing), date(2010, 12, 3), AS_OF)
    house = daily.refresh(spark, base, str(landing), date(2010, 12, 4), AS_OF)
    full = daily.refresh(spark, str(tmp_path / "full"), str(landing), None, AS_OF)
    by_day, whole = contents(spark, house), contents(spark, full)
    assert by_day == whole
    assert all(by_day.values())
    assert not Path(house.pending).exists()
    fact = read_table(spark, full.fact_sales, schemas.FACT_SALES)
    assert sum(r.line_item_total_amount for r in fact.collect()) == sum(
        r.total_sales_this_month
        for r in marts.top_n_products_monthly(
            fact, read_table(spark, full.dim_products, schemas.DIM_PRODUCTS)
        ).collect()
    )


def test_a_run_that_dies_is_made_good(spark, tmp_path, monkeypatch):
    landing, base = tmp_path / "landing", str(tmp_path / "daily")
    land(landing, "20101201")
    daily.refresh(spark, base, str(landing), date(2010, 12, 1), AS_OF)
    land(landing, "20101203")
    with monkeypatch.context() as patch:
        patch.setattr(daily, "build_fact", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            daily.refresh(spark, base, str(landing), date(2010, 12, 3), AS_OF)
    house = daily.refresh(spark, base, str(landing), date(2010, 12, 4), AS_OF)
    full = daily.refresh(spark, str(tmp_path / "full"), str(landing), None, AS_OF)
    assert contents(spark, house) == contents(spark, full)


def test_emptied_periods_go(spark, tmp_path):
    landing, base = tmp_path / "landing", str(tmp_path / "house")
    for name in DAYS:
        land(landing, name)
    daily.refresh(spark, base, str(landing), None, AS_OF)
    house = daily.refresh(spark, base, str(landing), None, date(2010, 12, 2))
    full = daily.refresh(spark, str(tmp_path / "full"), str(landing), None, date(2010, 12, 2))
    assert contents(spark, house) == contents(spark, full)
    # A run for a day that is now after as_of.
    house = daily.refresh(spark, base, str(landing), date(2010, 12, 2), date(2010, 12, 1))
    days = read_table(spark, house.fact_sales, schemas.FACT_SALES).select("invoice_day")
    assert {r[0] for r in days.collect()} == {date(2010, 12, 1)}
    days = read_table(spark, house.agg_daily_sales, schemas.AGG_DAILY_SALES).select("sale_date")
    assert {r[0] for r in days.collect()} == {date(2010, 12, 1)}


def test_a_corrected_file_is_reloaded(spark, tmp_path):
    landing, base = tmp_path / "landing", str(tmp_path / "house")
    for name in DAYS:
        land(landing, name)
    daily.refresh(spark, base, str(landing), None, AS_OF)
    # Other numbers, other days; the old day of one of its rows becomes empty.
    (landing / "20101202_sales.csv").write_text(
        HEADER + "3,A,mug,100,12/5/2010 8:26,2.55,8,Spain\n"
    )
    house = daily.refresh(spark, base, str(landing), date(2010, 12, 2), AS_OF, reload=True)
    full = daily.refresh(spark, str(tmp_path / "full"), str(landing), None, AS_OF)
    assert contents(spark, house) == contents(spark, full)
    fact = read_table(spark, house.fact_sales, schemas.FACT_SALES)
    assert {r.quantity for r in fact.where("invoice_no = '3'").collect()} == {100}
    assert fact.where("invoice_day = '2010-12-02'").isEmpty()


def test_texts_survive_being_written_as_csv(spark, tmp_path):
    texts = ["  padded ", "\ttab\t", 'a "quote", and comma', "", None, " "]
    raw = spark.createDataFrame(
        [("1", "A", text, 1, "12/1/2010 8:26", None, "7", "UK") for text in texts],
        schemas.RAW_SALES,
    )
    path = str(tmp_path / "csv")
    raw.write.options(**CSV_WRITE_OPTIONS).csv(path)
    assert rows(read_raw_sales(spark, path)) == rows(raw)


def test_a_line_break_in_a_text_stops_the_job(spark, tmp_path):
    (tmp_path / "20101201_sales.csv").write_text(
        HEADER + '1,A,"two\nlines",2,12/1/2010 8:26,2.55,7,UK\n'
    )
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        read_raw_sales(spark, str(tmp_path)).collect()


def test_names_are_taken_apart_once_a_file(spark, tmp_path, monkeypatch):
    names = ["20101204_a=b {1} 100%+_sales.csv", "new_sales.csv", "20101399_sales.csv"]
    for name in names:
        (tmp_path / name).write_text(HEADER + DAYS["20101201"][0] + "\n" + DAYS["20101201"][1] + "\n")
    files = spark.createDataFrame([(name, False) for name in names], "file string, open boolean")

    def found():
        raw = landing.read_landed(spark, str(tmp_path), files)
        return raw, rows(raw.select("load_file", "load_date"))

    raw, named = found()
    days = [date(2010, 12, 4), None, None]
    assert named == Counter({pair: 2 for pair in zip(names, days)})
    assert "BroadcastHashJoin" in raw._jdf.queryExecution().executedPlan().toString()
    # A name that Spark spells in another way is still known.
    monkeypatch.setattr(landing, "_spelt", lambda spark, path: "otherwise")
    assert found()[1] == named
