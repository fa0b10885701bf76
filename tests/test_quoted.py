"""Line breaks inside quoted texts, with files read in many parts."""

import csv
import io
import random
from collections import Counter
from datetime import date

import duckdb
import pytest
from test_files import AS_OF, HEADER

from salesmart import schemas
from salesmart.plans import refresh as daily
from salesmart.sinks.tables import read_table
from salesmart.sources.files import CSV_OPTIONS
from salesmart.sources.quoted import ends_open, lines_of, read_quoted

SCHEMA = "a string, b string, n long"


@pytest.fixture
def in_parts(with_settings):
    with_settings(
        spark__sql__files__maxPartitionBytes="64b", spark__sql__files__openCostInBytes="0b"
    )


def _texts(seed, rows, end):
    draw = random.Random(seed)
    parts = ["x", '"', '""', ",", end, end + end, " ", "plain words", '",', ',"', "é"]
    for i in range(rows):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(6)))
        yield (f"r{i}", text or None, i)


def _write(path, rows, end):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["a", "b", "n"])
    for row in rows:
        writer.writerow(row)
    path.write_bytes(out.getvalue().encode())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(3))
def test_texts_with_breaks_equal_duckdb(spark, tmp_path, in_parts, seed, end):
    paths = [tmp_path / f"{i}.csv" for i in range(2)]
    for i, path in enumerate(paths):
        _write(path, _texts(10 * seed + i, 60, end), end)
    found = read_quoted(spark, [str(p) for p in paths], SCHEMA, CSV_OPTIONS)
    ours = Counter(tuple(row)[1:] for row in found.collect())
    read = "read_csv(?, header=true, quote='\"', escape='\"', columns={a: 'VARCHAR', b: 'VARCHAR', n: 'BIGINT'}, allow_quoted_nulls=false)"
    theirs = Counter(duckdb.sql(f"SELECT * FROM {read}", params=[[str(p) for p in paths]]).fetchall())
    assert ours == theirs
    assert ours.total() == 120
    assert lines_of(spark, [str(p) for p in paths]).rdd.getNumPartitions() > 20


@pytest.mark.parametrize("block, batch", [("1m", "3"), ("150b", "2"), ("40b", "1")])
def test_lines_are_joined_where_they_are_read(spark, tmp_path, with_settings, block, batch):
    """Only the records that cross the end of a block are shuffled, in batches of any size."""
    with_settings(
        spark__sql__files__maxPartitionBytes=block, spark__sql__files__openCostInBytes="0b",
        spark__sql__files__minPartitionNum="1", spark__sql__execution__arrow__maxRecordsPerBatch=batch,
    )
    path = tmp_path / "x.csv"
    texts = [*_texts(7, 50, "\n"), ("long", "\n".join(map(str, range(60))), 50), ("last", "a", 51)]
    _write(path, texts, "\n")
    found = read_quoted(spark, [str(path)], SCHEMA, CSV_OPTIONS)
    with path.open(newline="") as file:
        want = Counter((a, b) for a, b, _ in list(csv.reader(file))[1:])
    assert Counter((row.a, row.b or "") for row in found.collect()) == want
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    assert plan.count("Aggregate") == 2 and plan.index("NOT whole") > plan.index("Aggregate")


def test_quotes_inside_plain_fields_open_nothing(spark):
    lines = {
        '1,HEART 12" RED,2': False,
        '1,"HEART 12"" , RED",2': False,
        '1,"open': True,
        '1,"open ""': True,
        '1,"closed """': False,
        '"': True,
        "": False,
        '"a","b': True,
        ',,"': True,
        'a"b,"c,d': True,
    }
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    found = df.select("value", ends_open(df.value).alias("open")).collect()
    assert {row.value: row.open for row in found} == lines


def test_a_daily_run_takes_texts_with_breaks(spark, tmp_path, in_parts):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "20101201_sales.csv").write_text(
        HEADER
        + '1,A,"two\nlines, and ""quotes""",2,12/1/2010 8:26,2.55,7,France\n'
        + '2,B,HEART 12" RED,1,12/1/2010 9:00,1,,France\n'
        + '3,C,"\n\n",1,12/1/2010 9:00,1,8,"Sp\nain"\n'
    )
    (landing / "20101202_sales.csv").write_text(
        HEADER + '4,B,HEART 12" RED,1,12/2/2010 9:00,1,,France\n'
    )
    house = daily.refresh(spark, str(tmp_path / "house"), str(landing), date(2010, 12, 1), AS_OF)
    stg = read_table(spark, house.stg_transactions, schemas.STG_TRANSACTIONS_LOADED)
    assert {(r.invoice_no, r.description, r.country) for r in stg.collect()} == {
        ("1", 'two\nlines, and "quotes"', "France"),
        ("2", 'HEART 12" RED', "France"),
        ("3", "\n\n", "Sp\nain"),
        ("4", 'HEART 12" RED', "France"),
    }
    (landing / "20101202_sales.csv").write_text(
        HEADER + '5,B,"a\nb",1,12/2/2010 9:00,1,9,France\n'
    )
    daily.refresh(spark, house.base, str(landing), date(2010, 12, 2), AS_OF, reload=True)
    fact = read_table(spark, house.fact_sales, schemas.FACT_SALES)
    assert {r.invoice_no for r in fact.collect()} == {"1", "2", "3", "5"}


def test_a_bad_row_still_stops_the_job(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b,n\nx,"two\nlines",1\ny,z,many\n')
    with pytest.raises(Exception, match="MALFORMED"):
        read_quoted(spark, [str(path)], SCHEMA, CSV_OPTIONS).collect()
