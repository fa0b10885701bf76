"""Tables kept up by key, and dimensions put together from the partials of loads."""

from collections import Counter
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import types as T
from test_files import AS_OF, DAYS, HEADER, contents, land

from salesmart import schemas
from salesmart.operators import customers, partials, products
from salesmart.plans import refresh as daily
from salesmart.sinks import merge
from salesmart.sinks.merge import buckets_of, merge_by_key, write_bucketed
from salesmart.sinks.tables import read_table

SCHEMA = T.StructType(
    [T.StructField("k", T.StringType()), T.StructField("c", T.StringType()), T.StructField("v", T.LongType())]
)


def rows(df):
    return Counter(tuple(row) for row in df.collect())


def frame(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def table(spark, path):
    return rows(read_table(spark, path, SCHEMA))


def files(path):
    found = {}
    for file in Path(path).rglob("*.parquet"):
        found.setdefault(file.parent.name, set()).add(file.name)
    return found


def keys(df):
    return {row[0] for row in df.collect()}


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "t")
    many = [(f"k{i}", "x", i) for i in range(200)]
    assert keys(merge_by_key(frame(spark, *many), path, "k", SCHEMA)) == {k for k, _, _ in many}
    assert buckets_of(spark, path) == merge.FEWEST_BUCKETS
    return path


def test_a_merge_replaces_delivered_keys_and_leaves_other_buckets(spark, path):
    before, expected = files(path), table(spark, path)
    delivered = [("k1", "x", -1), ("k1", "y", -2), ("k2", "x", 2), ("new", "x", 5), (None, "x", 6)]
    noted = []
    changed = merge_by_key(
        frame(spark, *delivered), path, "k", SCHEMA, noted=lambda df: noted.append(keys(df))
    )
    assert keys(changed) == {"k1", "new", None} == noted[0]  # k2 is as it was
    expected -= Counter([("k1", "x", 1), ("k2", "x", 2)])
    assert table(spark, path) == expected + Counter(delivered)
    name = f"bucket_of_{merge.FEWEST_BUCKETS}"
    touched = {f"{name}={row[0]}" for row in changed.select(merge.bucket("k", 16)).collect()}
    after = files(path)
    assert 0 < len(touched) <= 3
    for folder in before.keys() | after.keys():
        assert (before.get(folder) == after.get(folder)) == (folder not in touched), folder


def test_the_same_delivery_again_writes_nothing(spark, path):
    delivered = frame(spark, ("k1", "x", -1), (None, "x", 6))
    merge_by_key(delivered, path, "k", SCHEMA)
    before = files(path)
    assert merge_by_key(delivered, path, "k", SCHEMA).isEmpty()
    assert files(path) == before


def test_gone_keys_and_complete_deliveries(spark, path):
    gone = spark.createDataFrame([("k3",), ("k4",), ("never",)], "k string")
    changed = merge_by_key(frame(spark, ("k4", "x", 40)), path, "k", SCHEMA, gone=gone)
    assert keys(changed) == {"k3", "k4"}
    found = table(spark, path)
    assert len(found) == 199 and found[("k4", "x", 40)] == 1
    some = [("k7", "x", 7), ("k8", "x", 80), ("k8", "x", 80)]  # equal rows count
    changed = merge_by_key(frame(spark, *some), path, "k", SCHEMA, complete=True)
    assert table(spark, path) == Counter(some)
    assert len(keys(changed)) == 198  # all but k7, which stays
    assert keys(merge_by_key(frame(spark, *some[1:]), path, "k", SCHEMA)) == set()
    assert keys(merge_by_key(frame(spark, some[1]), path, "k", SCHEMA)) == {"k8"}
    assert keys(merge_by_key(frame(spark), path, "k", SCHEMA, complete=True)) == {"k7", "k8"}
    assert table(spark, path) == Counter()
    assert keys(merge_by_key(frame(spark, some[0]), path, "k", SCHEMA)) == {"k7"}
    assert table(spark, path) == Counter(some[:1])


def test_a_merge_that_dies_is_made_good(spark, path, monkeypatch):
    delivered = frame(spark, *((f"k{i}", "x", -i) for i in range(1, 50)))
    with monkeypatch.context() as patch:
        patch.setattr(merge, "write_folders", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            merge_by_key(delivered, path, "k", SCHEMA)
    merge_by_key(delivered, path, "k", SCHEMA)
    assert sum(n for (_, _, v), n in table(spark, path).items() if v < 0) == 49


def test_plain_tables_get_buckets_and_large_ones_more(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "plain")
    frame(spark, ("a", "x", 1), ("b", "x", 2)).write.parquet(path)
    assert buckets_of(spark, path) is None
    changed = merge_by_key(frame(spark, ("b", "x", 2), ("c", "x", 3)), path, "k", SCHEMA)
    assert keys(changed) == {"a", "b", "c"}  # nothing is known of how they were
    assert len(table(spark, path)) == 2
    monkeypatch.setattr(merge, "BYTES_PER_BUCKET", 50)
    merge_by_key(frame(spark, *((f"k{i}", "x", i) for i in range(300))), path, "k", SCHEMA)
    assert buckets_of(spark, path) > 2 * merge.FEWEST_BUCKETS
    assert len(table(spark, path)) == 302


def test_only_touched_buckets_are_read(spark, path):
    """A broken file of another bucket does not matter."""
    delivered = frame(spark, ("k1", "x", -1))
    mine = delivered.select(merge.bucket("k", merge.FEWEST_BUCKETS)).first()[0]
    for file in Path(path).rglob("*.parquet"):
        if not file.parent.name.endswith(f"={mine}"):
            file.write_bytes(b"not a table")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert keys(merge_by_key(delivered, path, "k", SCHEMA)) == {"k1"}


def test_partials_give_the_same_dimensions(spark, staged):
    stg = staged(
        ("1", "A", "7", "France", "2010-12-01 08:26", 2, "2.55"),
        ("1", "B", "7", "Norway", "2010-12-01 08:26", 2, "2.55"),
        ("2", "A", "7", "France", "2010-12-03 08:26", 1, "1"),
        ("C3", "A", "8", None, "2010-12-02 08:26", 1, "0.000000001"),
        ("4", None, schemas.ANONYMOUS, "France", "2010-12-05 08:26", 1, "3"),
    )
    loads = (date(2010, 12, 1), date(2010, 12, 3), None)
    loaded = stg.limit(0).selectExpr("*", "DATE'2010-12-01' AS load_date")
    for load in loads:  # the same rows in three loads: invoices count once
        loaded = loaded.unionByName(
            stg.selectExpr("*", f"CAST({f"'{load}'" if load else 'NULL'} AS DATE) AS load_date")
        )
    invoices = partials.invoices_by_load(loaded)
    assert invoices.select(*schemas.INVOICES_BY_LOAD.names).schema == schemas.INVOICES_BY_LOAD
    assert invoices.count() == 15
    assert rows(partials.customer_base(invoices)) == rows(customers.customer_base(loaded))
    assert rows(partials.customer_countries(invoices)) == rows(customers.customer_countries(stg))
    found = partials.dim_products(partials.products_by_load(loaded))
    assert rows(found) == rows(products.dim_products(stg))
    dtypes = [(field.name, field.dataType) for field in schemas.DIM_PRODUCTS]
    assert [(field.name, field.dataType) for field in found.schema] == dtypes


def history(spark, house):
    base = read_table(spark, house.customer_base, schemas.CUSTOMER_BASE)
    return {row.customer_id: tuple(row)[1:] for row in base.collect()}


def test_customers_survive_corrected_and_emptied_files(spark, tmp_path):
    """First and last days come back when the rows that set them go."""
    landing, base = tmp_path / "landing", str(tmp_path / "house")
    for name in DAYS:
        land(landing, name)
    house = daily.refresh(spark, base, str(landing), None, AS_OF)
    first, second, third = (date(2010, 12, day) for day in (1, 2, 3))
    assert history(spark, house)["7"] == (first, third, 2, Decimal("9.1"))
    # The third file loses customer 9 and gets an earlier invoice of customer 7.
    (landing / "20101203_sales.csv").write_text(
        HEADER + "5,B,bag,4,11/30/2010 8:26,1,7,France\n5,B,bag,1,11/30/2010 8:26,1,7,France\n"
    )
    house = daily.refresh(spark, base, str(landing), third, AS_OF, reload=True)
    assert history(spark, house) == {
        "7": (date(2010, 11, 30), first, 2, Decimal("10.1")),
        "8": (second, second, 2, Decimal("5.1")),
    }
    # The first file becomes empty: product A has a later description only.
    (landing / "20101201_sales.csv").write_text(HEADER)
    house = daily.refresh(spark, base, str(landing), first, AS_OF, reload=True)
    assert history(spark, house)["7"] == (date(2010, 11, 30),) * 2 + (1, Decimal("5"))
    full = daily.refresh(spark, str(tmp_path / "full"), str(landing), None, AS_OF)
    assert contents(spark, house) == contents(spark, full)
    assert history(spark, house) == history(spark, full)


def test_a_daily_run_reads_no_other_load(spark, tmp_path):
    """Loads without rows of the day may be unreadable, as their partials are kept."""
    landing, base = tmp_path / "landing", str(tmp_path / "house")
    for name in ("20101201", "20101202"):
        land(landing, name)
    house = daily.refresh(spark, base, str(landing), None, AS_OF)
    for file in Path(house.stg_transactions, "load_date=2010-12-02").rglob("*.parquet"):
        file.write_bytes(b"not a table")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    land(landing, "20101203")  # has rows of the first and third day
    daily.refresh(spark, base, str(landing), date(2010, 12, 3), AS_OF)
    base_rows = history(spark, house)
    assert base_rows["7"] == (date(2010, 12, 1), date(2010, 12, 3), 2, Decimal("9.1"))
    assert base_rows["8"][2] == 2  # from the broken load's partials
    fact = read_table(spark, house.fact_sales, schemas.FACT_SALES)
    assert fact.where("invoice_day = '2010-12-01'").count() == 3
