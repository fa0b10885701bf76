from decimal import Decimal

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.operators import tiles
from salesmart.operators.tiles import exact_ntiles


def check(df, tile_count=5, effort=tiles.Effort()):
    """Compare with the built-in function, which gathers all rows in one task."""
    ours = exact_ntiles(df, {"tile": F.col("value")}, "id", tile_count, effort)
    order = W.orderBy("value", "id")
    theirs = df.withColumn("tile", F.ntile(tile_count).over(order).cast("bigint"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))


def frame(spark, values, kind="long"):
    rows = [(f"c{i}", value) for i, value in enumerate(values)]
    return spark.createDataFrame(rows, f"id string, value {kind}")


@pytest.mark.parametrize("size", [0, 1, 3, 4, 5, 7, 11, 100])
def test_sizes(spark, size):
    check(frame(spark, [(i * 7) % 11 for i in range(size)]))


#: So few keys may be sampled and fetched that small tables take many rounds.
FEW_KEYS = tiles.Effort(sample_keys=12, fetch_keys=8, max_rounds=1000)


@pytest.mark.parametrize(
    "values",
    [
        [3] * 500,  # nothing but ties
        [1] * 300 + list(range(200)),  # ties across a boundary
        [Decimal(i * i % 997) / 100 for i in range(500)],
    ],
    ids=["ties", "hot value", "decimals"],
)
def test_many_rounds(spark, values):
    kind = "decimal(38,9)" if isinstance(values[0], Decimal) else "long"
    check(frame(spark, values, kind).repartition(4), effort=FEW_KEYS)


@settings(
    max_examples=10,
    deadline=None,
    phases=[Phase.generate],
    suppress_health_check=list(HealthCheck),
)
@given(
    values=st.lists(st.integers(-5, 5) | st.integers(-(10**15), 10**15), max_size=60),
    tile_count=st.integers(1, 7),
)
def test_any_values(spark, values, tile_count):
    check(frame(spark, values).coalesce(1), tile_count, FEW_KEYS)


def test_a_useless_sample_only_costs_rounds(spark, monkeypatch):
    """Suggest the ends of the sample, whatever the wanted rank."""
    monkeypatch.setattr(
        tiles._Bracket, "suggest", lambda self, sample: sample[:1] + sample[-1:]
    )
    check(frame(spark, [i % 10 for i in range(30)]).coalesce(1), effort=FEW_KEYS)


def test_several_measures_in_one_search(spark):
    rows = spark.range(300).select(
        F.format_string("c%03d", "id").alias("id"),
        (F.col("id") * 7 % 50).alias("a"),
        (-F.col("id") * 11 % 300).alias("b"),
    )
    ours = exact_ntiles(rows, {"x": F.col("a"), "y": -F.col("b")}, "id", effort=FEW_KEYS)
    theirs = rows.withColumns(
        {
            "x": F.ntile(5).over(W.orderBy("a", "id")).cast("bigint"),
            "y": F.ntile(5).over(W.orderBy(F.desc("b"), "id")).cast("bigint"),
        }
    )
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))


def brute_force_rounds(size, rank, tries=200):
    """Rounds a search takes when the sample is the whole bracket."""
    keys = [(i, "") for i in range(size)]
    bracket = tiles._Bracket(rank, None, None, 0, size)
    rounds = 0
    while bracket.inside > 1:
        cuts = sorted(set(bracket.suggest(bracket.slice(keys))))
        bracket = bracket.narrow({key: key[0] + 1 for key in cuts})
        rounds += 1
        assert rounds < tries
    return bracket


@pytest.mark.parametrize("size", range(1, 25))
def test_a_search_never_stalls(size):
    for rank in range(1, size + 1):
        bracket = brute_force_rounds(size, rank)
        assert (bracket.below, bracket.inside) == (rank - 1, 1)


def test_null_measures_are_refused(spark):
    with pytest.raises(ValueError, match="1 rows have a NULL"):
        exact_ntiles(frame(spark, [1, None]), {"tile": F.col("value")}, "id")


def test_equal_keys_are_refused(spark):
    effort = tiles.Effort(sample_keys=12, fetch_keys=8, max_rounds=3)
    same = spark.range(100).select(F.lit("c").alias("id"), F.lit(1).alias("value"))
    with pytest.raises(ValueError, match="unique"):
        exact_ntiles(same, {"tile": F.col("value")}, "id", effort=effort)


def test_no_task_gets_all_rows(spark):
    scored = exact_ntiles(frame(spark, range(100)), {"tile": F.col("value")}, "id")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
