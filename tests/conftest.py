import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

from salesmart import schemas  # noqa: E402
from salesmart.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("scratch")
    session = local_session(
        8,
        **{
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(folder),
            "spark.sql.maxMetadataStringLength": "10000",  # whole filters in plans
            "spark.sql.debug.maxToStringFields": "1000",
        },
    )
    yield session
    session.stop()


@pytest.fixture
def with_settings(spark):
    """Set session settings for one test."""
    before = {}

    def apply(**settings):
        for key, value in settings.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield apply
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def staged(spark):
    """Staging rows from (invoice, stock, customer, country, day, quantity, price) tuples."""

    def make(*rows):
        return spark.createDataFrame(
            [
                (invoice, stock, f"thing {stock}", quantity, datetime.fromisoformat(day),
                 Decimal(price), customer, country)
                for invoice, stock, customer, country, day, quantity, price in rows
            ],
            schemas.STG_TRANSACTIONS,
        )

    return make
