"""Exact money arithmetic on DECIMAL(38,9)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesmart.schemas import MONEY


def line_amount(quantity: Column, unit_price: Column) -> Column:
    """quantity x unit price without losing a digit (see ``schemas``)."""
    return (quantity.cast("decimal(17,0)") * unit_price).cast(MONEY)


def per_unit(amount: Column, quantity: Column) -> Column:
    """amount / quantity, rounded half up to nine decimals."""
    return (amount / quantity.cast("decimal(17,0)")).cast(MONEY)


def mean(total: Column, count: Column) -> Column:
    """total / count, rounded half up to nine decimals.

    An average kept as a (total, count) pair can be summed in as many steps as a
    plan likes, which the built-in ``avg`` cannot.
    """
    return (total / count).cast(MONEY)


def total(amount: Column) -> Column:
    return F.sum(amount).cast(MONEY)
