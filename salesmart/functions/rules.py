"""Business rules kept as tables: product categories and RFM segments."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category label and the words that lead to it; first hit wins.
CATEGORY_WORDS = [
    ("Candles", ["candle"]),
    ("Bags", ["bag", "sack"]),
    ("Boxes & Cases", ["box", "case"]),
    ("Mugs & Cups", ["mug", "cup"]),
    ("Heart Items", ["heart"]),
    ("Christmas", ["christmas"]),
    ("Kitchenware", ["kitchen"]),
    ("Wall Art", ["wall art", "poster"]),
    ("Vintage", ["vintage"]),
    ("Holders & Stands", ["holder", "stand"]),
]

# Segment label and the (recency, frequency, monetary) score ranges,
# both ends included, that lead to it; first hit wins.
SEGMENT_RANGES = [
    ("Champions", (4, 5), (4, 5), (4, 5)),
    ("Loyal Customers", (3, 5), (3, 5), (3, 5)),
    ("Potential Loyalists", (4, 5), (2, 5), (2, 5)),
    ("New Customers", (4, 5), (1, 1), (1, 1)),
    ("Promising", (3, 5), (1, 2), (1, 2)),
    ("At Risk", (1, 2), (3, 5), (3, 5)),
    ("Can't Lose Them", (1, 2), (4, 5), (4, 5)),  # all of these are "At Risk" already
    ("Hibernating", (1, 2), (1, 2), (1, 2)),
]

# Fixed value: label of whatever no rule covers, NULL input included.
OTHER = "Other"


def _first_match(rules: list[tuple[str, Column]]) -> Column:
    (label, test), *rest = rules
    chain = F.when(test, label)
    for label, test in rest:
        chain = chain.when(test, label)
    return chain.otherwise(OTHER)


def product_category(description: Column) -> Column:
    text = F.lower(description)
    return _first_match(
        [
            (label, reduce(or_, (text.contains(word) for word in words)))
            for label, words in CATEGORY_WORDS
        ]
    )


def rfm_segment(recency: Column, frequency: Column, monetary: Column) -> Column:
    scores = (recency, frequency, monetary)
    return _first_match(
        [
            (label, reduce(and_, (s.between(*ends) for s, ends in zip(scores, ranges))))
            for label, *ranges in SEGMENT_RANGES
        ]
    )


def rfm_code(recency: Column, frequency: Column, monetary: Column) -> Column:
    """The three scores side by side, such as ``543``."""
    return F.concat(*(s.cast("string") for s in (recency, frequency, monetary)))
