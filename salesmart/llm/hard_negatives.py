"""Hard negatives: rows of another label that score high, but below the positives.

Scores are inner products of whole vectors, taken for several candidates at once: their
components, made non-negative by a bias, are laid into separated fields of one wide integer
(Kronecker substitution), an anchor's component multiplies that integer once, and the fields of
the sum are the scores of all these candidates, exactly.  The wide integers are kept in the
53-bit significands of doubles, so a whole block is one matrix product; where a single score
needs more bits, Python's integers take their place.

Candidates lie in shards by a hash, each row in one; anchors are sent to all shards they
compare with and stream past the rows there.  First the shards of the anchor's own label give
its positives, then all shards give negatives for each positive.  A shard returns at most the
wanted number of rows for each, ranks are dealt at the end.

Rows with a null id, a null label, or a vector that takes no part (``whole_vectors``) are left
out.  Repeated rows are candidates each, so a result can name an id twice; rows with the
anchor's id are never its candidates.  Of a repeated anchor id the row with the smallest label
and vector asks.  An anchor without positives, or without negatives in the range, gives no row.
Other columns, whatever their names, are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesmart.llm.common import stored
from salesmart.llm.whole_vectors import (
    EXACT,
    first_ones,
    held,
    packed,
    rows_per_shard,
    shard_by_shard,
    unpacked,
    whole,
)

POSITIVES = 5
NEGATIVES = 10
#: A negative scores between these percentages of the positive.
LEAST, MOST = 30, 90
#: Scores that a task holds at a time.
SCORES = 2_000_000
#: Fields of a wide integer where doubles are too narrow.
WIDE_FIELDS = 16


class Packed:
    """Candidates in the fields of wide integers, to be multiplied with anchors."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.size, self.length = rows.shape
        self.low = rows.min(initial=0)
        self.biased = rows - self.low
        self.high = self.biased.max(initial=0)
        self.sums = rows.sum(axis=1)
        self._wide: dict[tuple, np.ndarray] = {}

    def _fields(self, width: int, fields: int, doubles: bool) -> np.ndarray:
        """Components x wide integers; field j holds the j-th stretch of the candidates."""
        if (width, fields) not in self._wide:
            across = -(-self.size // fields)
            values = self.biased if doubles else whole(self.biased)
            wide = np.zeros((self.length, across), np.float64 if doubles else object)
            for j in range(fields):
                stretch = values[j * across : (j + 1) * across].T
                wide[:, : stretch.shape[1]] += stretch * 2 ** (width * j)
            self._wide = {(width, fields): wide}
        return self._wide[width, fields]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products, anchors x candidates, as longs."""
        low = anchors.min(initial=0)
        biased = anchors - low
        # A field must hold the largest possible sum of products.
        largest = self.length * int(self.high) * int(biased.max(initial=0))
        width = max(1, largest.bit_length())
        # What the bias adds must be exact too.
        size = max(abs(float(v)) for v in (self.high, self.low, low, biased.max(initial=0)))
        doubles = width <= 53 and 4 * self.length * size * size < EXACT
        fields = max(1, min(53 // width if doubles else WIDE_FIELDS, self.size))
        wide = self._fields(width, fields, doubles)
        products = (biased if doubles else whole(biased)) @ wide
        if doubles:
            products = products.astype(np.int64)
        mask = (1 << width) - 1
        parts = [(products >> (width * j)) & mask for j in range(fields)]
        found = np.concatenate(parts, axis=1)[:, : self.size]
        if doubles:
            of_anchor = (self.low * anchors.sum(axis=1) - self.length * low * self.low)[:, None]
            return found + (of_anchor + low * self.sums).astype(np.int64)
        anchors, rows = whole(anchors), whole(self.rows)
        low, mine = int(low), int(self.low)
        of_anchor = (mine * anchors.sum(axis=1) - self.length * low * mine)[:, None]
        return held(found + of_anchor + low * rows.sum(axis=1))


def _by_label(rows: pd.DataFrame) -> dict[int, tuple[np.ndarray, Packed]]:
    """Ids, ascending, and packed vectors of each label."""
    rows = rows.sort_values(["label", "id"], kind="stable")
    return {
        label: (part["id"].to_numpy(), Packed(unpacked(part["data"], part["n"].iloc[0])))
        for label, part in rows.groupby("label")
    }


def _scored(packed_rows: Packed, anchors: pd.DataFrame) -> Iterator[tuple]:
    """Anchors, some at a time, with their scores."""
    step = max(1, SCORES // max(1, packed_rows.size))
    for begin in range(0, len(anchors), step):
        part = anchors.iloc[begin : begin + step]
        scores = packed_rows.scores(unpacked(part["data"], packed_rows.length))
        yield from zip(part.itertuples(index=False), scores)


def _frame(rows: list[tuple], columns: str) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])


_POSITIVE = "anchor_id long, positive_id long, positive_score long"


def _positives(positives: int):
    def ask(built: dict, anchors: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = []
        for label, asking in anchors.groupby("label"):
            if label not in built:
                continue
            ids, candidates = built[label]
            for anchor, scores in _scored(candidates, asking):
                best = first_ones(scores, np.flatnonzero(ids != anchor.id), positives)
                rows += [(anchor.id, int(ids[i]), int(scores[i])) for i in best]
        yield from _frame(rows, _POSITIVE)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from shard_by_shard(frames, _by_label, ask)

    return task


_NEGATIVE = f"{_POSITIVE}, place int, negative_id long, negative_score long"


def _negatives(negatives: int, least: int, most: int):
    def build(rows: pd.DataFrame) -> tuple:
        rows = rows.sort_values("id", kind="stable")
        vectors = Packed(unpacked(rows["data"], rows["n"].iloc[0]))
        return rows["id"].to_numpy(), rows["label"].to_numpy(), vectors

    def ask(built: tuple, anchors: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, labels, candidates = built
        rows = []
        for anchor, scores in _scored(candidates, anchors):
            other = (labels != anchor.label) & (ids != anchor.id)
            for positive, score, place in zip(anchor.positives, anchor.scores, anchor.places):
                low, high = -(-least * int(score) // 100), most * int(score) // 100
                if low > high:
                    continue
                within = np.flatnonzero(other & (scores >= low) & (scores <= high))
                rows += [
                    (anchor.id, int(positive), int(score), place, int(ids[i]), int(scores[i]))
                    for i in first_ones(scores, within, negatives)
                ]
        yield from _frame(rows, _NEGATIVE)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from shard_by_shard(frames, build, ask)

    return task


def _meeting(rows: DataFrame, anchors: DataFrame, shards: int) -> DataFrame:
    """Rows and anchors (columns as in ``anchors``) brought together by ``shard``, rows first."""
    asked = rows.withColumn("asks", F.lit(False))
    both = asked.unionByName(anchors.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    return both.repartition(shards, "shard").sortWithinPartitions("shard", "n", "asks")


def mine(
    vectors: DataFrame,
    asks: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """For each anchor (a row for which ``asks`` holds) and positive, its hardest negatives.

    Positives are an anchor's ``positives`` best rows of its label; negatives the ``negatives``
    best rows of other labels that score at least ``least`` and at most ``most`` percent of the
    positive's score.  Higher scores come first, ties by smaller id.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.coalesce(asks, F.lit(False)).alias("anchor"),
        F.col(vector).alias("vector"),
    ).where("id IS NOT NULL AND label IS NOT NULL")
    rows = stored(packed(rows, "vector"), "vectors")
    total, longest = rows.agg(F.count(F.lit(1)), F.max("n")).first()
    a_shard = rows_per_shard(total, longest or 0, spark.sparkContext.defaultParallelism)
    shards = max(1, -(-total // a_shard))
    anchors = (
        rows.where("anchor")
        .groupBy("id")
        .agg(F.min(F.struct("label", "n", "data")).alias("first"))
        .select("id", "first.*")
    )
    rows = rows.drop("anchor")

    # Own label: its rows in as many shards as they need.
    sizes = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / a_shard).cast("int").alias("of"))
    sizes = stored(sizes, "labels")
    part = F.pmod(F.xxhash64("id"), F.col("of")).cast("int")
    own = rows.join(sizes, "label").withColumn("shard", F.xxhash64("label", part)).drop("of")
    parts = F.explode(F.sequence(F.lit(0), F.col("of") - 1))
    asking = (
        anchors.join(sizes, "label")
        .select("*", parts.alias("part"))
        .withColumn("shard", F.xxhash64("label", "part"))
        .drop("of", "part")
    )
    found = _meeting(own, asking, shards).mapInPandas(_positives(positives), _POSITIVE)
    best = stored(
        _ranked(found, ["anchor_id"], "positive", positives)
        .groupBy(F.col("anchor_id").alias("id"))
        .agg(F.collect_list(F.struct("positive_id", "positive_score", "rank")).alias("found"))
        .select(
            "id",
            F.col("found.positive_id").alias("positives"),
            F.col("found.positive_score").alias("scores"),
            F.col("found.rank").alias("places"),
        ),
        "positives",
    )

    # Other labels: all shards.
    zero, last = (F.lit(number).cast("long") for number in (0, shards - 1))
    everywhere = F.explode(F.sequence(zero, last))
    asking = anchors.join(best, "id").withColumn("shard", everywhere)
    all_rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    found = _meeting(all_rows, asking, shards).mapInPandas(
        _negatives(negatives, least, most), _NEGATIVE
    )
    ranked = _ranked(found, ["anchor_id", "place"], "negative", negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _ranked(found: DataFrame, of: list[str], what: str, most: int) -> DataFrame:
    best_first = Window.partitionBy(*of).orderBy(F.desc(f"{what}_score"), f"{what}_id")
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= most)
