"""Exact top-k search by inner product, with ball trees.

Rows are dealt to cells by the nearest of a few centres, and within a cell by a hash to shards
that a task can hold.  A cell's ball, around its centre, bounds the inner product of a query
with any of its rows by q.c + |q| r.  Each shard has a ball tree; a query visits the nodes in
the order of their bounds until the next bound is below its current k-th score.

The k-th score is shared: every query first searches one shard of its most promising cell, and
then takes the k-th score found there to all other shards whose cell may still hold better
rows.  Results are exact for any centres, which only decide how much is ruled out.

Rows with a null id or a vector that takes no part (``whole_vectors``) are left out, as
candidates and as queries.  Repeated rows are candidates each, so a result can name an id
twice; rows with the query's id are never its candidates.  Of a repeated query id the smallest
vector asks.  A query with fewer than k candidates gets all of them.  Other columns, whatever
their names, are ignored; empty tables give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesmart.llm.common import stored
from salesmart.llm.whole_vectors import (
    HIGHEST,
    exact_products,
    first_ones,
    packed,
    rows_per_shard,
    shard_by_shard,
    unpacked,
)

#: Rows of a leaf.
LEAF = 256
#: Centres at most, and the rows (and components in them) that they are taken from.
MOST_CELLS = 256
SAMPLE = 16_384
SAMPLE_COMPONENTS = 4_000_000
#: Share by which bounds are raised against rounding.
SLACK = 1e-9
#: Queries whose bounds are computed at a time.
ASKED = 256
#: The cell of rows whose length is not that of the centres.
ELSEWHERE = -1


def halves(rows: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut ``order`` in two equal parts along the line between two far-off rows."""
    part = rows[order]
    first = part[np.argmax(_squares(part - part.mean(axis=0)))]
    second = part[np.argmax(_squares(part - first))]
    ranked = np.argsort(part @ (second - first), kind="stable")
    middle = len(order) // 2
    return order[ranked[:middle]], order[ranked[middle:]]


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


class BallTree:
    """Rows in nested balls: a node's children are ``left`` and ``left + 1``."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        orders, self.left, centres, radii = [np.argsort(ids, kind="stable")], [], [], []
        for order in orders:  # grows while it is read
            part = rows[order]
            centres.append(part.mean(axis=0))
            radii.append(np.sqrt(_squares(part - centres[-1]).max()))
            self.left.append(0)
            if len(order) > leaf and radii[-1] > 0:
                self.left[-1] = len(orders)
                orders.extend(halves(rows, order))
        self.centres, self.radii = np.array(centres), np.array(radii)
        # Leaves hold ids in ascending order, so that ties go to the smaller one.
        self.leaves = {}
        for node, order in enumerate(orders):
            if not self.left[node]:
                order = order[np.argsort(ids[order], kind="stable")]
                self.leaves[node] = ids[order], rows[order]

    def search(self, name: int, query: np.ndarray, bounds: np.ndarray, kth: float, k: int):
        """(scores, ids) of up to k rows with a score of at least ``kth``, best first."""
        scores, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        frontier = [(-bounds[0], 0)]
        while frontier:
            bound, node = heapq.heappop(frontier)
            if -bound < kth:
                break  # so are all others
            if child := self.left[node]:
                for next_node in (child, child + 1):
                    if bounds[next_node] >= kth:
                        heapq.heappush(frontier, (-bounds[next_node], next_node))
                continue
            leaf_ids, leaf_rows = self.leaves[node]
            found = exact_products(leaf_rows, query)
            best = first_ones(found, np.flatnonzero((found >= kth) & (leaf_ids != name)), k)
            if len(best):
                scores = np.concatenate([scores, found[best]])
                ids = np.concatenate([ids, leaf_ids[best]])
                first = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[first], ids[first]
                if len(ids) == k:
                    kth = max(kth, int(scores[-1]))
        return scores, ids


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The highest inner product that each query can have within each ball."""
    length = np.sqrt(_squares(queries))[:, None]
    around = length * np.sqrt(_squares(centres))
    return queries @ centres.T + length * radii + SLACK * (around + length * radii) + SLACK


_FOUND = "query_id long, vec_id long, score long"


def _search(k: int):
    def build(rows: pd.DataFrame) -> BallTree:
        return BallTree(rows["id"].to_numpy(), unpacked(rows["data"], rows["n"].iloc[0]))

    def ask(tree: BallTree, asking: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = []
        for begin in range(0, len(asking), ASKED):
            part = asking.iloc[begin : begin + ASKED]
            queries = unpacked(part["data"], tree.centres.shape[1])
            bounds = upper_bounds(queries, tree.centres, tree.radii)
            for name, query, bound, kth in zip(
                part["id"].tolist(), queries, bounds, part["kth"].tolist()
            ):
                scores, ids = tree.search(name, query, bound, kth, k)
                out += [(name, i, score) for score, i in zip(scores.tolist(), ids.tolist())]
        if out:
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from shard_by_shard(frames, build, ask)

    return task


def centres_of(rows: np.ndarray, cells: int) -> np.ndarray:
    """Centres of the first levels of a ball tree over ``rows``, ``cells`` at most."""
    parts = [np.arange(len(rows))]
    while len(parts) < cells:
        largest = max(range(len(parts)), key=lambda i: len(parts[i]))
        if len(parts[largest]) < 2:
            break
        parts.extend(halves(rows, parts.pop(largest)))
    return np.array([rows[part].mean(axis=0) for part in parts])


def _placed(centres: np.ndarray):
    """Each row's cell and its distance from the centre."""
    n = centres.shape[1]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = _squares(centres) / 2
        for frame in frames:
            cell = np.full(len(frame), ELSEWHERE, np.int32)
            away = np.zeros(len(frame))
            for begin in range(0, len(frame), 4_096):
                mine = begin + np.flatnonzero(frame["n"].iloc[begin : begin + 4_096] == n)
                rows = unpacked(frame["data"].iloc[mine], n)
                cell[mine] = np.argmax(rows @ centres.T - half, axis=1)
                away[mine] = np.sqrt(_squares(rows - centres[cell[mine]]))
            yield frame.assign(cell=cell, away=away)

    return task


def _routed(centres: np.ndarray, cells: dict[int, tuple[int, float]], home: bool):
    """The shards where a query goes: one of its best cell, or all others that may matter.

    ``cells`` has the number of shards and the radius of each cell that has rows.
    """
    names = np.array([cell for cell in cells if cell != ELSEWHERE], np.int64)
    radii = np.array([cells[cell][1] for cell in names.tolist()])
    n = centres.shape[1]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, targets, parts = [], [], []

            def go(row: int, cell: int, part: int) -> None:
                rows.append(row), targets.append(cell), parts.append(part)

            asking = zip(frame["id"].tolist(), frame["n"], frame["data"], frame["kth"].tolist())
            for i, (name, size, data, kth) in enumerate(asking):
                if size == n and len(names):
                    query = unpacked([data], n)
                    bounds = upper_bounds(query, centres[names], radii)[0]
                    best, among = names[np.argmax(bounds)], names
                    if not home:
                        among = names[bounds >= kth]
                elif ELSEWHERE in cells:
                    best, among = ELSEWHERE, [ELSEWHERE]
                else:
                    continue
                first = name % cells[int(best)][0]
                if home:
                    go(i, int(best), first)
                    continue
                for cell in map(int, among):
                    for part in range(cells[cell][0]):
                        if (cell, part) != (best, first):
                            go(i, cell, part)
            yield frame.iloc[rows].assign(
                cell=np.array(targets, np.int32), part=np.array(parts, np.int32)
            )

    return task


def search(
    vectors: DataFrame,
    asks: Column,
    k: int,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The ``k`` rows with the highest inner product for each row for which ``asks`` holds.

    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(asks, F.lit(False)).alias("query"),
        F.col(vector).alias("vector"),
    ).where("id IS NOT NULL")
    rows = stored(packed(rows, "vector"), "vectors")
    total, longest = rows.agg(F.count(F.lit(1)), F.max("n")).first()
    a_shard = rows_per_shard(total, longest or 0, spark.sparkContext.defaultParallelism)
    centres = _fitted(rows, min(MOST_CELLS, max(1, -(-total // a_shard))))
    queries = (
        rows.where("query").groupBy("id").agg(F.min(F.struct("n", "data")).alias("first"))
    )
    queries = stored(
        queries.select("id", "first.*", F.lit(-HIGHEST).cast("long").alias("kth")), "queries"
    )
    rows = rows.drop("query").mapInPandas(
        _placed(centres), "id long, n int, data binary, cell int, away double"
    )
    rows = stored(rows, "placed")
    of_cells = rows.groupBy("cell").agg(F.count(F.lit(1)), F.max("away")).collect()
    cells = {  # a row for each centre
        cell: (-(-size // a_shard), radius * (1 + SLACK) + SLACK) for cell, size, radius in of_cells
    }
    shards = max(1, sum(of for of, _ in cells.values()))
    of = F.create_map(*[F.lit(x) for cell in cells for x in (cell, cells[cell][0])]) if cells else None
    part = F.pmod(F.xxhash64("id"), of[F.col("cell")]) if cells else F.lit(0)
    rows = rows.withColumn("part", part.cast("int")).drop("away")

    def wave(asking: DataFrame, home: bool) -> DataFrame:
        routed = asking.mapInPandas(
            _routed(centres, cells, home),
            "id long, n int, data binary, kth long, cell int, part int",
        )
        both = rows.withColumns(
            {"kth": F.lit(-HIGHEST).cast("long"), "asks": F.lit(False)}
        ).unionByName(routed.withColumn("asks", F.lit(True)))
        both = both.withColumn("shard", F.xxhash64("cell", "part")).drop("cell", "part")
        met = both.repartition(shards, "shard").sortWithinPartitions("shard", "n", "asks")
        return met.mapInPandas(_search(k), _FOUND)

    first = stored(wave(queries, True), "first_found")
    kth = first.groupBy(F.col("query_id").alias("id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth")
    )
    others = wave(
        queries.drop("kth")
        .join(kth, "id", "left")
        .withColumn("kth", F.coalesce("kth", F.lit(-HIGHEST))),
        False,
    )
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        first.unionByName(others)
        .withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _fitted(rows: DataFrame, cells: int) -> np.ndarray:
    """Centres from rows with low hashes, a bounded number, of the most frequent length."""
    lengths = rows.groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return np.zeros((1, 0))
    n, total = lengths[0]["n"], lengths[0]["count"]
    most = max(1, min(SAMPLE, SAMPLE_COMPONENTS // max(1, n)))
    low = F.pmod(F.xxhash64("id"), F.lit(total)) < most
    drawn = rows.where((F.col("n") == n) & low).select("data").limit(most).collect()
    drawn = drawn or rows.where(F.col("n") == n).select("data").limit(1).collect()
    return centres_of(unpacked([row["data"] for row in drawn], n), cells)
