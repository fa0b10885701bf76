"""Near-copies among embeddings: spherical k-means cells, blocked cosine products in cells.

Vectors of equal label and equal components are one class from the start.  A sample gives
unit centroids; every class belongs to the cell of its nearest centroid (its home) and is
also a guest in each cell where a linked vector could be at home.  Within a cell all homes
are multiplied with all homes and guests, block by block.  So each link of a class is found
in its home cell, once, and counts need no pairs to leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import batched, components, find_roots, per_run, stored

THRESHOLD = 0.93
#: Vectors that centroids are fitted on, and components in them at most; steps of the fit.
SAMPLE = 16_384
SAMPLE_COMPONENTS = 4_000_000
STEPS = 12
#: Classes for each centroid, and the most centroids that a task compares a vector with.
CLASSES_PER_CELL = 4_096
MOST_CELLS = 1_024
#: Share of the cells that a vector visits beyond which cells rule out too little: one cell then
#: compares about the same pairs and holds each vector once.
MOST_VISITED = 0.5
#: Vectors in a block.
BLOCK = 2_048
#: Rows multiplied at a time.
TILE = 1_024


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow or underflow on the way."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def centroids(units: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means: unit vectors, each the direction of the sum of its members."""
    random = np.random.default_rng(seed)
    centres = units[random.choice(len(units), min(cells, len(units)), replace=False)].copy()
    for _ in range(STEPS):
        home = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, units)
        length = np.sqrt((sums * sums).sum(axis=1))
        full = length > 1e-9
        centres[full] = sums[full] / length[full, None]
    return centres


def guests(
    units: np.ndarray, centres: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each row, and a mask (rows x cells) of the cells it visits.

    Vectors x and y with a cosine of ``threshold`` differ by at most r = sqrt(2 - 2
    threshold).  If x is at home in c and y in h, then y.(h - c) <= (y - x).(h - c), at most
    r |h - c|.  Near-copies may differ in any direction, so nothing less than that will do,
    however many dimensions there are.
    """
    scores = units @ centres.T
    home = np.argmax(scores, axis=1)
    reach = np.sqrt(2 - 2 * threshold) + 1e-9
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    gap = scores[np.arange(len(units)), home][:, None] - scores
    return home, gap <= reach * apart[home]


def _cells(centres: np.ndarray, threshold: float):
    """Each class once for its home cell and once for every cell it visits."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), 2_000):
                part = frame.iloc[begin : begin + 2_000]
                units = unit_rows(np.array(part["vector"].tolist(), np.float64))
                home, visits = guests(units, centres, threshold)
                row, cell = np.nonzero(visits)
                data = [u.tobytes() for u in units]
                yield pd.DataFrame(
                    {
                        "part": part["part"].to_numpy()[row],
                        "cell": cell.astype(np.int32),
                        "at_home": home[row] == cell,
                        "class": part["class"].to_numpy()[row],
                        "copies": part["copies"].to_numpy()[row],
                        "data": [data[r] for r in row],
                    }
                )

    return task


_PACKED = "part long, cell int, block int, homes int, names binary, copies binary, data binary"


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A block's vectors in one row, those at home first."""

    def block(run: dict) -> list[tuple]:
        order = np.argsort(~run["at_home"].astype(bool), kind="stable")
        return [
            (
                int(run["part"][0]),
                int(run["cell"][0]),
                int(run["block"][0]),
                int(run["at_home"].sum()),
                run["class"][order].tobytes(),
                run["copies"][order].tobytes(),
                b"".join(run["data"][order]),
            )
        ]

    names = ["part", "cell", "block", "homes", "names", "copies", "data"]
    yield from batched(per_run(frames, ["part", "cell", "block"], block), names, 16)


_FOUND = "class long, links long, other long"


def _compare(threshold: float):
    """Homes of one block against all of another: links of each home, and a forest."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                left = np.frombuffer(row.names, np.int64)
                right = np.frombuffer(row.other_names, np.int64)
                copies = np.frombuffer(row.other_copies, np.int64)
                x = np.frombuffer(row.data, np.float64).reshape(len(left), -1)[: row.homes]
                y = np.frombuffer(row.other_data, np.float64).reshape(len(right), -1)
                left, links, edges = left[: row.homes], np.zeros(row.homes, np.int64), []
                for a in range(0, len(left), TILE):
                    for b in range(0, len(right), TILE):
                        near = x[a : a + TILE] @ y[b : b + TILE].T >= threshold
                        near &= left[a : a + TILE, None] != right[None, b : b + TILE]
                        if near.any():
                            links[a : a + TILE] += near @ copies[b : b + TILE]
                            edges += _forest(left[a : a + TILE], right[b : b + TILE], near)
                out = [(int(c), int(n), None) for c, n in zip(left, links) if n]
                out += [(u, None, v) for u, v in edges]
                yield pd.DataFrame(out, columns=["class", "links", "other"], dtype=object).astype(
                    "Int64"
                )

    return task


def _forest(left: np.ndarray, right: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    names = np.concatenate([left, right])
    i, j = np.nonzero(near)
    root = find_roots(len(names), i, j + len(left))
    return [(int(names[k]), int(names[r])) for k, r in enumerate(root) if names[k] != names[r]]


def near_copies(
    embeddings: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths are equal, and the
    cosine, in double precision, is at least ``threshold``; n_links counts other vectors
    linked directly, copies each.  component_id is the smallest vec_id that links lead to,
    itself included, and kept says whether it is the row's own.  Null, empty and zero
    vectors, those with a null or non-finite component, and rows with a null label or id
    link with nothing and are kept.  Rows that repeat an id count each.  An empty table
    gives an empty result; other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(
        "vec_id", "label", F.col(vector).cast("array<double>").alias("vector")
    )
    sound = F.expr(
        "vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0"
        " AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        " AND exists(vector, x -> x != 0)"
    )
    # -0.0 and 0.0 are the same component; + 0.0 turns one into the other.
    rows = stored(
        rows.withColumn("sound", F.coalesce(sound, F.lit(False))).select(
            "vec_id",
            "sound",
            F.xxhash64("label", F.size("vector")).alias("part"),
            F.when(F.col("sound"), F.transform("vector", lambda x: x + F.lit(0.0))).alias("vector"),
        ),
        "vectors",
    ).withColumn("class", F.when(F.col("sound"), F.xxhash64("part", "vector")))
    classes = stored(
        rows.where("sound")
        .groupBy("class", "part", "vector")
        .agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies")),
        "classes",
    )
    found = []
    for r in classes.groupBy(F.size("vector").alias("n")).count().orderBy("n").collect():
        same = classes.where(F.size("vector") == r["n"])
        found.append(_links_of_length(same, r["n"], r["count"], threshold))
    exact = spark.createDataFrame([], _FOUND)
    for frame in found:
        exact = exact.unionByName(frame)
    exact = stored(exact, "links")
    links = exact.where("links IS NOT NULL").groupBy("class").agg(F.sum("links").alias("links"))
    linked = components(
        exact.where("other IS NOT NULL").select(
            F.col("class").alias("a"), F.col("other").alias("b")
        )
    ).select(F.col("node").alias("class"), "component")
    of_class = (
        classes.select("class", "class_id", "copies")
        .join(links, "class", "left")
        .join(linked, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    named = of_class.groupBy("component").agg(F.min("class_id").alias("component_id"))
    of_class = of_class.join(named, "component").select(
        "class",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        "component_id",
    )
    component = F.coalesce("component_id", "vec_id")
    return (
        rows.select("vec_id", "class")
        .join(of_class, "class", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
        )
    )


def _links_of_length(
    classes: DataFrame, length: int, number: int, threshold: float
) -> DataFrame:
    """Links between classes of one vector length (columns of ``_FOUND``)."""
    sample = classes.orderBy(F.xxhash64(F.lit("sample"), "class"), "class").limit(
        max(1, min(SAMPLE, SAMPLE_COMPONENTS // length))
    )
    vectors = np.array([r["vector"] for r in sample.select("vector").toLocalIterator()], np.float64)
    cells = max(1, min(MOST_CELLS, -(-number // CLASSES_PER_CELL)))
    units = unit_rows(vectors)
    centres = centroids(units, cells)
    if guests(units[:TILE], centres, threshold)[1].mean() > MOST_VISITED:
        centres = centres[:1]
    placed = stored(
        classes.select("part", "class", "copies", "vector").mapInPandas(
            _cells(centres, threshold),
            "part long, cell int, at_home boolean, class long, copies long, data binary",
        ),
        "cells",
    )
    sizes = placed.groupBy("part", "cell").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    )
    packed = stored(
        placed.join(sizes, ["part", "cell"])
        .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .drop("blocks")
        .repartition("part", "cell", "block")
        .sortWithinPartitions("part", "cell", "block")
        .mapInPandas(_pack, _PACKED),
        "blocks",
    )
    other = packed.select(
        F.col("part").alias("_part"),
        F.col("cell").alias("_cell"),
        *[F.col(c).alias(f"other_{c}") for c in ("block", "names", "copies", "data")],
    )
    pairs = packed.where("homes > 0").join(
        other, (F.col("part") == F.col("_part")) & (F.col("cell") == F.col("_cell"))
    )
    return (
        pairs.repartition(F.xxhash64("part", "cell", "block", "other_block"))
        .mapInPandas(_compare(threshold), _FOUND)
    )
