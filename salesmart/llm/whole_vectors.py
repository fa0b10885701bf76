"""Vectors of whole numbers: packing, sharding and exact inner products.

A vector's components become ``floor(256 * x)``, x as double.  Doubles hold these numbers
exactly.  A row takes no part if its id is null or its vector is null or holds a null or
non-finite component (or one that is not finite 256-fold).  Vectors of different lengths do not
compare; empty vectors compare with each other at a score of 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructType

SCALE = 256
#: Rows of a shard, and their bytes as doubles, at most; rows of a shard at least.
SHARD_ROWS = 65_536
SHARD_BYTES = 64 * 1024**2
FEWEST_ROWS = 1_024
#: The largest whole number up to which doubles hold all.
EXACT = 2**53
#: The highest score, and with the sign changed the lowest; scores beyond are held there.
HIGHEST = 2**63 - 1


def packed(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` that take part, with ``n`` and ``data`` (whole components) for ``vector``."""
    x = F.col(vector)
    largest = F.lit(float(np.finfo(np.float64).max) / SCALE)
    # NaN is larger than any number here, so it goes too.
    odd = F.exists(x, lambda c: c.isNull() | (F.abs(c.cast("double")) > largest))
    rows = rows.where(x.isNotNull()).where(~odd).withColumn(vector, x.cast("array<double>"))
    others = [name for name in rows.columns if name != vector]
    schema = StructType([rows.schema[name] for name in others]).add("n", IntegerType()).add(
        "data", BinaryType()
    )

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = [np.floor(SCALE * np.asarray(v, np.float64)) for v in frame[vector]]
            yield frame[others].assign(
                n=np.array([len(v) for v in vectors], np.int32), data=[_bytes(v) for v in vectors]
            )

    return rows.mapInPandas(task, schema)


def _bytes(vector: np.ndarray) -> bytes:
    """Four bytes a component where they hold it exactly, else eight."""
    narrow = vector.astype(np.float32)
    return (narrow if np.array_equal(narrow, vector) else vector).tobytes()


def unpacked(data: Sequence[bytes], n: int) -> np.ndarray:
    """Rows of ``n`` doubles."""
    out = np.empty((len(data), n), np.float64)
    for i, packed_row in enumerate(data):
        out[i] = np.frombuffer(packed_row, np.float32 if len(packed_row) == 4 * n else np.float64)
    return out


def rows_per_shard(rows: int, longest: int, tasks: int) -> int:
    """So many that a shard fits a task and, for small tables, that all tasks have one."""
    fitting = max(FEWEST_ROWS, min(SHARD_ROWS, SHARD_BYTES // (8 * max(longest, 1))))
    return min(fitting, max(FEWEST_ROWS, -(-rows // max(tasks, 1))))


def exact_products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products as longs, held at ``HIGHEST`` beyond."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    if rows.shape[1] * np.abs(rows).max() * np.abs(vector).max() < EXACT:
        return (rows @ vector).astype(np.int64)
    return held(whole(rows) @ whole(vector))


def whole(values: np.ndarray) -> np.ndarray:
    """Python integers of any size."""
    flat = np.array([int(v) for v in values.ravel()], dtype=object)
    return flat.reshape(values.shape)


def held(values: np.ndarray) -> np.ndarray:
    """Python integers as longs, held at ``HIGHEST`` beyond."""
    return np.clip(values, -HIGHEST, HIGHEST).astype(np.int64)


def shard_by_shard(
    frames: Iterator[pd.DataFrame], build: Callable, ask: Callable
) -> Iterator[pd.DataFrame]:
    """Streams the askers of each shard past its rows.

    Partitions are sorted by ``shard``, ``n`` and ``asks``, so that the rows of a shard (asks
    false) come before its askers (asks true).  ``build(rows)`` is called once a shard,
    ``ask(built, askers)`` for some askers at a time; memory holds a shard and those.
    """
    key, rows, built = None, [], None
    for frame in frames:
        shards, n, asks = (frame[c].to_numpy() for c in ("shard", "n", "asks"))
        marks = (shards[1:] != shards[:-1]) | (n[1:] != n[:-1]) | (asks[1:] != asks[:-1])
        cuts = [0, *(np.flatnonzero(marks) + 1).tolist(), len(frame)]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            if begin == end:
                continue
            if key != (shards[begin], n[begin]):
                key, rows, built = (shards[begin], n[begin]), [], None
            if not asks[begin]:
                rows.append(frame.iloc[begin:end])
            elif rows or built is not None:
                if built is None:
                    built, rows = build(pd.concat(rows, ignore_index=True)), []
                yield from ask(built, frame.iloc[begin:end])


def first_ones(scores: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """Of the ascending places ``among``, those of the ``most`` highest scores, best first.

    Of equal scores the lower places come first.
    """
    if len(among) > most:
        values = scores[among]
        least = np.partition(values, len(values) - most)[len(values) - most]
        above = among[values > least]
        among = np.concatenate([above, among[values == least][: most - len(above)]])
    return among[np.argsort(-scores[among], kind="stable")]
