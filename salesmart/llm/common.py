"""Helpers that several operators share: stored frames, ranks, components, grouped tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesmart.plans.scratch import scratch_path

#: Rows that a window over one bucket of a running total holds.
ROWS_PER_BUCKET = 20_000
#: Rows that go to Python at a time, and their bytes: no further row joins those that hold as many.
ROWS_AT_A_TIME = 500
BYTES_AT_A_TIME = 4_000_000
#: Characters of text that a task turns into Python objects at a time.
CHARS_AT_A_TIME = 2_000_000


#: Bits for each key in ``perhaps_among``, and at most in all: 16 MB.
BITS_PER_KEY = 64
MOST_BITS = 2**27

_tools: dict = {}


def kept_tool(key: tuple, make: Callable):
    """What a worker keeps from task to task for one operator, like words it has met.

    Workers outlive stages: the tool of one operator goes when another asks for its own, so
    that memory holds one of them.
    """
    if key not in _tools:
        drop_tools()
        _tools[key] = make()
    return _tools[key]


def drop_tools() -> None:
    """For tasks that keep nothing themselves; what others have kept goes back to the system."""
    _tools.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage, so a lost executor costs its running tasks only.  Texts go to Python in
    batches of ``ROWS_AT_A_TIME`` and ``BYTES_AT_A_TIME``, as the JVM and the worker hold a batch
    each.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    most = {"maxRecordsPerBatch": ROWS_AT_A_TIME, "maxBytesPerBatch": BYTES_AT_A_TIME}
    settings = {f"spark.sql.execution.arrow.{name}": str(n) for name, n in most.items()}
    before = {setting: spark.conf.get(setting) for setting in settings}
    try:
        for setting, value in settings.items():
            spark.conf.set(setting, value)
        df.write.parquet(path)
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, tables: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{tables.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it if ``df`` has such a column, in any case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def smallest_hashes(ids: DataFrame, key: str, most: int) -> DataFrame:
    """A repeatable sample of at most ``most`` rows: those whose key hashes lowest."""
    return ids.orderBy(F.xxhash64(F.lit("sample"), F.col(key)), key).limit(most)


def running_start(
    df: DataFrame, group: str, order: Sequence[str], size: str, out: str
) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows before this one in its group.

    ``group`` must not be null; ``order`` is any total order up to rows that are equal in
    it and in ``size``.  A group of any size is cut into buckets by a hash of ``order``;
    the bucket sums are added up first, so that no task sees more than a bucket.  The
    order within the group is therefore (bucket, order).  ``df`` is read twice: pass a
    stored frame.
    """
    buckets = max(1, -(-df.count() // ROWS_PER_BUCKET))
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        bucketed.groupBy(group, "_bucket")
        .agg(F.sum(size).alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    within = (
        Window.partitionBy(group, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        bucketed.join(bases, [group, "_bucket"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(size).over(within), F.lit(0)))
        .drop("_bucket", "_base")
    )


def perhaps_among(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` is among ``keys``, with few others, and the rest.

    Only the first can meet the keys in a join.  ``keys`` has one column of the type of ``key``;
    pass a stored frame.  The hashes of the keys set bits, and rows are told apart by the bit of
    theirs, where they are: only bits are sent to tasks, of a bounded number.  With more keys than
    bits there are more others among the first; no row is lost.
    """
    a_row = 8 * 4096  # bits that ``bitmap_construct_agg`` has in a row
    wanted = min(MOST_BITS, BITS_PER_KEY * keys.count())
    bits = a_row * max(1, -(-wanted // a_row))

    def bit(value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(bits))

    own = bit(F.col(keys.columns[0]))
    maps = (
        keys.select((own + 1).alias("_bit"))
        .groupBy(F.bitmap_bucket_number("_bit").alias("_map"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
    )
    sought = bit(F.col(key))
    at = F.bitmap_bit_position(sought + 1)
    byte = F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))
    there = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(at, F.lit(8)).cast("int"))
    told = rows.withColumn("_map", F.bitmap_bucket_number(sought + 1))
    told = told.join(F.broadcast(maps), "_map", "left")
    among = F.coalesce(there == 1, F.lit(False))
    return told.where(among).select(*rows.columns), told.where(~among).select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, component), the smallest node reachable.

    ``edges`` has long columns ``a`` and ``b``, in any direction, repeats and loops
    allowed.  Alternates large-star and small-star steps until the edges form stars,
    about log2(nodes) rounds; every round is a group-by and a join on nodes, written to
    the shared folder.  Only the number of changed edges reaches the driver.
    """
    current = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    while True:
        # Large star: a node's larger neighbours are hung on its smallest neighbour.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        large = stored(large, "large_star")
        # Small star: a node and its smaller neighbours are hung on the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.withColumnRenamed("m", "v"))
            .where("u != v")
            .distinct()
        )
        small = stored(small, "small_star")
        changed = current.exceptAll(small).unionByName(small.exceptAll(current)).isEmpty()
        current = small
        if changed:
            break
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.unionByName(centres)


def per_run(
    frames: Iterator[pd.DataFrame], keys: Sequence[str], task: Callable
) -> Iterator[pd.DataFrame]:
    """Calls ``task`` on each run of rows with equal ``keys`` of a sorted partition.

    Unlike a grouped map it costs microseconds a group.  ``task`` returns a list of tuples or
    None; the caller names the columns.
    """
    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        marks = np.zeros(len(frame), bool)
        for key in keys:
            values = frame[key].to_numpy()
            marks[1:] |= values[1:] != values[:-1]
        starts = np.r_[0, np.flatnonzero(marks)]
        columns = {name: frame[name].to_numpy() for name in frame.columns}
        for begin, end in zip(starts[:-1], starts[1:]):
            yield from task({name: values[begin:end] for name, values in columns.items()}) or ()
        rest = frame.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield from task({name: rest[name].to_numpy() for name in rest.columns}) or ()


def batched(
    rows: Iterator[tuple],
    columns: Sequence[str],
    at_a_time: int = 20_000,
    bytes_together: int = 8_000_000,
):
    """Pandas frames of rows, as objects: nulls must not round integers.

    Each has up to ``at_a_time`` rows; no further row joins those that hold ``bytes_together``.
    """
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(value) for value in row if isinstance(value, (bytes, str)))
        if len(held) >= at_a_time or size >= bytes_together:
            yield pd.DataFrame(held, columns=list(columns), dtype=object)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=list(columns), dtype=object)


def find_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` indices by the given links."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root
