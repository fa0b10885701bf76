"""CSV files whose quoted texts hold line breaks, read in parts all the same.

A part of a file may begin inside a quoted text.  What a line does to that state is a function of
the state it begins in: with open quotes or without.  Functions compose: a first scan puts each
block of a file into one, the few blocks of a file are put together in order, and a second scan
knows the state that each line of a block begins in.  There the lines of a record are joined where
they are read; what is shuffled are a row for each block and the records that cross the end of a
block.  Only files that have such breaks take this way; whether they do is found by a scan of
their lines.

Quotes count as the reader has them: one opens a text at the start of a field only, doubled ones
are part of the text.  Lines end with LF or CRLF; breaks inside texts stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.plans.scratch import stored
from salesmart.sources.files import file_name

# Whole fields, then one that is opened and not closed.
_OPEN = r'^(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|),)*+"(?:[^"]++|"")*+\z'


def ends_open(line: Column) -> Column:
    """Whether a line that begins outside of quotes ends inside."""
    return F.coalesce(F.contains(line, F.lit('"')) & line.rlike(_OPEN), F.lit(False))


def stays_open(line: Column) -> Column:
    """Whether a line that begins inside of quotes ends inside."""
    return ~F.contains(line, F.lit('"')) | ends_open(F.concat(F.lit('"'), line))


def plain_path(path: str) -> str:
    """A path that is no pattern."""
    return re.sub(r"([][{}*?^,\\])", r"\\\1", path)


def lines_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The lines of files with their file's name, block and place in it."""
    lines = spark.read.option("lineSep", "\n").text([plain_path(path) for path in paths])
    return lines.select(
        "value", file_name().alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


@contextmanager
def _same_blocks(spark: SparkSession) -> Iterator[None]:
    """Files are cut into the same blocks, however many cores come or go meanwhile."""
    setting = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(setting, None)
    if before is None:
        cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
        spark.conf.set(setting, cores or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)


class _States:
    """Composes what lines (or blocks) do to the state, over a window in order.

    Something that ends in the same state whatever it begins in is fixed; otherwise it keeps
    the state or turns it.  The state is that of the last fixed one, turned by all after it.
    """

    def __init__(self, closed: Column, opened: Column, over) -> None:
        fixed, turns = closed == opened, (closed & ~opened).cast("int")
        turned = F.sum(turns).over(over)
        self.turned = F.coalesce(turned, F.lit(0))
        own = closed.cast("int")
        # Its turns lie before the fixed one and do not count.
        self.last = F.last(F.when(fixed, own), ignorenulls=True).over(over)
        self.then = F.last(F.when(fixed, F.col("_turned")), ignorenulls=True).over(over)

    def after(self, begin: Column) -> Column:
        """Whether quotes are open after all in the window, begun in state ``begin``."""
        turns = self.turned - F.coalesce(self.then, F.lit(0))
        start = F.coalesce(self.last, begin.cast("int"))
        return (start + turns) % 2 == 1


def _after(closed: np.ndarray, opened: np.ndarray, begin: bool) -> np.ndarray:
    """Whether quotes are open after each line, the first of which begins in state ``begin``."""
    fixed, turned = closed == opened, np.cumsum(closed & ~opened)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(closed)), -1))
    start = np.where(last >= 0, closed[last], begin)
    return start ^ ((turned - np.where(last >= 0, turned[last], 0)) % 2 == 1)


def _of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs of lines of one block: its file and number, and the lines."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file = batch.column("file").to_numpy(zero_copy_only=False)
        block = batch.column("block").to_numpy(zero_copy_only=False)
        ends = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for begin, end in zip([0, *ends.tolist()], [*ends.tolist(), len(block)]):
            yield (file[begin], int(block[begin])), batch.slice(begin, end - begin)


def _flags(lines: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(lines.column(c).to_numpy(zero_copy_only=False) for c in ("closed", "opened"))


_BLOCK = "file string, block long, closed boolean, opened boolean, begun_closed long, begun_opened long"


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block does to the state, and how many records begin in it, for both states."""
    names = [column.split()[0] for column in _BLOCK.split(", ")]
    now, state, begun = None, [False, True], [0, 0]
    for key, lines in _of_blocks(batches):
        if key != now:
            if now is not None:
                yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, *state, *begun)))])
            now, state, begun = key, [False, True], [0, 0]
        closed, opened = _flags(lines)
        for i in range(2):
            after = _after(closed, opened, state[i])
            begun[i] += int((not state[i]) + (~after[:-1]).sum())
            state[i] = bool(after[-1])
    if now is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, *state, *begun)))])


_RECORD = "file string, block long, record long, value string, whole boolean"


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each block; those that begin before it or end after it are not whole."""
    now, state, record, held, own = None, False, 0, [], False

    def rows(key, records, values, whole) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "file": pa.array([key[0]] * len(records), pa.string()),
                "block": pa.array([key[1]] * len(records), pa.int64()),
                "record": pa.array(records, pa.int64()),
                "value": values,
                "whole": pa.array([whole] * len(records), pa.bool_()),
            }
        )

    def finished(whole: bool) -> Iterator[pa.RecordBatch]:
        if held:
            yield rows(now, [record], pa.array(["\n".join(held)], pa.string()), whole)
            held.clear()

    for key, lines in _of_blocks(batches):
        if key != now:
            yield from finished(False)
            begins = lines.column("begins")[0].as_py()
            if begins is None:
                raise RuntimeError(f"{key[0]} was cut into other blocks than before")
            # Lines before the first record are of one that began in an earlier block.
            now, state, own = key, begins, False
            record = lines.column("records_before")[0].as_py()
        after = _after(*_flags(lines), state)
        starts = np.flatnonzero(~np.r_[state, after[:-1]])
        state = bool(after[-1])
        values = lines.column("value").cast(pa.string())
        if not len(starts):
            held.extend(values.to_pylist())
            continue
        held.extend(values.slice(0, int(starts[0])).to_pylist())
        yield from finished(own)
        ends = np.r_[starts, len(values)]
        if state:  # the last one goes on
            held.extend(values.slice(int(starts[-1])).to_pylist())
            ends = ends[:-1]
        if len(ends) > 1:
            joined = pc.binary_join(
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), "\n"
            )
            yield rows(now, np.arange(1, len(ends)) + record, joined, True)
        record, own = record + len(starts), True
    yield from finished(False)


def records(lines: DataFrame) -> DataFrame:
    """The records of some files' lines: file, record (from 1) and value."""
    marked = lines.withColumns(
        {"closed": ends_open(F.col("value")), "opened": stays_open(F.col("value"))}
    )
    with _same_blocks(lines.sparkSession):
        blocks = stored(
            marked.select("file", "block", "closed", "opened").mapInArrow(_summed_up, _BLOCK),
            "blocks",
        )
        begun = stored(_begins(blocks), "blocks")
        # A row for each block of a file.
        known = marked.join(F.broadcast(begun), ["file", "block"], "left")
        found = stored(known.mapInArrow(_put_together, _RECORD), "records")
    ordered = F.sort_array(F.collect_list(F.struct("block", "value")))
    crossing = (
        found.where("NOT whole")
        .groupBy("file", "record")
        .agg(F.array_join(ordered["value"], "\n").alias("value"))
    )
    return found.where("whole").select("file", "record", "value").unionByName(crossing)


def _begins(blocks: DataFrame) -> DataFrame:
    """Whether each block begins inside of quotes, and how many records have begun before it."""
    closed, opened = F.col("closed"), F.col("opened")
    of_file = W.partitionBy("file").orderBy("block")
    upto = of_file.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = of_file.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_turned", F.sum((closed & ~opened).cast("int")).over(upto))
    blocks = blocks.withColumn("begins", _States(closed, opened, before).after(F.lit(False)))
    begun = F.when(F.col("begins"), F.col("begun_opened")).otherwise(F.col("begun_closed"))
    return blocks.select(
        "file",
        "block",
        "begins",
        F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("records_before"),
    )


def read_quoted(
    spark: SparkSession, paths: Sequence[str], schema: str, options: dict[str, str]
) -> DataFrame:
    """Rows of CSV files with a header row: ``file`` and the columns of ``schema``."""
    found = records(lines_of(spark, paths)).where("record > 1")
    text = F.regexp_replace("value", r"\r\z", "")
    kept = {key: value for key, value in options.items() if key != "header"}
    # Breaks inside texts are left as they are with multiLine only.
    row = F.from_csv(text, schema, {**kept, "multiLine": "true"})
    return found.where(text != "").select("file", row.alias("row")).select("file", "row.*")
