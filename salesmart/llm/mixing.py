"""Mixing sources to target weights, by blocks of words.

The words of each source are laid end to end and cut into blocks of a fixed length.  Every
output shard draws how many of its slots each source gets (multinomial, from what is left of
the targets).  The n-th slot of a source is mapped through the source's pseudorandom index
permutations, a new one for every pass over the source, to a block; slots and blocks then
meet in a join on the block's index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from salesmart.llm.common import drop_tools, running_start, stored

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD_PATTERN)
WEIGHTS = (5.0, 2.0, 1.0)
#: Size of the mix over the size of all sources, and the most passes over one source.
VOLUME = 1.5
MOST_PASSES = 2.0
#: Words in a block; output shards at least, and slots that a shard is meant for.
BLOCK_WORDS = 64
SHARDS = 64
SLOTS_PER_SHARD = 1_000_000
SEED = 20_240_501


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(
    sizes: Sequence[float],
    weights: Sequence[float] = WEIGHTS,
    volume: float = VOLUME,
    most_passes: float = MOST_PASSES,
) -> list[float]:
    """Words to take from each source: shares by weight (repeating), none above its limit.

    What a source cannot take is shared among the others by weight, until none is above
    ``most_passes`` times its size.
    """
    limits = [most_passes * size for size in sizes]
    shares = [weights[i % len(weights)] for i in range(len(sizes))]
    open_, left, out = set(range(len(sizes))), volume * sum(sizes), [0.0] * len(sizes)
    while open_:
        total = sum(shares[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if left * shares[i] / total >= limits[i]]
        if not full:
            for i in open_:
                out[i] = left * shares[i] / total
            break
        for i in full:
            out[i] = float(limits[i])
            open_.remove(i)
        left -= sum(limits[i] for i in full)
    return out


@dataclass(frozen=True)
class Mix:
    """``sources``: source, position, source_size, target, blocks, slots (a row each).

    ``documents``: the rows of the input with size, position and, as ``begin``, the place of
    their first word in their source's stream.  ``pieces``: for every slot the parts of
    documents in its block (position, begin, slot, pass, first_word, n_words).
    """

    sources: pd.DataFrame
    documents: DataFrame
    pieces: DataFrame


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function on unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of ``index`` under a pseudorandom permutation of range(n).

    A Feistel network over the next even number of bits; what falls outside is sent
    through again until it falls inside.
    """
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    low = np.uint64((1 << int(half)) - 1)
    out = index.astype(np.uint64)
    pending = np.arange(len(out))
    while len(pending):
        left, right = out[pending] >> half, out[pending] & low
        for turn in range(4):
            mixed = _mixed(right + np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 % 2**64))
            left, right = right, left ^ (mixed & low)
        out[pending] = left << half | right
        pending = pending[out[pending] >= n]
    return out.astype(np.int64)


def draw(slots: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Slots of each source in each shard (rows: shards); columns add up to ``slots``.

    Each shard's slots are a multinomial draw with the chances of what is left of each
    source; a source that runs out leaves its rest to the others.
    """
    left = np.asarray(slots, np.int64).copy()
    random, out = np.random.default_rng(seed), []
    for shard in range(shards):
        room, got = left.sum() // (shards - shard), np.zeros_like(left)
        while room:
            part = np.minimum(random.multinomial(room, left / left.sum()), left)
            got, left, room = got + part, left - part, room - part.sum()
        out.append(got)
    return np.asarray(out, np.int64).reshape(shards, len(left))


def _slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    drop_tools()
    for frame in frames:
        for row in frame.itertuples():
            for begin in range(row.first, row.first + row.number, 200_000):
                n = np.arange(begin, min(begin + 200_000, row.first + row.number))
                passes, block = n // row.blocks, np.empty(len(n), np.int64)
                for turn in np.unique(passes):
                    here = passes == turn
                    key = SEED + 1009 * row.position + int(turn)
                    block[here] = permuted(n[here] % row.blocks, row.blocks, key)
                yield pd.DataFrame(
                    {
                        "position": row.position,
                        "block": block,
                        "pass": passes.astype(np.int32),
                        "shard": np.int32(row.shard),
                        "slot": n,
                    }
                )
    drop_tools()


def mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    volume: float = VOLUME,
    most_passes: float = MOST_PASSES,
    block_words: int = BLOCK_WORDS,
    shards: int | None = None,
) -> Mix:
    """Plans the mix of all ``documents`` (doc_id, text, source).

    Sources stand in the order of their code points, null last, and their weights repeat.
    The list of sources passes through the driver: a mix is laid down source by source, so
    it is short.  Null and empty texts have size 0 and are never taken; rows that repeat an
    id, or all of a document, count each.  Every pass takes a block once, so nothing is
    taken more often than ``most_passes`` rounded up.  Unless given, ``shards`` grows with the
    slots, as a task makes a shard's.  Reruns agree, whatever the
    partitions: places come from hashes of ids and texts, draws from a fixed seed.
    """
    spark = documents.sparkSession
    sized = stored(
        documents.select(
            "doc_id",
            "source",
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
            n_words(F.col("text")).alias("size"),
        ),
        "sizes",
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda row: (row["source"] is None, (row["source"] or "").encode()))
    sizes = [row["size"] for row in found]
    sources = pd.DataFrame(
        {
            "source": [row["source"] for row in found],
            "position": np.arange(len(found)),
            "source_size": sizes,
            "target": targets(sizes, weights, volume, most_passes),
        }
    )
    blocks = -(-sources["source_size"].to_numpy(dtype=np.int64) // block_words)
    slots = np.round(
        sources["target"] * blocks / np.maximum(sources["source_size"], 1)
    ).to_numpy(dtype=np.int64)
    sources["blocks"] = blocks
    sources["slots"] = np.minimum(slots, blocks * int(-(-most_passes // 1)))
    listed = spark.createDataFrame(
        [(r["source"], i) for i, r in enumerate(found)], "source string, position long"
    )
    placed = running_start(
        sized.join(F.broadcast(listed), sized["source"].eqNullSafe(listed["source"]))
        .drop(listed["source"])
        .select("doc_id", "source", "position", "text_hash", "size"),
        "position",
        ["doc_id", "text_hash"],
        "size",
        "begin",
    )
    placed = stored(placed, "placed")
    if shards is None:
        shards = max(SHARDS, -(-int(sources["slots"].sum()) // SLOTS_PER_SHARD))
    drawn = draw(sources["slots"].tolist(), shards) if len(sources) else np.zeros((0, 0), np.int64)
    first = np.cumsum(drawn, axis=0) - drawn
    ranges = spark.createDataFrame(
        [
            (shard, i, int(first[shard, i]), int(drawn[shard, i]), int(blocks[i]))
            for shard in range(len(drawn))
            for i in range(len(sources))
            if drawn[shard, i]
        ],
        "shard int, position long, first long, number long, blocks long",
    ).repartition(len(drawn) or 1, "shard")
    slot_rows = ranges.mapInPandas(
        _slots, "position long, block long, pass int, shard int, slot long"
    )
    parts = (
        placed.where("size > 0")
        .withColumn(
            "block",
            F.explode(
                F.sequence(
                    F.expr(f"begin div {block_words}"),
                    F.expr(f"(begin + size - 1) div {block_words}"),
                )
            ),
        )
        .withColumn("from", F.greatest("begin", F.col("block") * block_words))
        .withColumn(
            "to", F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_words)
        )
        .select(
            "position",
            "block",
            "begin",
            (F.col("from") - F.col("begin")).alias("first_word"),
            (F.col("to") - F.col("from")).alias("n_words"),
        )
    )
    # Spark cannot see how many slots there will be: both sides are shuffled.
    return Mix(sources, placed, parts.hint("merge").join(slot_rows, ["position", "block"]))


def taken(planned: Mix) -> DataFrame:
    """All documents with size, source_size, target and the words that the mix takes."""
    spark = planned.documents.sparkSession
    sums = planned.pieces.groupBy(
        F.col("position").alias("_position"), F.col("begin").alias("_begin")
    ).agg(F.sum("n_words").alias("taken"))
    sources = spark.createDataFrame(
        [
            (int(r.position), int(r.source_size), float(r.target))
            for r in planned.sources.itertuples()
        ],
        "position long, source_size long, target double",
    )
    # A document without words begins where the next one does: it must not meet its words.
    whole = planned.documents.join(
        sums,
        (F.col("position") == F.col("_position"))
        & (F.col("begin") == F.col("_begin"))
        & (F.col("size") > 0),
        "left",
    )
    return whole.join(F.broadcast(sources), "position").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def mixed_documents(documents: DataFrame, planned: Mix) -> DataFrame:
    """The taken texts, with the columns of ``documents``: a row per document and pass.

    A document taken whole keeps its text; of one that only some blocks of were taken the
    words in them stay, parted by a line break where others are missing.  Nothing taken, no
    row.  n_chars, if there is one, is counted anew.  Rows that repeat id, source and text
    are taken together, with the other columns of one of them.
    """
    key = ["doc_id", "source", "text_hash"]
    takes = (
        planned.pieces.groupBy("position", "begin", "pass")
        .agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("spans"))
        .join(planned.documents.where("size > 0"), ["position", "begin"])
        .groupBy(key)
        .agg(F.first("size").alias("_size"), F.collect_list("spans").alias("_takes"))
        .select(*[F.col(c).alias(f"_{c}") for c in key], "_size", "_takes")
    )
    rows = documents.select(
        F.struct(*[documents[c] for c in documents.columns]).alias("row"),
        "doc_id",
        "source",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
    )
    if not planned.documents.groupBy(key).count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(key)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    taken_rows = rows.join(takes, same).withColumn("take", F.explode("_takes"))
    words = F.aggregate("take", F.lit(0).cast("long"), lambda total, x: total + x["n_words"])
    taken_rows = taken_rows.withColumn("_part", words != F.col("_size"))
    # Only what is cut goes to Python: there a text taken whole is a null.
    cut = [F.when(F.col("_part"), F.col(c)) for c in ("row.text", "take.first_word", "take.n_words")]
    cut = taken_rows.select(
        "row",
        F.when(F.col("_part"), _words_of(*cut)).otherwise(F.col("row.text")).alias("text"),
    )
    changed = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.length("text").cast(documents.schema["n_chars"].dataType)
    return cut.select(
        *[changed.get(c, F.col("row")[c]).alias(c) for c in documents.columns]
    )


@F.pandas_udf(StringType())
def _words_of(
    batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.Series]:
    drop_tools()
    for batch in batches:
        parts = [None if row[0] is None else excerpt(*row) for row in zip(*batch)]
        yield pd.Series(parts, dtype=object)
    drop_tools()  # a worker that gets no other task keeps nothing


def excerpt(text: str, first: Sequence[int], number: Sequence[int]) -> str:
    """The words from ``first`` on, ``number`` each, as they stand in the text."""
    spans = [m.span() for m in _WORD.finditer(text)]
    runs: list[list[int]] = []
    for begin, n in zip(first, number):
        if runs and runs[-1][1] == begin:
            runs[-1][1] += n
        else:
            runs.append([begin, begin + n])
    return "\n".join(text[spans[begin][0] : spans[end - 1][1]] for begin, end in runs)
