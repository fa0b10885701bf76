"""Best-fit packing of documents into sequences by minimum bin slack.

For each sequence a subset-sum over the lengths still available, held as the bits of one
integer, finds the fullest feasible combination around the longest piece left; it is then
removed.  Only lengths matter for that, so the plan is made on the histogram of lengths
(at most ``capacity`` counters, however many pieces there are): a combination is taken as
often as the counts allow, in one step.  Pieces are then dealt to the planned places by
their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import CHARS_AT_A_TIME, running_start, stored
from salesmart.llm.tokens import encoder, in_portions

END_ID = 0
CAPACITY = 2048

PIECES = "doc_id {id}, row long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces: (length, first_rank, number, first_sequence, offset) each.

    The pieces of ``length`` with ranks from ``first_rank`` on go to the sequences from
    ``first_sequence`` on, one each, at ``offset``.
    """
    left = {n: c for n, c in sorted(counts.items()) if c > 0}
    rank = dict.fromkeys(left, 0)
    places, sequence = [], 0
    while left:
        longest = max(left)
        combination = {longest: 1}
        for n in _fullest(left, longest, capacity - longest):
            combination[n] = combination.get(n, 0) + 1
        times = min(left[n] // used for n, used in combination.items())
        offset = 0
        for n in sorted(combination, reverse=True):
            for _ in range(combination[n]):
                places.append((n, rank[n], times, sequence, offset))
                rank[n] += times
                offset += n
            left[n] -= times * combination[n]
            if not left[n]:
                del left[n]
        sequence += times
    return places


def _fullest(left: dict[int, int], taken: int, room: int) -> list[int]:
    """Lengths from ``left``, without one of ``taken``, whose sum is the most ``room`` holds.

    Bit s of ``sums[i]`` says whether s is a sum of the first i lengths.  Long lengths come
    last, so that reading the way back takes them first and keeps short ones for later.
    """
    lengths, sums, mask = [], [1], (1 << (room + 1)) - 1
    for n in left:
        if n > room:
            break
        copies = min(left[n] - (n == taken), room // n)
        if copies <= 0:
            continue
        reach, step = sums[-1], 1
        while copies:  # binary splitting: log(copies) shifts
            step = min(step, copies)
            lengths.append((n, step))
            reach |= (reach << (n * step)) & mask
            sums.append(reach)
            copies -= step
            step *= 2
        if reach == mask and len(sums) > 64:
            break
    target, chosen = sums[-1].bit_length() - 1, []
    for i in range(len(lengths) - 1, -1, -1):
        n, step = lengths[i]
        if n * step <= target and sums[i] >> (target - n * step) & 1:
            chosen += [n] * step
            target -= n * step
    return chosen


def _pieces(tokenizer: str, capacity: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, rows = frame["doc_id"].tolist(), frame["row"].tolist()
            for begin, texts in in_portions(frame["text"].tolist(), CHARS_AT_A_TIME):
                out = []
                for i, tokens in enumerate(encoder(tokenizer).encode_all(texts), begin):
                    tokens = np.append(tokens, np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(tokens), capacity)):
                        part = tokens[start : start + capacity]
                        out.append(
                            (ids[i], rows[i], piece, start, len(part), zlib.crc32(part.tobytes()))
                        )
                yield pd.DataFrame(
                    out, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32"]
                )

    return cut


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: its document's id and a hash of its text, place, length, crc32."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select(
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"),
        F.col("text").cast("binary").alias("text"),
    ).mapInPandas(_pieces(tokenizer, capacity), PIECES.format(id=kind))


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents; one row per piece with its ``sequence_id`` and ``offset``.

    A document is its ids and then id 0, so a null or empty text is one id long.  Documents
    longer than ``capacity`` are cut into pieces of it; only the last may be shorter.  Rows
    that repeat an id, or all of a document, are packed like any other; so is a null id.
    An empty table gives an empty result; columns beside doc_id and text are not read.
    """
    spark = documents.sparkSession
    cut = stored(pieces(documents, tokenizer, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    spots = spark.createDataFrame(  # at most a few rows for each length up to the capacity
        pd.DataFrame(
            plan(counts, capacity),
            columns=["length", "first_rank", "number", "first_sequence", "offset"],
        ).astype("int64"),
        "length long, first_rank long, number long, first_sequence long, offset long",
    )
    return deal(cut, spots)


def deal(cut: DataFrame, spots: DataFrame) -> DataFrame:
    """Gives each piece, by its rank among those of its length, its planned place.

    Ranks and planned ranks are both cut into ranges of equal width, so the join is on
    (length, range): a length that most pieces have is spread like all others.
    """
    width = 4096
    ranked = running_start(
        cut.withColumn("_one", F.lit(1).cast("long")),
        "length",
        ["doc_id", "row", "piece", "ids_crc32"],
        "_one",
        "rank",
    ).withColumn("_range", F.expr(f"rank div {width}"))
    ranges = spots.withColumn(
        "_range",
        F.explode(
            F.sequence(
                F.expr(f"first_rank div {width}"),
                F.expr(f"(first_rank + number - 1) div {width}"),
            )
        ),
    )
    return (
        ranked.hint("merge")
        .join(ranges, ["length", "_range"])
        .where("rank >= first_rank AND rank < first_rank + number")
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
            "offset",
        )
    )
