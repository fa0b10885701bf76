"""Exact NTILE over a whole table, without sorting it or gathering it in one task.

``NTILE(k) OVER (ORDER BY value, id)`` has no PARTITION BY, so Spark's window
would move every row into a single task.  But a row's tile only depends on which
of the k-1 rows that close a tile lie before it.  Those few rows are order
statistics, found here by narrowing a bracket around each of them:

1. a sample of a fixed number of keys suggests a narrower bracket,
2. one aggregate counts exactly how many rows lie up to each suggested end,
   which tells for certain which part holds the wanted rank,
3. once few enough rows are left inside, they are fetched and the rank read off.

Each step is a plain scan, for all measures at once, with map-side aggregation:
nothing is shuffled but counters, ties cannot make a hot task, and a bad sample
costs a further round but never a wrong answer.  What reaches the driver is
bounded by the two constants below whatever the size of the table.  Scoring then
compares each row with k-1 constants, which Spark fuses into the stage that reads
the table.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Effort:
    """What the search for tile ends may spend; the tiles are the same whatever it is.

    A round is two scans of the measures and divides what is left in the brackets by about
    sqrt(sample_keys) / 4, so four rounds suffice for 10^9 rows.  Beyond ``max_rounds`` the
    search gives up with an error: only rows of equal keys never part.
    """

    #: Keys sampled for each bracket and round; all of a round reach the driver.
    sample_keys: int = 10_000
    #: Keys left in a measure's brackets that are fetched to end the search.
    fetch_keys: int = 50_000
    max_rounds: int = 100


Key = tuple[Any, Any]  # (value, id)


@dataclass(frozen=True)
class _Bracket:
    """The row of 1-based ``rank`` has a key in (low, high]; None is unbounded."""

    rank: int
    low: Key | None
    high: Key | None
    below: int  # rows with a key up to low
    inside: int  # rows with a key in (low, high]

    @property
    def span(self) -> tuple[Key | None, Key | None]:
        return self.low, self.high

    def slice(self, keys: list[Key]) -> list[Key]:
        start = 0 if self.low is None else bisect_right(keys, self.low)
        stop = len(keys) if self.high is None else bisect_right(keys, self.high)
        return keys[start:stop]

    def suggest(self, sample: list[Key]) -> list[Key]:
        """Sampled keys a few standard errors to either side of the wanted rank."""
        size = len(sample)
        if not size:
            return []
        upto_rank = (self.rank - self.below) / self.inside * size  # expected sampled keys
        margin = min(2 * size**0.5 + 1, size / 4)
        low, high = int(upto_rank - margin) - 1, int(upto_rank + margin)
        return [sample[max(0, low)], sample[min(size - 1, high)]]

    def narrow(self, counts: dict[Key, int]) -> _Bracket:
        """The smallest bracket that the counted keys prove to hold the rank."""
        best = self
        for key, up_to in counts.items():
            if best.below < up_to < self.rank:
                best = replace(
                    best, low=key, below=up_to, inside=best.inside - (up_to - best.below)
                )
            elif self.rank <= up_to < best.below + best.inside:
                best = replace(best, high=key, inside=up_to - best.below)
        return best


@dataclass
class _Search:
    """The brackets around all tile ends of one measure."""

    value: Column
    ident: Column
    brackets: list[_Bracket]

    @property
    def spans(self) -> dict[tuple[Key | None, Key | None], int]:
        return {b.span: b.inside for b in self.brackets}

    @property
    def left(self) -> int:
        return sum(self.spans.values())

    def up_to(self, key: Key) -> Column:
        value, ident = map(F.lit, key)
        return (self.value < value) | ((self.value == value) & (self.ident <= ident))

    def inside(self) -> Column:
        def one(low: Key | None, high: Key | None) -> Column:
            above = F.lit(True) if low is None else ~self.up_to(low)
            return above if high is None else above & self.up_to(high)

        return reduce(or_, (one(*span) for span in self.spans))

    def narrow(self, counts: dict[Key, int]) -> None:
        self.brackets = [b.narrow(counts) for b in self.brackets]

    def found(self, keys: list[Key]) -> list[Key]:
        """The keys at the wanted ranks, given all keys inside the brackets."""
        ends = []
        for bracket in self.brackets:
            candidates = bracket.slice(keys)
            if len(candidates) != bracket.inside:
                raise RuntimeError("the table changed between two reads; pass a stored table")
            ends.append(candidates[bracket.rank - bracket.below - 1])
        return ends

    def tile(self, ends: list[Key]) -> Column:
        first = F.lit(1).cast("bigint")
        return sum(((~self.up_to(key)).cast("bigint") for key in ends), start=first)


def exact_ntiles(
    df: DataFrame,
    measures: dict[str, Column],
    id_column: str,
    tiles: int = 5,
    effort: Effort = Effort(),
) -> DataFrame:
    """Add one BIGINT tile number, 1 to ``tiles``, per entry of ``measures``.

    Rows are ordered by (measure, id_column), both ascending and never NULL, and
    ``id_column`` must be unique.  ``df`` is read several times: pass a stored table.
    """
    ident = F.col(id_column)
    total = _row_count(df, [ident, *measures.values()])
    ranks = _tile_ends(total, tiles)
    searches = [
        _Search(measure, ident, [_Bracket(rank, None, None, 0, total) for rank in ranks])
        for measure in measures.values()
    ]
    ends = _close_in(df, searches, effort) if ranks else [[] for _ in searches]
    return df.withColumns(
        {name: search.tile(keys) for name, search, keys in zip(measures, searches, ends)}
    )


def _tile_ends(total: int, tiles: int) -> list[int]:
    """Rank of the last row of each tile but the last: the first tiles are the larger ones."""
    small, larger = divmod(total, tiles)
    ends = (small * tile + min(tile, larger) for tile in range(1, tiles))
    return sorted({end for end in ends if 0 < end < total})


def _row_count(df: DataFrame, columns: list[Column]) -> int:
    complete = reduce(and_, (column.isNotNull() for column in columns))
    total, usable = df.agg(F.count(F.lit(1)), F.count_if(complete)).first()
    if usable != total:
        raise ValueError(f"{total - usable} rows have a NULL measure or id")
    return total


def _close_in(df: DataFrame, searches: list[_Search], effort: Effort) -> list[list[Key]]:
    """The keys at the ranks that each search is after."""

    def fetch(wanted: list[_Search], fraction: float | None = None, seed: int = 0):
        rows = df.where(reduce(or_, (search.inside() for search in wanted)))
        if fraction is not None:
            rows = rows.sample(fraction=fraction, seed=seed)
        rows = rows.select(wanted[0].ident, *(search.value for search in wanted)).collect()
        return [sorted((row[i], row[0]) for row in rows) for i, _ in enumerate(wanted, start=1)]

    for turn in range(effort.max_rounds):
        wide = [s for s in searches if s.left > effort.fetch_keys + len(s.brackets)]
        if not wide:
            return [s.found(keys) for s, keys in zip(searches, fetch(searches))]
        spans = sum(len(search.spans) for search in wide)
        share = effort.sample_keys * spans / sum(search.left for search in wide)
        cuts = [
            sorted({key for b in search.brackets for key in b.suggest(b.slice(sample))})
            for search, sample in zip(wide, fetch(wide, min(1.0, share), seed=turn))
        ]
        tests = [search.up_to(key) for search, keys in zip(wide, cuts) for key in keys]
        if tests:
            counts = iter(df.agg(*map(F.count_if, tests)).first())
            for search, keys in zip(wide, cuts):
                search.narrow(dict(zip(keys, counts)))
    raise ValueError("too many rows share one key; the id column must be unique")
