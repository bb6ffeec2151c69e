"""Exact NTILE over a whole table, without sorting or exchanging its rows.

A tile number depends only on which rows start tiles 2 to k. Those k-1 boundary
rows are found by narrowing an interval around each: a hashed sample of the ranks
proposes points, and one counting pass over the table says exactly how many rows
come before each. The keys inside the intervals are then stored, and all further
rounds read those alone, so the table itself is passed three times at any size:
sampled, counted, and cut to the intervals (some 2.3 % of the rows each, three
standard deviations of the sample's rank error to both sides). An interval no
larger than the sample is drawn whole; there the boundary is the row at its rank.
All orderings share every pass. The sample only steers the search; counts decide,
so the tiles equal those of ``ntile(k)``.

The driver sees a bounded number of sort keys and the executors see filters,
counts and finally a comparison with k-1 literals per ordering.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor, sqrt
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwise.session import materialise

FIRST_ROWS = 16384  # of the first sample: it sets what is stored
SAMPLE_ROWS = 4096
MOST_ROWS = 16 * SAMPLE_ROWS  # of a sample, however many rounds move nothing
_HASH_SPAN = 1 << 30


@dataclass(frozen=True)
class SortKey:
    """A sort column. NULL is the lowest value: first ascending, last descending.

    Descending columns are numeric, as they are compared by their negative.
    """

    name: str
    ascending: bool = True

    def fields(self) -> list[Column]:
        column = F.col(self.name)
        if self.ascending:
            return [column.alias(self.name)]
        return [column.isNull().alias(f"{self.name}_last"), (-column).alias(self.name)]


def position(keys: Sequence[SortKey]) -> Column:
    """The sort keys as one struct; structs compare field by field, NULL lowest."""
    return F.struct(*[field for key in keys for field in key.fields()])


class _Search:
    """Interval [low, high) known to hold the row of one rank in one ordering."""

    def __init__(self, name: str, kind: T.StructType, rank: int, rows: int):
        self.name, self.rank = name, rank
        self._kind = kind
        self.low: Row | None = None
        self.high: Row | None = None
        self.below, self.size = 0, rows
        self.found: Row | None = None
        self._stored = F.lit(True)
        self._skipped = 0
        self._before: dict[Row, Column] = {}

    def before(self, point: Row) -> Column:
        """Condition: the row comes strictly before the point."""
        if point not in self._before:
            literals = [F.lit(value).cast(f.dataType).alias(f.name) for f, value in zip(self._kind, point)]
            self._before[point] = F.col(self.name) < F.struct(*literals)
        return self._before[point]

    def at(self, point: Row) -> Column:
        """Condition: the row is at the point."""
        literals = [F.lit(value).cast(f.dataType).alias(f.name) for f, value in zip(self._kind, point)]
        return F.col(self.name) == F.struct(*literals)

    def inside(self) -> Column:
        condition = F.lit(True) if self.high is None else self.before(self.high)
        return condition if self.low is None else condition & ~self.before(self.low)

    def keep_inside(self) -> None:
        """From here on, counts see the rows of the present interval only."""
        self._stored, self._skipped = self.inside(), self.below

    def counts(self, point: Row) -> tuple[Column, Column]:
        """Aggregates for :meth:`narrow`: the rows before the point, and those at it."""
        before = F.count(F.when(self._stored & self.before(point), 1)) + self._skipped
        return before, F.count(F.when(self.at(point), 1))

    def pick(self, points: list[Row]) -> None:
        """The boundary, where the points are all rows of the interval."""
        if len(points) != self.size:
            raise RuntimeError(f"the table changed while {self.name} was searched")
        at = self.rank - self.below - 1
        if points[at] in points[max(at - 1, 0) : at] + points[at + 1 : at + 2]:
            raise ValueError(f"sort keys of {self.name} do not tell rows apart; add a tie key")
        self.found = points[at]

    def propose(self, points: list[Row]) -> list[Row]:
        """Points of a sample: the likely boundary, and two that should enclose it.

        The middle one makes every round shrink the interval, also where it is so
        small that the others fall outside.
        """
        share = (self.rank - self.below - 0.5) / self.size
        middle, margin = share * len(points), 3 * sqrt(len(points) * share * (1 - share)) + 1
        places = floor(middle - margin), floor(middle), ceil(middle + margin)
        return [points[i] for i in places if 0 <= i < len(points)]

    def narrow(self, point: Row, rows_before: int, rows_equal: int) -> None:
        """Use the exact number of table rows before, and equal to, a point of the interval."""
        top = self.below + self.size
        if not self.below <= rows_before <= top:
            return
        if rows_before == self.rank - 1:
            if rows_equal != 1:
                raise ValueError(f"sort keys of {self.name} do not tell rows apart; add a tie key")
            self.found = point
        elif rows_before < self.rank:
            self.low, self.below, self.size = point, rows_before, top - rows_before
        else:
            self.high, self.size = point, rows_before - self.below


def tile_starts(rows: int, tiles: int) -> list[int]:
    """Rank of the first row of tiles 2 to ``tiles``, as far as rows reach."""
    size, larger = divmod(rows, tiles)
    starts = [t * size + min(t, larger) + 1 for t in range(1, tiles)]
    return [s for s in starts if s <= rows]


def with_tiles(df: DataFrame, tiles: int, orderings: Mapping[str, Sequence[SortKey]]) -> DataFrame:
    """Add one tile column per ordering, numbered from 1.

    ``df`` is read several times and should be a stored table. The keys of each
    ordering must identify a row; the search stops with an error where they do not.
    """
    rows = df.count()
    positions = df.select(*[position(keys).alias(name) for name, keys in orderings.items()])
    searches = {
        name: [_Search(name, positions.schema[name].dataType, rank, rows) for rank in tile_starts(rows, tiles)]
        for name in orderings
    }
    _resolve(positions, [s for group in searches.values() for s in group])
    placed = df.withColumns({name: position(keys) for name, keys in orderings.items()})
    return placed.withColumns({name: _tile(group) for name, group in searches.items()})


def _tile(searches: list[_Search]) -> Column:
    tile = F.lit(len(searches) + 1)
    for number in range(len(searches), 0, -1):
        search = searches[number - 1]
        tile = F.when(search.before(search.found), number).otherwise(tile)
    return tile.cast("bigint")


def _resolve(positions: DataFrame, searches: list[_Search]) -> int:
    """Narrow all intervals to their boundary rows; gives the number of rounds.

    A round that moves nothing has had an unlucky sample and is repeated with twice as large a one, up to
    ``MOST_ROWS``; from there on Spark looks for equal keys, the other cause.
    """
    rounds, target, stored = 0, FIRST_ROWS, False
    while left := [s for s in searches if s.found is None]:
        sizes = [s.size for s in left]
        _narrow(positions, left, rounds, target)
        rounds += 1
        left = [s for s in left if s.found is None]
        if [s.size for s in left] == sizes:
            if target >= MOST_ROWS:
                _refuse_equal_keys(positions, left)
            target = min(2 * target, MOST_ROWS)
        else:
            target = SAMPLE_ROWS
            if not stored and left and max(s.size for s in left) > target:
                positions = materialise(positions.filter(reduce(or_, [s.inside() for s in left])))
                for search in left:
                    search.keep_inside()
                stored = True
    return rounds


def _refuse_equal_keys(positions: DataFrame, searches: list[_Search]) -> None:
    for search in searches:
        equal = positions.filter(search.inside()).groupBy(search.name).count().filter("count > 1")
        if not equal.isEmpty():
            raise ValueError(f"sort keys of {search.name} do not tell rows apart; add a tie key")


def _narrow(positions: DataFrame, searches: list[_Search], turn: int, target: int) -> None:
    """Sample the intervals, then count the rows before each proposed point.

    The largest interval sets the sampling rate, which bounds the sample. Intervals drawn whole need no count.
    """
    rate = min(1.0, target / max(s.size for s in searches))
    draw = F.pmod(F.xxhash64(positions.columns[0], F.lit(turn)), F.lit(_HASH_SPAN))
    sample = positions if rate == 1.0 else positions.filter(draw < ceil(_HASH_SPAN * rate))
    points = _collect(sample, searches)
    if rate == 1.0:
        for search, rows in zip(searches, points):
            search.pick(rows)
        return
    proposals = [(search, point) for search, rows in zip(searches, points) for point in search.propose(rows)]
    if not proposals:
        return
    counted = [search.counts(point) for search, point in proposals]
    counts = positions.agg(*[before for before, _ in counted], *[equal for _, equal in counted]).first()
    for (search, point), rows_before, rows_equal in zip(proposals, counts, counts[len(proposals) :]):
        if search.found is None:
            search.narrow(point, rows_before, rows_equal)


def _collect(positions: DataFrame, searches: list[_Search]) -> list[list[Row]]:
    """Sorted points inside each search's interval, fetched in one pass."""
    inside = [s.inside() for s in searches]
    marks = F.array(*inside).alias("marks")
    rows = positions.filter(reduce(or_, inside)).select("*", marks).collect()
    points: list[list[Row]] = [[] for _ in searches]
    for row in rows:
        for i, mark in enumerate(row["marks"]):
            if mark:
                points[i].append(row[searches[i].name])
    return [sorted(group, key=_null_lowest) for group in points]


def _null_lowest(point: Row) -> tuple[tuple[bool, Any], ...]:
    return tuple((value is not None, value) for value in point)
