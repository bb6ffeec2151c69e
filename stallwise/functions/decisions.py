"""Decision tables: ordered rules over intervals, checked for holes, overlaps and dead rules, and compiled to a column.

A rule gives a label to a box, one interval for each variable that it tests; the first rule that fits decides. The
edges of all intervals cut each variable's domain into points and open stretches between them, on which
every rule either holds or does not; so trying each combination of these once proves what the table covers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from math import inf
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    """From ``low`` to ``high``; an end that is open does not belong to it. Infinite ends are open."""

    low: float = -inf
    high: float = inf
    low_open: bool = False
    high_open: bool = False

    def holds(self, value: float) -> bool:
        above = value > self.low if self.low_open else value >= self.low
        return above and (value < self.high if self.high_open else value <= self.high)

    def condition(self, column: Column) -> Column:
        parts = [column.isNotNull()]
        if self.low > -inf:
            parts.append(column > self.low if self.low_open else column >= self.low)
        if self.high < inf:
            parts.append(column < self.high if self.high_open else column <= self.high)
        return reduce(and_, parts)

    def __str__(self) -> str:
        if self.low == self.high:
            return f"{self.low:g}"
        left = "(" if self.low_open or self.low == -inf else "["
        right = ")" if self.high_open or self.high == inf else "]"
        return f"{left}{self.low:g}, {self.high:g}{right}"


def exactly(value: float) -> Interval:
    return Interval(value, value)


@dataclass(frozen=True)
class Rule:
    label: str
    box: Mapping[str, Interval]


@dataclass(frozen=True)
class Region:
    """A box of the domain, as found by the sweep."""

    box: Mapping[str, Interval]

    def condition(self, columns: Mapping[str, Column]) -> Column:
        return reduce(and_, [interval.condition(columns[name]) for name, interval in self.box.items()])

    def __str__(self) -> str:
        return " and ".join(f"{name} {interval}" for name, interval in self.box.items())


@dataclass(frozen=True)
class DecisionTable:
    """Ordered rules over variables; ``whole`` names the variables that hold whole numbers only."""

    domain: Mapping[str, Interval]
    rules: Sequence[Rule]
    whole: frozenset[str] = field(default_factory=frozenset)

    def _stretches(self, name: str) -> list[Interval]:
        """Points and open stretches that cover a variable's domain, in order."""
        domain = self.domain[name]
        edges = {e for rule in self.rules if name in rule.box for e in (rule.box[name].low, rule.box[name].high)}
        edges = sorted(e for e in edges | {domain.low, domain.high} if abs(e) < inf and domain.holds(e))
        if name in self.whole:
            # a rule holds alike on all whole numbers between two edges
            out = []
            for low, high in zip([domain.low, *edges], [*edges, domain.high]):
                first, last = low + 1 if low > -inf else low, high - 1 if high < inf else high
                if first <= last and low < high:
                    out.append(Interval(first, last))
                if high in edges and abs(high) < inf:
                    out.append(exactly(high))
            return sorted(set(out), key=lambda i: i.low)
        between = [Interval(a, b, True, True) for a, b in zip([domain.low, *edges], [*edges, domain.high]) if a < b]
        return sorted([*between, *map(exactly, edges)], key=lambda i: (i.low, i.low_open))

    @staticmethod
    def _inside(stretch: Interval) -> float:
        if stretch.low == -inf:
            return 0.0 if stretch.high == inf else stretch.high - 1 + (0 if stretch.high_open else 1)
        if stretch.high == inf:
            return stretch.low + (1 if stretch.low_open else 0)
        return (stretch.low + stretch.high) / 2 if stretch.low_open else stretch.low

    def _cells(self):
        names = list(self.domain)
        for stretches in product(*map(self._stretches, names)):
            at = {name: self._inside(stretch) for name, stretch in zip(names, stretches)}
            fits = [i for i, rule in enumerate(self.rules) if all(interval.holds(at[n]) for n, interval in rule.box.items())]
            yield dict(zip(names, stretches)), fits

    def holes(self) -> list[Region]:
        """What no rule covers, neighbouring cells joined."""
        return _joined([box for box, fits in self._cells() if not fits])

    def overlaps(self) -> list[tuple[Region, tuple[str, ...]]]:
        """Cells that rules of different labels cover, with the labels in order; the first one decides."""
        found = []
        for box, fits in self._cells():
            labels = tuple(dict.fromkeys(self.rules[i].label for i in fits))
            if len(labels) > 1:
                found.append((Region(box), labels))
        return found

    def unreachable(self) -> list[Rule]:
        """Rules that never decide."""
        first = {fits[0] for _, fits in self._cells() if fits}
        return [rule for i, rule in enumerate(self.rules) if i not in first]

    def compile(self, columns: Mapping[str, Column], otherwise: str) -> Column:
        """The label of the first rule that fits; a NULL fits no rule that tests it."""
        label = F
        for rule in self.rules:
            label = label.when(Region(rule.box).condition(columns), rule.label)
        return label.otherwise(otherwise)


def _joined(boxes: list[Mapping[str, Interval]]) -> list[Region]:
    """Boxes that touch along one variable and agree on all others, made one."""
    boxes = [dict(box) for box in boxes]
    joining = True
    while joining:
        joining = False
        for i, j in product(range(len(boxes)), repeat=2):
            if i == j:
                continue
            apart = [n for n in boxes[i] if boxes[i][n] != boxes[j][n]]
            if len(apart) == 1 and _touch(boxes[i][apart[0]], boxes[j][apart[0]]):
                a, b = boxes[i][apart[0]], boxes[j][apart[0]]
                boxes[i] = boxes[i] | {apart[0]: Interval(a.low, b.high, a.low_open, b.high_open)}
                del boxes[j]
                joining = True
                break
    return [Region(box) for box in boxes]


def _touch(a: Interval, b: Interval) -> bool:
    """``b`` begins where ``a`` ends, without a gap; whole numbers touch where they follow one another."""
    if a.high == b.low:
        return a.high_open != b.low_open
    return not a.high_open and not b.low_open and abs(a.high) < inf and b.low == a.high + 1 and float(a.high).is_integer()
