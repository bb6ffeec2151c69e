"""The reports' bands and segments as decision tables, and how many rows fall where no rule meant them to."""

from __future__ import annotations

from functools import reduce
from math import inf

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions import bands
from stallwise.functions.decisions import DecisionTable, Interval, Rule, exactly
from stallwise.functions.measures import cents
from stallwise.marketplace import Marketplace
from stallwise.operators.audit import rule_audit
from stallwise.plans.delivery import deliveries_of, lead_times

FREIGHT = DecisionTable(
    {"freight": Interval()},
    [
        Rule(bands.FREE, {"freight": exactly(0)}),
        *[Rule(name, {"freight": Interval(low, high)}) for name, low, high in bands.FREIGHT_BANDS],
        Rule(bands.TOP_FREIGHT_BAND, {"freight": Interval(80, inf, True)}),
    ],
)
LATENESS = DecisionTable(
    {"on_time": Interval(0, 1), "delay_days": Interval()},
    [
        Rule(bands.ON_TIME, {"on_time": exactly(1)}),
        Rule(bands.LATE_BANDS[0][0], {"delay_days": Interval(1, bands.LATE_BANDS[0][1])}),
        Rule(bands.LATE_BANDS[1][0], {"delay_days": Interval(bands.LATE_BANDS[0][1] + 1, bands.LATE_BANDS[1][1])}),
        Rule(bands.LATEST_BAND, {"delay_days": Interval(bands.LATE_BANDS[1][1] + 1)}),
    ],
    frozenset({"on_time", "delay_days"}),
)
_SCORE = Interval(1, 5)
# The segments' rules in order.
SEGMENTS = DecisionTable(
    {"r": _SCORE, "f": _SCORE, "m": _SCORE},
    [
        *[Rule(bands.CHAMPION, {"r": exactly(r), "f": exactly(f), "m": exactly(m)}) for r, f, m in bands.CHAMPION_SCORES],
        Rule("Loyal Customer", {"r": Interval(4, 5), "f": Interval(4, 5)}),
        Rule("Potential Loyalist", {"r": Interval(4, 5), "f": exactly(3)}),
        Rule("New Customer", {"r": exactly(5), "f": Interval(1, 2)}),
        Rule("Promising", {"r": Interval(3, 4), "f": Interval(1, 2)}),
        Rule("At Risk", {"r": Interval(1, 2), "f": Interval(4, 5)}),
        Rule("Needs Attention", {"r": Interval(1, 2), "f": Interval(2, 3)}),
        Rule("Lost", {"r": exactly(1), "f": exactly(1)}),
    ],
    frozenset("rfm"),
)


def _uncovered(name: str, table: DecisionTable, df: DataFrame, columns: dict) -> DataFrame:
    """Rows of ``df`` in each hole of a table, and those where a variable is NULL; one scan."""
    regions = {str(hole): hole.condition(columns) for hole in table.holes()}
    regions["NULL"] = reduce(lambda a, b: a | b, [column.isNull() for column in columns.values()])
    counted = rule_audit(df, {f"c{i}": condition for i, condition in enumerate(regions.values())})
    rows = [F.struct(F.lit(name).alias("decision"), F.lit(region).alias("region"), F.col(f"c{i}").alias("rows")) for i, region in enumerate(regions)]
    return counted.select(F.inline(F.array(*rows)))


def decision_coverage(m: Marketplace) -> DataFrame:
    """Rows that the freight and lateness bands meet with no rule of their own, by the hole that they fall in."""
    items = m.order_items.select(cents("freight_value").alias("freight"))
    # amounts are compared in whole cents
    freight = _uncovered("freight", FREIGHT, items, {"freight": F.col("freight") / 100})
    days = lead_times(deliveries_of(m))
    lateness = _uncovered("lateness", LATENESS, days, {"on_time": F.col("on_time"), "delay_days": F.col("delay_days")})
    return freight.unionByName(lateness)
