"""Distinct orders and persons of any period from stored sketches, as an opt-in beside the exact counts.

Distinct counts do not add up over days, so an exact count of a new period reads all its orders again. A sketch per day and state
(HyperLogLog, 2^``PRECISION`` registers) is a few kilobytes at most and merges: the sketches of any days and states give
the count of their union, within ``BOUND`` of the exact one for three in a thousand periods or fewer. Exact stays the default everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.calendar import month, year
from stallwise.marketplace import Marketplace
from stallwise.plans.revenue import PURCHASE, delivered
from stallwise.session import materialise

PRECISION = 14
BOUND = 3 * 1.04 / 2 ** (PRECISION / 2)  # three standard errors

_ROWS = ("order_id", "customer_unique_id")


def _orders(m: Marketplace) -> DataFrame:
    persons = m.customers.select("customer_id", "customer_unique_id", "customer_state").distinct()
    return delivered(m.orders).select("order_id", "customer_id", PURCHASE).join(persons, "customer_id")


def daily_sketches(m: Marketplace) -> DataFrame:
    """``day, customer_state`` with a sketch of the delivered orders and of the persons; to be stored."""
    sketch = lambda name, alias: F.hll_sketch_agg(F.col(name).cast("string"), PRECISION).alias(alias)
    day = F.to_date(PURCHASE).alias("day")
    return _orders(m).groupBy(day, "customer_state").agg(sketch("order_id", "orders"), sketch("customer_unique_id", "persons"))


def approximate_counts(sketches: DataFrame, *period: Column) -> DataFrame:
    """Distinct orders and persons by any grouping of days and states."""
    estimate = lambda name: F.hll_sketch_estimate(F.hll_union_agg(name)).alias(f"{name}_estimate")
    return sketches.groupBy(*period).agg(estimate("orders"), estimate("persons"))


def distinct_by_month(m: Marketplace) -> DataFrame:
    """Exact distinct orders and persons per month and state, and whether the estimates from stored daily sketches are within the bound."""
    by = [year("day").alias("order_year"), month("day").alias("order_month"), F.col("customer_state")]
    names = ["order_year", "order_month", "customer_state"]
    estimates = approximate_counts(materialise(daily_sketches(m)), *by)
    rows = _orders(m).withColumn("day", F.to_date(PURCHASE)).select(*by, *_ROWS)
    exact = rows.groupBy(*names).agg(F.countDistinct("order_id").alias("orders"), F.countDistinct("customer_unique_id").alias("persons"))
    same = [F.col(f"e.{n}").eqNullSafe(F.col(f"x.{n}")) for n in names]
    joined = exact.alias("x").join(estimates.alias("e"), same[0] & same[1] & same[2], "left")
    return joined.select(*[F.col(f"x.{n}").alias(n) for n in [*names, "orders", "persons"]], *[_within(n).alias(f"{n}_within_bound") for n in ("orders", "persons")])


def _within(name: str) -> Column:
    """The estimate is off by no more than the bound, or than one."""
    exact, estimate = F.col(f"x.{name}"), F.col(f"e.{name}_estimate")
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), F.ceil(exact * BOUND).cast("double"))
