"""The order and payment reports as one rollup: one fold of orders, one of payments, one join.

The rollup has a row for each group of each report, with sums that add up over orders. An order stands in it
once for its month, day of the week, hour and state, and, beside each of its payment types and credit card
installments, once as itself. Both sides of the join are folded by order and group first, so no copy of an
order meets a copy of a payment, a hot order is one row per task, and joined rows count distinct orders.

Since its sums add up over orders, a stored rollup follows late changes: see :mod:`stallwise.plans.report_state`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions import calendar
from stallwise.functions.measures import cents, count_rows, flag
from stallwise.marketplace import Marketplace
from stallwise.plans import revenue
from stallwise.plans.revenue import CREDIT_CARD, PURCHASE, defined_payments, delivered, delivered_with_customer

# Groups of the rollup: by a number (a month as 100 * year + month) or by a name.
MONTH, DAY, HOUR, STATE, TYPE, INSTALLMENTS = "month", "day_of_week", "hour_of_day", "state", "payment_type", "installments"
SUMS = ("total_orders", "amount", "payment_rows")

_ITSELF = "order"  # stands in the join for an order beside the groups of its payments


def _group(rollup: str, number: Column | None = None, name: Column | None = None) -> Column:
    number = F.lit(None) if number is None else number
    name = F.lit(None) if name is None else name
    return F.struct(F.lit(rollup).alias("rollup"), number.cast("bigint").alias("number"), name.cast("string").alias("name"))


def _order_groups(m: Marketplace) -> DataFrame:
    """(order_id, whole, group, copies) of delivered orders; ``whole`` groups take all payments of an order."""
    month = F.year(PURCHASE) * 100 + F.month(PURCHASE)
    own = F.array(
        F.struct(F.lit(True).alias("whole"), _group(MONTH, month).alias("group")),
        F.struct(F.lit(True).alias("whole"), _group(DAY, calendar.day_number(PURCHASE)).alias("group")),
        F.struct(F.lit(True).alias("whole"), _group(HOUR, calendar.hour(PURCHASE)).alias("group")),
        F.struct(F.lit(False).alias("whole"), _group(_ITSELF).alias("group")),
    )
    orders = delivered(m.orders).select("order_id", F.inline(own)).withColumn("copies", F.lit(1).cast("bigint"))
    placed = delivered_with_customer(m, "customer_state")
    state = placed.select("order_id", F.lit(True).alias("whole"), _group(STATE, name=F.col("customer_state")).alias("group"), "copies")
    both = orders.unionByName(state)
    return both.groupBy("order_id", "whole", "group").agg(F.sum("copies").alias("copies"))


def _payment_groups(m: Marketplace) -> DataFrame:
    """(order_id, whole, group, paid, payments): payments of a known type by order, and by order and group."""
    card = F.when(F.col("payment_type") == CREDIT_CARD, F.lit(True))
    groups = F.array(
        F.struct(F.lit(True).alias("whole"), _group(_ITSELF).alias("group")),
        F.struct(F.lit(False).alias("whole"), _group(TYPE, name=F.col("payment_type")).alias("group")),
        F.when(card, F.struct(F.lit(False).alias("whole"), _group(INSTALLMENTS, F.col("payment_installments")).alias("group"))),
    )
    each = defined_payments(m.order_payments).select("order_id", cents("payment_value").alias("paid"), F.explode(groups).alias("of"))
    each = each.filter(F.col("of").isNotNull()).select("order_id", "of.whole", "of.group", "paid")
    paid = F.col("paid")
    return each.groupBy("order_id", "whole", "group").agg(F.sum(paid).alias("paid"), F.sum(flag(paid.isNotNull())).cast("bigint").alias("payments"))


def order_rollup(m: Marketplace) -> DataFrame:
    """``rollup, number, name`` and the sums ``total_orders, amount, payment_rows`` of every group."""

    def build() -> DataFrame:
        orders = _order_groups(m)
        payments = _payment_groups(m).withColumnRenamed("group", "paid_group")
        joined = orders.join(payments, ["order_id", "whole"])
        group = F.when(F.col("whole"), F.col("group")).otherwise(F.col("paid_group"))
        return joined.select(group.alias("group"), "copies", "paid", "payments").groupBy("group").agg(
            count_rows().alias("total_orders"),
            F.sum(F.col("paid") * F.col("copies")).alias("amount"),
            F.sum(F.col("payments") * F.col("copies")).alias("payment_rows"),
        ).select("group.*", *SUMS)

    return m.shared("order rollup", build)


def part_of(rollup: DataFrame, name: str, *names: str) -> DataFrame:
    """One rollup's groups and sums, its number or name (or both parts of its month) under the given names."""
    rows = rollup.filter(F.col("rollup") == name)
    if len(names) == 2:
        year, month = F.expr("number div 100"), F.pmod(F.col("number"), F.lit(100)).cast("bigint")
        return rows.select(year.alias(names[0]), month.alias(names[1]), *SUMS)
    return rows.select(F.col("name" if name in (STATE, TYPE) else "number").alias(names[0]), *SUMS)


def months_of(rollup: DataFrame) -> DataFrame:
    return part_of(rollup, MONTH, "order_year", "order_month")


# Reports that a rollup answers, by the name of the report that computes the same on its own.
FROM_ROLLUP: dict[str, Callable[[DataFrame], DataFrame]] = {
    "monthly_gmv": lambda rollup: revenue.gmv_report(months_of(rollup)),
    "mom_growth": lambda rollup: revenue.growth_report(months_of(rollup)),
    "mom_growth_by_calendar": lambda rollup: revenue.growth_report(months_of(rollup), by_calendar=True),
    "payment_type_revenue": lambda rollup: revenue.payment_type_report(part_of(rollup, TYPE, "payment_type")),
    "installment_profile": lambda rollup: revenue.installment_report(part_of(rollup, INSTALLMENTS, "payment_installments")),
    "installment_profile_per_order": lambda rollup: revenue.installment_report(
        part_of(rollup, INSTALLMENTS, "payment_installments"), per_order=True
    ),
    "state_revenue": lambda rollup: revenue.state_report(part_of(rollup, STATE, "customer_state")),
    "state_revenue_per_order": lambda rollup: revenue.state_report(part_of(rollup, STATE, "customer_state"), per_order=True),
    "day_of_week_profile": lambda rollup: revenue.day_report(part_of(rollup, DAY, "day_number")),
    "hour_of_day_profile": lambda rollup: revenue.hour_report(part_of(rollup, HOUR, "hour_of_day")),
}
