"""Stored partial sums of the reports that follow late changes of orders.

The reports on revenue and delivery are sums over orders, put into groups, and a last step on the few groups. So the
sums can be stored, and a change of some orders is the sums of these orders as they are now less those as they
were: signed deltas, added to the stored sums. Inserting, changing and deleting orders is all the same, and costs the size
of the change, not of the tables. A group whose last order goes away goes too.

The state is one table behind a commit log, so a change is in it in whole or not at all, and two writers of
changes cannot lose one another's: an update starts again from what the other has written. All sums are whole
numbers, so after any changes the state equals that of a full run, exactly.

A change is given as two marketplaces, before and after, which hold all rows of the changed orders (and their
customers, products and translations); :func:`restrict` takes them from whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.marketplace import Marketplace
from stallwise.plans import delivery, revenue, rollup
from stallwise.session import keep_until_end, materialise, scratch_root
from stallwise.sources.versions import VersionLog

ORDER_TABLES = ("orders", "order_items", "order_payments", "order_reviews")
_PLACES = 5  # sums beside the number of orders
_SUMS = ["total_orders", *[f"s{i}" for i in range(_PLACES)]]
_KPIS = ("rows", "estimated_days", "actual_days", "delay_days", "on_time")


@dataclass(frozen=True)
class Part:
    """The sums of one report: how they are formed, the group column (or year and month), and the
    last step. ``of`` names sums that are NULL where their count is 0."""

    sums: Callable[[Marketplace], DataFrame]
    group: tuple[str, ...]
    measures: tuple[str, ...]
    finish: Callable[[DataFrame], DataFrame]
    by_name: bool = False
    of: tuple[tuple[str, str], ...] = ()


PARTS: dict[str, Part] = {
    "category_revenue": Part(
        revenue.category_amounts, ("category",), ("amount", "priced_items"), revenue.category_report, True, (("amount", "priced_items"),)
    ),
    "delivery_overall": Part(
        lambda m: delivery.delivery_kpis(delivery.lead_times(delivery.deliveries_of(m)), unique=m.is_unique("orders")),
        (),
        _KPIS,
        delivery.overall_report,
    ),
    "delivery_by_state": Part(delivery.state_kpis, ("customer_state",), _KPIS, delivery.state_report, True),
    "monthly_on_time": Part(delivery.month_kpis, ("order_year", "order_month"), _KPIS, delivery.month_report),
    "punctuality_vs_review": Part(
        delivery.review_sums, ("delivery_status",), ("copies", "score", "scored", "positive", "negative"), delivery.review_report, True
    ),
    "freight_vs_speed": Part(
        delivery.freight_sums,
        ("band",),
        ("freight", "charged", "rows", "days", "on_time"),
        lambda sums: delivery.freight_report(sums.withColumn("band", F.col("band").cast("int"))),
    ),
}
REPORTS = (*rollup.FROM_ROLLUP, *PARTS)


def _stored(name: str, part: Part, sums: DataFrame) -> DataFrame:
    """A part's sums as rows of the state."""
    group = part.group
    if len(group) == 2:
        number, label = F.col(group[0]) * 100 + F.col(group[1]), F.lit(None)
    else:
        number, label = [F.lit(None) if not group or part.by_name == numeric else F.col(group[0]) for numeric in (True, False)]
    values = [F.col(measure) for measure in part.measures] + [F.lit(0)] * (_PLACES - len(part.measures))
    return sums.select(
        F.lit(name).alias("rollup"),
        number.cast("bigint").alias("number"),
        label.cast("string").alias("name"),
        F.col("total_orders"),
        *[F.coalesce(value.cast("bigint"), F.lit(0)).alias(f"s{i}") for i, value in enumerate(values)],
    )


def _read(state: DataFrame, name: str, part: Part) -> DataFrame:
    """A part's sums again, from the state."""
    rows = state.filter(F.col("rollup") == name)
    values = [F.col(f"s{i}").alias(measure) for i, measure in enumerate(part.measures)]
    if not part.group:  # one row, also of no orders
        return rows.agg(F.coalesce(F.sum("total_orders"), F.lit(0)).alias("total_orders"), *[F.sum(f"s{i}").alias(m) for i, m in enumerate(part.measures)])
    if len(part.group) == 2:
        groups = [F.expr("number div 100").alias(part.group[0]), F.pmod(F.col("number"), F.lit(100)).cast("bigint").alias(part.group[1])]
    else:
        groups = [F.col("name" if part.by_name else "number").alias(part.group[0])]
    found = rows.select(*groups, "total_orders", *values)
    return found.withColumns({value: _known(value, count) for value, count in part.of})


def _known(value: str, count: str) -> Column:
    """A sum over the rows that have a value; NULL, not 0, where none has."""
    return F.when(F.col(count) != 0, F.col(value))


def partial_sums(m: Marketplace, reports: Iterable[str] = REPORTS) -> DataFrame:
    """The state of a marketplace for some reports: ``rollup, number, name, total_orders`` and further sums of every group."""
    wanted = [_stored(name, PARTS[name], PARTS[name].sums(m)) for name in reports if name in PARTS]
    if any(name in rollup.FROM_ROLLUP for name in reports):
        none = [F.lit(0).cast("bigint").alias(f"s{i}") for i in range(2, _PLACES)]
        amounts = F.coalesce("amount", F.lit(0)).alias("s0"), F.col("payment_rows").alias("s1")
        wanted.append(rollup.order_rollup(m).select("rollup", "number", "name", "total_orders", *amounts, *none))
    return reduce(DataFrame.unionByName, wanted)


def add_up(*signed: tuple[int, DataFrame]) -> DataFrame:
    """Sums of several states, each times its sign; groups without orders are left out."""
    each = [df.withColumns({name: F.col(name) * sign for name in _SUMS}) for sign, df in signed]
    summed = reduce(DataFrame.unionByName, each).groupBy("rollup", "number", "name").agg(*[F.sum(name).alias(name) for name in _SUMS])
    return summed.filter(F.greatest(*[F.abs(name) for name in _SUMS]) != 0)


def restrict(m: Marketplace, order_ids: DataFrame) -> Marketplace:
    """The marketplace of some orders (``order_id``, NULL included if listed): all their rows, and the other tables."""
    wanted = order_ids.select(F.col("order_id").alias("_wanted")).distinct()
    few = {name: _only(getattr(m, name), wanted) for name in ORDER_TABLES}
    return m.replace(**few)


def _only(df: DataFrame, wanted: DataFrame) -> DataFrame:
    return df.join(wanted, df["order_id"].eqNullSafe(wanted["_wanted"]), "left_semi")


class ReportState:
    """Some reports kept up to date in a folder."""

    def __init__(self, spark: SparkSession, folder: str, reports: Iterable[str] = REPORTS):
        self.log, self.reports = VersionLog(spark, folder), tuple(reports)

    def start(self, m: Marketplace) -> int:
        """The first version: sums over a whole marketplace."""
        return self.log.commit(partial_sums(m, self.reports), 0)

    def apply(self, before: Marketplace | None, after: Marketplace | None) -> int:
        """Take the changed orders out as they were and in as they are; None where there are none."""
        signed = [(sign, partial_sums(m, self.reports)) for sign, m in ((-1, before), (1, after)) if m is not None]
        delta = materialise(add_up(*signed))
        return self.log.update(lambda state: add_up((1, state), (1, delta)))

    def report(self, name: str, version: int | None = None) -> DataFrame:
        """A report over all orders, from the stored sums."""
        state = self.log.read(version)
        if name in PARTS:
            return PARTS[name].finish(_read(state, name, PARTS[name]))
        sums = state.select("rollup", "number", "name", "total_orders", F.col("s0").alias("amount"), F.col("s1").alias("payment_rows"))
        return rollup.FROM_ROLLUP[name](sums.withColumn("amount", _known("amount", "payment_rows")))


def replayed(name: str) -> Callable[[Marketplace], DataFrame]:
    """A report that has followed late changes up to the given marketplace.

    It starts without a tenth of the orders, with another tenth not yet delivered and paid twice, and with a third
    tenth that is deleted and comes back.
    """

    def report(m: Marketplace) -> DataFrame:
        spark = m.orders.sparkSession
        tenth = F.pmod(F.xxhash64("order_id"), F.lit(10))
        part = lambda tables, rows: tables.replace(**{t: getattr(tables, t).filter(rows) for t in ORDER_TABLES})
        early = F.when(tenth == 1, "shipped").otherwise(F.col("order_status"))
        twice = m.order_payments.unionByName(m.order_payments.filter(tenth == 1))
        old = m.replace(orders=m.orders.withColumn("order_status", early), order_payments=twice)
        state = ReportState(spark, f"{scratch_root(spark)}/stallwise-{uuid.uuid4().hex}", [name])
        keep_until_end(state.log.root)
        state.start(part(old, tenth != 0))
        state.apply(part(old, tenth.isin(1, 2)), part(m, tenth.isin(0, 1)))
        state.apply(None, part(m, tenth == 2))
        return state.report(name)

    return report
