"""Delivery punctuality, lead times and freight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions import calendar
from stallwise.functions.bands import freight_band, freight_label, lateness_band
from stallwise.functions.measures import cents, count_rows, flag, mean, mean_money, percent
from stallwise.marketplace import Marketplace
from stallwise.operators.grouping import fold, with_rank
from stallwise.plans.feedback_audit import latest_reviews
from stallwise.plans.revenue import PURCHASE, delivered

CARRIER = "order_delivered_carrier_date"
ARRIVAL = "order_delivered_customer_date"
PROMISE = "order_estimated_delivery_date"

# Scores from which a review is positive and up to which negative.
POSITIVE_FROM, NEGATIVE_TO = 4, 2


def valid_deliveries(orders: DataFrame, full_sequence: bool = False, ignore_case: bool = False) -> DataFrame:
    """Delivered orders with known dates, neither handover nor arrival before purchase.

    ``full_sequence`` also drops arrivals before handover.
    """
    purchase, carrier, arrival = F.col(PURCHASE), F.col(CARRIER), F.col(ARRIVAL)
    rows = delivered(orders, ignore_case).filter(
        arrival.isNotNull() & F.col(PROMISE).isNotNull() & (arrival >= purchase) & (carrier >= purchase)
    )
    return rows.filter(arrival >= carrier) if full_sequence else rows


def deliveries_of(m: Marketplace, full_sequence: bool = False, ignore_case: bool = False) -> DataFrame:
    """Valid deliveries of the marketplace; those of the plain reading are shared in a run."""
    if ignore_case:
        return valid_deliveries(m.orders, full_sequence, ignore_case)
    columns = ("order_id", "customer_id", PURCHASE, CARRIER, ARRIVAL, PROMISE)
    rows = m.shared("valid deliveries", lambda: valid_deliveries(m.orders).select(*columns))
    return rows.filter(F.col(ARRIVAL) >= F.col(CARRIER)) if full_sequence else rows


def lead_times(deliveries: DataFrame, *columns: str | Column) -> DataFrame:
    """Order key, given columns, and the day measures of each delivery."""
    return deliveries.select(
        "order_id",
        *columns,
        calendar.days_between(PROMISE, PURCHASE).alias("estimated_days"),
        calendar.days_between(ARRIVAL, PURCHASE).alias("actual_days"),
        calendar.days_between(ARRIVAL, PROMISE).alias("delay_days"),
        flag(F.col(ARRIVAL) <= F.col(PROMISE)).cast("bigint").alias("on_time"),
    )


def delivery_kpis(
    deliveries: DataFrame, by: Sequence[str] = (), weight: str | None = None, unique: bool = False
) -> DataFrame:
    """Distinct orders and summed day measures, ``weight`` times each row.

    With ``unique`` no order key repeats, so rows are counted and only groups are exchanged.
    """
    orders = F.count("order_id") if unique else F.countDistinct("order_id")
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    measures = ("estimated_days", "actual_days", "delay_days", "on_time")
    return deliveries.groupBy(*by).agg(
        orders.alias("total_orders"),
        F.sum(times).alias("rows"),
        *[F.sum(F.col(name) * times).alias(name) for name in measures],
    )


def delivery_overall(m: Marketplace, full_sequence: bool = False, ignore_case: bool = False) -> DataFrame:
    deliveries = lead_times(deliveries_of(m, full_sequence, ignore_case))
    return overall_report(delivery_kpis(deliveries, unique=m.is_unique("orders")))


def overall_report(kpis: DataFrame) -> DataFrame:
    return kpis.select(
        F.col("total_orders").alias("total_delivered_orders"),
        mean("estimated_days", "rows", 1).alias("avg_estimated_days"),
        mean("actual_days", "rows", 1).alias("avg_actual_days"),
        mean("delay_days", "rows", 1).alias("avg_delay_days"),
        percent("on_time", "rows").alias("on_time_delivery_pct"),
    )


def delivery_by_state(m: Marketplace, full_sequence: bool = False) -> DataFrame:
    """Delivery figures per customer state, ranked by the unrounded mean."""
    return state_report(state_kpis(m, full_sequence))


def state_kpis(m: Marketplace, full_sequence: bool = False) -> DataFrame:
    customers = fold(m.customers, "customer_id", ["customer_state"], unique=m.is_unique("customers"))
    deliveries = lead_times(deliveries_of(m, full_sequence), "customer_id").join(customers, "customer_id")
    unique = m.is_unique("orders") and m.is_unique("customers")
    return delivery_kpis(deliveries, ["customer_state"], "copies", unique)


def state_report(kpis: DataFrame) -> DataFrame:
    return (
        with_rank(kpis, F.desc(F.col("actual_days") / F.col("rows")), "slowest_rank")
        .select(
            "customer_state",
            "total_orders",
            mean("estimated_days", "rows", 1).alias("avg_estimated_days"),
            mean("actual_days", "rows", 1).alias("avg_actual_days"),
            mean("delay_days", "rows", 1).alias("avg_delay_days"),
            percent("on_time", "rows").alias("on_time_pct"),
            "slowest_rank",
        )
        .orderBy(F.desc("avg_actual_days"))
    )


def monthly_on_time(m: Marketplace, full_sequence: bool = False) -> DataFrame:
    return month_report(month_kpis(m, full_sequence))


def month_kpis(m: Marketplace, full_sequence: bool = False) -> DataFrame:
    deliveries = lead_times(
        deliveries_of(m, full_sequence),
        calendar.year(PURCHASE).alias("order_year"),
        calendar.month(PURCHASE).alias("order_month"),
    )
    return delivery_kpis(deliveries, ["order_year", "order_month"], unique=m.is_unique("orders"))


def month_report(kpis: DataFrame) -> DataFrame:
    return kpis.select(
        "order_year",
        "order_month",
        "total_orders",
        mean("actual_days", "rows", 1).alias("avg_actual_days"),
        percent("on_time", "rows").alias("on_time_pct"),
    ).orderBy("order_year", "order_month")


def punctuality_vs_review(
    m: Marketplace, same_day_is_first_band: bool = False, latest_only: bool = False, full_sequence: bool = False
) -> DataFrame:
    """Review scores per lateness band.

    An order with several reviews counts each of them, or with ``latest_only``
    its newest one.
    """
    return review_report(review_sums(m, same_day_is_first_band, latest_only, full_sequence))


def review_sums(
    m: Marketplace, same_day_is_first_band: bool = False, latest_only: bool = False, full_sequence: bool = False
) -> DataFrame:
    band = lateness_band("on_time", "delay_days", same_day_is_first_band)
    orders = fold(
        lead_times(deliveries_of(m, full_sequence)).withColumn("delivery_status", band),
        "order_id",
        ["delivery_status"],
        unique=m.is_unique("orders"),
    ).withColumnRenamed("copies", "order_copies")
    score = F.col("review_score")
    reviews = fold(
        latest_reviews(m) if latest_only else m.order_reviews,
        "order_id",
        measures={
            "score": score.cast("bigint"),
            "scored": flag(score.isNotNull()),
            "positive": flag(score >= POSITIVE_FROM),
            "negative": flag(score <= NEGATIVE_TO),
        },
    )
    times = F.col("order_copies")
    names = ("copies", "score", "scored", "positive", "negative")
    return (
        orders.join(reviews, "order_id")
        .groupBy("delivery_status")
        .agg(count_rows().alias("total_orders"), *[F.sum(F.col(n) * times).alias(n) for n in names])
    )


def review_report(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "delivery_status",
        "total_orders",
        mean("score", "scored", 2).alias("avg_review_score"),
        percent("positive", "copies").alias("pct_positive_reviews"),
        percent("negative", "copies").alias("pct_negative_reviews"),
    ).orderBy(F.desc("avg_review_score"))


def freight_vs_speed(
    m: Marketplace, without_gaps: bool = False, weighed_only: bool = False, full_sequence: bool = False
) -> DataFrame:
    """Delivery speed per freight band, averaged over item rows.

    ``weighed_only`` keeps items whose product has a positive weight.
    """
    return freight_report(freight_sums(m, without_gaps, weighed_only, full_sequence))


def freight_sums(
    m: Marketplace, without_gaps: bool = False, weighed_only: bool = False, full_sequence: bool = False
) -> DataFrame:
    orders = fold(
        lead_times(deliveries_of(m, full_sequence)),
        "order_id",
        measures={"days": F.col("actual_days"), "on_time": F.col("on_time")},
        unique=m.is_unique("orders"),
    )
    items = m.order_items
    if weighed_only:
        weighed = m.products.filter(F.col("product_weight_g") > 0).select("product_id")
        items = items.join(weighed, "product_id", "left_semi")
    shipped = fold(
        items.select("order_id", cents("freight_value").alias("freight")).withColumn(
            "band", freight_band("freight", without_gaps)
        ),
        "order_id",
        ["band"],
        {"freight": F.col("freight"), "charged": flag(F.col("freight").isNotNull())},
    ).withColumnRenamed("copies", "items")
    copies, items_in_band = F.col("copies"), F.col("items")
    return (
        shipped.join(orders, "order_id")
        .groupBy("band")
        .agg(
            count_rows().alias("total_orders"),
            F.sum(F.col("freight") * copies).alias("freight"),
            F.sum(F.col("charged") * copies).alias("charged"),
            F.sum(items_in_band * copies).alias("rows"),
            F.sum(F.col("days") * items_in_band).alias("days"),
            F.sum(F.col("on_time") * items_in_band).alias("on_time"),
        )
    )


def freight_report(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        freight_label("band").alias("freight_bucket"),
        "total_orders",
        mean_money("freight", "charged").alias("avg_freight_brl"),
        mean("days", "rows", 1).alias("avg_delivery_days"),
        percent("on_time", "rows").alias("on_time_pct"),
    ).orderBy("avg_freight_brl")


def valid_delivery_rows(m: Marketplace) -> DataFrame:
    """Day measures of every order fit for lead-time analysis, sequence checked in full."""
    return lead_times(deliveries_of(m, full_sequence=True), PURCHASE, ARRIVAL)
