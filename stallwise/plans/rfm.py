"""Recency, frequency and monetary scoring of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions.bands import customer_segment
from stallwise.functions.calendar import days_between
from stallwise.functions.measures import count_rows, mean, mean_money, money
from stallwise.marketplace import Marketplace
from stallwise.operators.grouping import with_share_of_total
from stallwise.operators.heavy import heavy_keys
from stallwise.operators.tiles import SortKey, with_tiles
from stallwise.plans.revenue import PURCHASE, delivered, delivered_with_customer, payments_by_order
from stallwise.session import materialise

TILES = 5
PERSON = "customer_unique_id"

# Score orderings. The person breaks ties, without which a score is arbitrary.
SCORES = {
    "r_score": (SortKey("recency_days", ascending=False), SortKey(PERSON)),
    "f_score": (SortKey("frequency"), SortKey(PERSON)),
    "m_score": (SortKey("monetary"), SortKey(PERSON)),
}


# An order key is heavy when more than one in so many delivered orders have it; so
# there are fewer heavy keys than this, and they can be broadcast at any size.
HEAVY_ONE_IN = 1000


def heavy_orders(m: Marketplace) -> DataFrame:
    """Order keys that a share of all delivered orders have, with the parts to split them in.

    The share is taken of the rows that have a key; only candidates of it are counted and exchanged.
    """
    orders = delivered(m.orders).filter(F.col("order_id").isNotNull())
    heavy = heavy_keys(orders, "order_id", HEAVY_ONE_IN)
    rows = orders.agg(count_rows()).scalar()
    return heavy.select("order_id", F.ceil(F.col("rows") * HEAVY_ONE_IN / rows).cast("bigint").alias("parts"))


def paid_orders(m: Marketplace) -> DataFrame:
    """Delivered orders by person with what was paid for them.

    The orders of a heavy key with different persons cannot be folded. They are split
    by person, and the one row of the key's payments is repeated for each part.
    """
    orders = (
        delivered_with_customer(m, PERSON, PURCHASE)
        .groupBy("order_id", PERSON)
        .agg(F.max(PURCHASE).alias("last_order_date"), F.sum("copies").alias("copies"))
    )
    payments = payments_by_order(m).drop("copies", "payments")
    if m.is_unique("orders"):
        return orders.join(payments, "order_id")
    heavy = F.broadcast(heavy_orders(m))
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    split = orders.join(heavy, "order_id", "left").withColumn("part", F.pmod(F.xxhash64(PERSON), parts))
    each = payments.join(heavy, "order_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return split.drop("parts").join(each.drop("parts"), ["order_id", "part"]).drop("part")


def person_metrics(m: Marketplace) -> DataFrame:
    """Last order, recency, distinct orders and cents paid per person.

    Recency counts back from the latest purchase among all orders, delivered or not.
    """
    latest = m.orders.agg(F.max(PURCHASE)).scalar()
    return (
        paid_orders(m)
        .groupBy(PERSON)
        .agg(
            F.max("last_order_date").alias("last_order_date"),
            count_rows().alias("frequency"),
            F.sum(F.col("paid") * F.col("copies")).alias("monetary"),
        )
        .select(
            PERSON,
            "last_order_date",
            days_between(latest, F.col("last_order_date")).alias("recency_days"),
            "frequency",
            "monetary",
        )
    )


def _metrics(m: Marketplace) -> DataFrame:
    return m.shared("person metrics", lambda: person_metrics(m))


def scored(m: Marketplace) -> DataFrame:
    """Persons with their scores.

    The metrics are written and the boundaries searched while this DataFrame is built.
    """
    def build() -> DataFrame:
        metrics = _metrics(m).drop("last_order_date")
        return with_tiles(metrics if m.is_sharing else materialise(metrics), TILES, SCORES)

    return m.shared("scored persons", build)


def segmented(m: Marketplace) -> DataFrame:
    digits = [F.col(score).cast("string") for score in SCORES]
    return scored(m).withColumns({"rfm_score": F.concat(*digits), "segment": customer_segment(*SCORES)})


def rfm_base(m: Marketplace) -> DataFrame:
    return _metrics(m).withColumn("monetary", money("monetary"))


def rfm_scores(m: Marketplace) -> DataFrame:
    return scored(m).withColumn("monetary", money("monetary"))


def rfm_segments(m: Marketplace) -> DataFrame:
    return segmented(m).withColumn("monetary", money("monetary"))


def rfm_segment_summary(m: Marketplace) -> DataFrame:
    grouped = (
        segmented(m)
        .groupBy("segment")
        .agg(
            F.count(PERSON).alias("total_customers"),
            F.sum("recency_days").alias("recency"),
            F.sum("frequency").alias("orders"),
            F.sum("monetary").alias("amount"),
            count_rows().alias("rows"),
            F.count("monetary").alias("paying"),
        )
    )
    return (
        with_share_of_total(grouped, "total_customers", "pct_of_customers")
        .select(
            "segment",
            "total_customers",
            "pct_of_customers",
            mean("recency", "rows", 0).alias("avg_recency_days"),
            mean("orders", "rows", 2).alias("avg_frequency"),
            mean_money("amount", "paying").alias("avg_monetary_brl"),
            money("amount").alias("total_revenue_brl"),
        )
        .orderBy(F.desc("total_revenue_brl"))
    )
