"""Revenue by month, category, payment type, region and time of day.

All cover delivered orders. Payments and orders meet on the order key only after
each side is folded, see :func:`stallwise.operators.grouping.fold`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions import calendar, text
from stallwise.functions.measures import cents, count_rows, flag, mean_money, money
from stallwise.marketplace import Marketplace
from stallwise.operators.grouping import fill_months, fold, period_growth, with_share_of_total
from stallwise.plans.row_rules import DELIVERED

# Payment types with a role of their own, and the default label.
UNDEFINED_PAYMENT = "not_defined"
CREDIT_CARD = "credit_card"
UNCATEGORIZED = "Uncategorized"

PURCHASE = "order_purchase_timestamp"


def delivered(orders: DataFrame, ignore_case: bool = False) -> DataFrame:
    return orders.filter(text.equals("order_status", DELIVERED, ignore_case))


def defined_payments(payments: DataFrame) -> DataFrame:
    """Payments of a known type; zero-value vouchers stay, NULL types go."""
    return payments.filter(F.col("payment_type") != UNDEFINED_PAYMENT)


def fold_payments(payments: DataFrame, *attributes: str) -> DataFrame:
    """Per order and attributes: cents paid and the payments that have an amount."""
    measures = {"paid": cents("payment_value"), "payments": flag(F.col("payment_value").isNotNull())}
    return fold(payments, "order_id", attributes, measures)


def payments_by_order(m: Marketplace) -> DataFrame:
    """Payments of a known type, folded by order; many reports join on it."""
    return m.shared("payments by order", lambda: fold_payments(defined_payments(m.order_payments)))


def delivered_by(m: Marketplace, attributes: Mapping[str, Column], ignore_case: bool = False) -> DataFrame:
    """Delivered orders folded by order key and attributes derived from the order."""
    orders = delivered(m.orders, ignore_case).select("order_id", *[c.alias(n) for n, c in attributes.items()])
    return fold(orders, "order_id", list(attributes), unique=m.is_unique("orders"))


def delivered_with_customer(m: Marketplace, attribute: str, *order_columns: str) -> DataFrame:
    """Delivered orders with an attribute of their customer, and ``copies``.

    The customer join comes first and takes orders unfolded: the orders of one
    customer cannot be folded without losing their keys, so a customer with very
    many orders is left to the adaptive skew split.
    """
    customers = fold(m.customers, "customer_id", [attribute], unique=m.is_unique("customers"))
    orders = delivered(m.orders).select("order_id", "customer_id", *order_columns)
    return orders.join(customers, "customer_id").drop("customer_id")


def join_payments(orders: DataFrame, payments: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Order count, cents and payment rows per attribute from two folded sides.

    Exactly one side carries the attributes, so joined rows are unique per order
    and attributes and counting them counts distinct orders.
    """
    joined = orders.select("order_id", *_own(orders, attributes), F.col("copies").alias("order_copies")).join(
        payments.drop("copies"), "order_id"
    )
    return joined.groupBy(*attributes).agg(
        count_rows().alias("total_orders"),
        F.sum(F.col("paid") * F.col("order_copies")).alias("amount"),
        F.sum(F.col("payments") * F.col("order_copies")).alias("payment_rows"),
    )


def _own(df: DataFrame, attributes: Sequence[str]) -> list[str]:
    return [a for a in attributes if a in df.columns]


def monthly_amounts(m: Marketplace, ignore_case: bool = False) -> DataFrame:
    months = {"order_year": calendar.year(PURCHASE), "order_month": calendar.month(PURCHASE)}
    payments = payments_by_order(m)
    return join_payments(delivered_by(m, months, ignore_case), payments, list(months))


def monthly_gmv(m: Marketplace, ignore_case: bool = False) -> DataFrame:
    return gmv_report(monthly_amounts(m, ignore_case))


def gmv_report(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        "order_year",
        "order_month",
        "total_orders",
        money("amount").alias("monthly_gmv"),
        mean_money("amount", "total_orders").alias("avg_order_value"),
    ).orderBy("order_year", "order_month")


def mom_growth(m: Marketplace, by_calendar: bool = False) -> DataFrame:
    """Change against the previous row, or with ``by_calendar`` the previous month.

    The calendar form lists months without revenue too, with a NULL amount.
    """
    return growth_report(monthly_amounts(m), by_calendar)


def growth_report(amounts: DataFrame, by_calendar: bool = False) -> DataFrame:
    monthly = amounts.select("order_year", "order_month", F.col("amount").alias("monthly_gmv"))
    if by_calendar:
        monthly = fill_months(monthly, "order_year", "order_month")
    grown = period_growth(monthly, ["order_year", "order_month"], "monthly_gmv", "prev_month_gmv", "mom_growth_pct")
    return grown.select(
        "order_year",
        "order_month",
        money("monthly_gmv").alias("monthly_gmv"),
        money("prev_month_gmv").alias("prev_month_gmv"),
        "mom_growth_pct",
    ).orderBy("order_year", "order_month")


def category_revenue(m: Marketplace) -> DataFrame:
    return category_report(category_amounts(m))


def category_amounts(m: Marketplace) -> DataFrame:
    """Orders, cents and priced items per English category name.

    Names are joined to products and the result folded by product and name, so items meet
    one narrow table by product key and never travel by category. Items stay unfolded for
    the sake of the order key; a best seller is left to the adaptive skew split. The order
    join comes last.
    """
    names = fold(
        m.category_translation,
        "product_category_name",
        ["product_category_name_english"],
        unique=m.is_unique("category_translation"),
    ).withColumnRenamed("copies", "name_copies")
    products = fold(m.products, "product_id", ["product_category_name"], unique=m.is_unique("products"))
    label = F.coalesce("product_category_name_english", F.lit(UNCATEGORIZED))
    times = F.col("copies") * F.coalesce("name_copies", F.lit(1))
    named = products.join(names, "product_category_name", "left").select(
        "product_id", label.alias("category"), times.alias("times")
    )
    if not (m.is_unique("products") and m.is_unique("category_translation")):
        named = named.groupBy("product_id", "category").agg(F.sum("times").alias("times"))
    items = m.order_items.select("order_id", "product_id", cents("price").alias("price"))
    sold = (
        items.join(named, "product_id")
        .groupBy("order_id", "category")
        .agg(
            F.sum(F.col("price") * F.col("times")).alias("amount"),
            F.sum(flag(F.col("price").isNotNull()) * F.col("times")).alias("priced_items"),
        )
    )
    return (
        sold.join(delivered_by(m, {}), "order_id")
        .groupBy("category")
        .agg(
            count_rows().alias("total_orders"),
            F.sum(F.col("amount") * F.col("copies")).alias("amount"),
            F.sum(F.col("priced_items") * F.col("copies")).alias("priced_items"),
        )
    )


def category_report(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "category",
        "total_orders",
        money("amount").alias("total_revenue"),
        mean_money("amount", "priced_items").alias("avg_item_price"),
        mean_money("amount", "total_orders").alias("revenue_per_order"),
    ).orderBy(F.desc("total_revenue"))


def payment_type_revenue(m: Marketplace) -> DataFrame:
    payments = fold_payments(defined_payments(m.order_payments), "payment_type")
    return payment_type_report(join_payments(delivered_by(m, {}), payments, ["payment_type"]))


def payment_type_report(grouped: DataFrame) -> DataFrame:
    return (
        with_share_of_total(grouped, "amount", "revenue_share_pct")
        .select(
            "payment_type",
            "total_orders",
            money("amount").alias("total_revenue"),
            mean_money("amount", "payment_rows").alias("avg_payment_value"),
            "revenue_share_pct",
        )
        .orderBy(F.desc("total_revenue"))
    )


def installment_profile(m: Marketplace, per_order: bool = False) -> DataFrame:
    """Credit card revenue per number of installments.

    ``avg_order_value`` is the mean payment row, or with ``per_order`` the mean
    per distinct order.
    """
    cards = m.order_payments.filter(F.col("payment_type") == CREDIT_CARD)
    payments = fold_payments(cards, "payment_installments")
    return installment_report(join_payments(delivered_by(m, {}), payments, ["payment_installments"]), per_order)


def installment_report(grouped: DataFrame, per_order: bool = False) -> DataFrame:
    return grouped.select(
        F.col("payment_installments").cast("bigint").alias("payment_installments"),
        "total_orders",
        money("amount").alias("total_revenue"),
        mean_money("amount", "total_orders" if per_order else "payment_rows").alias("avg_order_value"),
    ).orderBy("payment_installments")


def state_revenue(m: Marketplace, per_order: bool = False) -> DataFrame:
    """Revenue per customer state; ``per_order`` as in :func:`installment_profile`."""
    orders = (
        delivered_with_customer(m, "customer_state")
        .groupBy("order_id", "customer_state")
        .agg(F.sum("copies").alias("copies"))
    )
    payments = payments_by_order(m)
    return state_report(join_payments(orders, payments, ["customer_state"]), per_order)


def state_report(grouped: DataFrame, per_order: bool = False) -> DataFrame:
    return (
        with_share_of_total(grouped, "amount", "revenue_share_pct")
        .select(
            "customer_state",
            "total_orders",
            money("amount").alias("total_revenue"),
            mean_money("amount", "total_orders" if per_order else "payment_rows").alias("avg_order_value"),
            "revenue_share_pct",
        )
        .orderBy(F.desc("total_revenue"))
    )


def day_of_week_profile(m: Marketplace) -> DataFrame:
    payments = payments_by_order(m)
    orders = delivered_by(m, {"day_number": calendar.day_number(PURCHASE)})
    return day_report(join_payments(orders, payments, ["day_number"]))


def day_report(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        calendar.day_name("day_number").alias("day_of_week"),
        "day_number",
        "total_orders",
        money("amount").alias("total_revenue"),
    ).orderBy("day_number")


def hour_of_day_profile(m: Marketplace) -> DataFrame:
    payments = payments_by_order(m)
    orders = delivered_by(m, {"hour_of_day": calendar.hour(PURCHASE)})
    return hour_report(join_payments(orders, payments, ["hour_of_day"]))


def hour_report(grouped: DataFrame) -> DataFrame:
    return grouped.select("hour_of_day", "total_orders", money("amount").alias("total_revenue")).orderBy("hour_of_day")
