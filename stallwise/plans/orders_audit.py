"""Audit of orders and order items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.marketplace import Marketplace
from stallwise.operators import audit, keys
from stallwise.plans.row_rules import delivered_undated, incomplete_but_dated, rule_count

# Result names of the NULL counts.
ORDER_NULLS = {
    "null_order_id": "order_id",
    "null_customer_id": "customer_id",
    "null_status": "order_status",
    "null_purchase_date": "order_purchase_timestamp",
    "null_approved": "order_approved_at",
    "null_carrier": "order_delivered_carrier_date",
    "null_delivered": "order_delivered_customer_date",
    "null_estimated": "order_estimated_delivery_date",
}
ITEM_NULLS = {
    "null_order_id": "order_id",
    "null_product_id": "product_id",
    "null_seller_id": "seller_id",
    "null_price": "price",
    "null_freight": "freight_value",
}


def orders_null_audit(m: Marketplace) -> DataFrame:
    return audit.null_audit(m.orders, ORDER_NULLS)


def orders_duplicate_key(m: Marketplace) -> DataFrame:
    return keys.duplicate_keys(m.orders, ["order_id"])


def orders_date_sequence_violations(m: Marketplace) -> DataFrame:
    return rule_count(m, "orders", "total_invalid_dates")


def ghost_orders(m: Marketplace) -> DataFrame:
    return keys.orphan_count(m.orders, m.order_items, "order_id", "ghost_orders")


def approval_before_purchase(m: Marketplace) -> DataFrame:
    return rule_count(m, "orders", "err_approval_before_purchase")


def estimate_before_purchase(m: Marketplace) -> DataFrame:
    return rule_count(m, "orders", "err_past_estimated_delivery")


def order_status_distribution(m: Marketplace) -> DataFrame:
    return audit.distribution(m.orders, "order_status").orderBy(F.desc("cnt"))


def delivered_missing_date(m: Marketplace, ignore_case: bool = False) -> DataFrame:
    if not ignore_case:
        return rule_count(m, "orders", "delivered_but_no_date")
    return audit.violation_count(m.orders, delivered_undated(ignore_case), "delivered_but_no_date")


def cancelled_with_delivery_date(m: Marketplace) -> DataFrame:
    return rule_count(m, "orders", "cancelled_but_delivered")


def cancelled_with_delivery_by_status(m: Marketplace) -> DataFrame:
    return audit.distribution(m.orders, "order_status", incomplete_but_dated())


def approvals_in_order(m: Marketplace) -> DataFrame:
    """Orders fit for approval lead times: approved, and not before purchase."""
    return audit.violating_rows(m.orders, F.col("order_approved_at") >= F.col("order_purchase_timestamp"))


def items_null_audit(m: Marketplace) -> DataFrame:
    return audit.null_audit(m.order_items, ITEM_NULLS)


def items_invalid_price(m: Marketplace) -> DataFrame:
    return rule_count(m, "order_items", "total_invalid_prices")


def items_orphan_order(m: Marketplace) -> DataFrame:
    return keys.orphan_count(m.order_items, m.orders, "order_id", "orphaned_items_no_order")


def items_orphan_product(m: Marketplace) -> DataFrame:
    return keys.orphan_count(m.order_items, m.products, "product_id", "orphaned_products")


def items_orphan_seller(m: Marketplace) -> DataFrame:
    return keys.orphan_count(m.order_items, m.sellers, "seller_id", "orphaned_sellers")


def items_duplicate_composite_key(m: Marketplace) -> DataFrame:
    return keys.duplicate_keys(m.order_items, ["order_id", "order_item_id"])


def free_shipping_share(m: Marketplace) -> DataFrame:
    return audit.conditional_share(
        m.order_items, F.col("freight_value") == 0, "free_shipping_count", "total_items", "free_shipping_pct"
    )
