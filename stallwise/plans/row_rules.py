"""Rules on single rows of a table, each by the name its count is reported under."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions import text
from stallwise.marketplace import Marketplace
from stallwise.operators import audit, witnesses

# Order statuses, the review score range, and limits of dimensions.
DELIVERED = "delivered"
NEVER_COMPLETED = ("cancelled", "unavailable")
LOWEST_SCORE, HIGHEST_SCORE = 1, 5
DIMENSION_LIMITS = {
    "product_weight_g": 100000,
    "product_length_cm": 200,
    "product_height_cm": 200,
    "product_width_cm": 200,
}


def broken_date_sequence() -> Column:
    """Handed over before purchase or delivered before handover, all dates known."""
    purchase, carrier, customer = (
        F.col("order_purchase_timestamp"),
        F.col("order_delivered_carrier_date"),
        F.col("order_delivered_customer_date"),
    )
    known = purchase.isNotNull() & carrier.isNotNull() & customer.isNotNull()
    return known & ((carrier < purchase) | (customer < carrier))


def delivered_undated(ignore_case: bool = False) -> Column:
    return text.equals("order_status", DELIVERED, ignore_case) & F.col("order_delivered_customer_date").isNull()


def incomplete_but_dated() -> Column:
    return F.col("order_status").isin(*NEVER_COMPLETED) & F.col("order_delivered_customer_date").isNotNull()


def score_out_of_range() -> Column:
    return (F.col("review_score") < LOWEST_SCORE) | (F.col("review_score") > HIGHEST_SCORE)


def unusable(column: str, any_whitespace: bool = False) -> Column:
    return text.is_blank(column, any_whitespace) | F.col(column).isNull()


def _order_rules() -> dict[str, Column]:
    purchase = F.col("order_purchase_timestamp")
    return {
        "total_invalid_dates": broken_date_sequence(),
        "err_approval_before_purchase": F.col("order_approved_at") < purchase,
        "err_past_estimated_delivery": F.col("order_estimated_delivery_date") < purchase,
        "delivered_but_no_date": delivered_undated(),
        "cancelled_but_delivered": incomplete_but_dated(),
    }


def _item_rules() -> dict[str, Column]:
    return {"total_invalid_prices": F.col("price") <= 0, "free_shipping_count": F.col("freight_value") == 0}


def _product_rules() -> dict[str, Column]:
    return {
        "empty_category_strings": text.is_blank("product_category_name"),
        "suspicious_dimensions": reduce(or_, [F.col(c) > limit for c, limit in DIMENSION_LIMITS.items()]),
    }


def _translation_rules() -> dict[str, Column]:
    return {
        "empty_english_translations": unusable("product_category_name_english"),
        "empty_portuguese_categories": unusable("product_category_name"),
    }


def _review_rules() -> dict[str, Column]:
    return {
        "out_of_range_scores": score_out_of_range(),
        "reviews_without_text": F.col("review_comment_message").isNull(),
        "empty_comment_strings": text.is_blank("review_comment_message"),
    }


def _payment_rules() -> dict[str, Column]:
    return {"invalid_payment_values": F.col("payment_value") <= 0, "zero_payment_values": F.col("payment_value") == 0}


RULES: dict[str, Callable[[], dict[str, Column]]] = {
    "orders": _order_rules,
    "order_items": _item_rules,
    "products": _product_rules,
    "category_translation": _translation_rules,
    "order_reviews": _review_rules,
    "order_payments": _payment_rules,
}


def rule_audit(m: Marketplace, table: str) -> DataFrame:
    """All rules on a table, counted in one scan."""
    return m.shared(f"rules of {table}", lambda: audit.rule_audit(getattr(m, table), RULES[table]()))


WITNESSES = 3


def rule_witnesses(m: Marketplace, table: str, keys: tuple[str, ...], k: int = WITNESSES) -> DataFrame:
    """All rules on a table, counted in one scan that also keeps a few keys which break each."""
    return witnesses.rule_witnesses(getattr(m, table), RULES[table](), keys, k)


def orders_rule_witnesses(m: Marketplace) -> DataFrame:
    return rule_witnesses(m, "orders", ("order_id",))


def items_rule_witnesses(m: Marketplace) -> DataFrame:
    return rule_witnesses(m, "order_items", ("order_id", "order_item_id"))


def rule_count(m: Marketplace, table: str, name: str) -> DataFrame:
    """Rows that break one rule. In a run of many reports the table's one scan has counted them."""
    if m.is_sharing:
        return rule_audit(m, table).select(name)
    return audit.violation_count(getattr(m, table), RULES[table]()[name], name)


def orders_rule_audit(m: Marketplace) -> DataFrame:
    return rule_audit(m, "orders")


def items_rule_audit(m: Marketplace) -> DataFrame:
    return rule_audit(m, "order_items")


def products_rule_audit(m: Marketplace) -> DataFrame:
    return rule_audit(m, "products")


def translation_rule_audit(m: Marketplace) -> DataFrame:
    return rule_audit(m, "category_translation")


def reviews_rule_audit(m: Marketplace) -> DataFrame:
    return rule_audit(m, "order_reviews")


def payments_rule_audit(m: Marketplace) -> DataFrame:
    return rule_audit(m, "order_payments")
