"""Audit of reviews and payments, and the row rules that reports build on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions import text
from stallwise.functions.measures import cents, count_rows, count_where, money
from stallwise.marketplace import Marketplace
from stallwise.operators import audit, keys
from stallwise.operators.grouping import latest_per_group
from stallwise.plans.row_rules import rule_count, score_out_of_range

# Result names of the NULL counts.
PAYMENT_NULLS = {
    "null_order_id": "order_id",
    "null_payment_type": "payment_type",
    "null_payment_value": "payment_value",
    "null_installments": "payment_installments",
}
TOP_COLLISIONS = 10


def review_score_validation(m: Marketplace, all_rows: bool = False) -> DataFrame:
    """NULL and out-of-range scores.

    The NULL count covers the out-of-range rows only, of which none is NULL; it
    is 0, or NULL when there are no such rows. ``all_rows`` counts over the table.
    """
    score = F.col("review_score")
    outside = score_out_of_range()
    nulls = count_where(score.isNull()).alias("null_review_scores")
    if all_rows:
        return m.order_reviews.agg(nulls, F.count(F.when(outside, 1)).alias("out_of_range_scores"))
    return m.order_reviews.filter(outside).agg(nulls, count_rows().alias("out_of_range_scores"))


def review_duplicate_rows(m: Marketplace) -> DataFrame:
    return keys.duplicate_excess(m.order_reviews, ["review_id"], "total_duplicate_rows")


def review_id_collisions_topk(m: Marketplace, top: int = TOP_COLLISIONS) -> DataFrame:
    return keys.key_collisions(m.order_reviews, "review_id", "order_id", "distinct_orders", top)


def review_null_comments(m: Marketplace) -> DataFrame:
    nulls = count_where(F.col("review_comment_message").isNull())
    return m.order_reviews.agg(nulls.alias("reviews_without_text"), count_rows().alias("total_reviews"))


def review_empty_comments(m: Marketplace, any_whitespace: bool = False) -> DataFrame:
    if not any_whitespace:
        return rule_count(m, "order_reviews", "empty_comment_strings")
    blank = text.is_blank("review_comment_message", any_whitespace)
    return audit.violation_count(m.order_reviews, blank, "empty_comment_strings")


def payments_null_audit(m: Marketplace) -> DataFrame:
    return audit.null_audit(m.order_payments, PAYMENT_NULLS)


def payments_invalid_value(m: Marketplace) -> DataFrame:
    return rule_count(m, "order_payments", "invalid_payment_values")


def payments_zero_rows(m: Marketplace) -> DataFrame:
    return audit.violating_rows(m.order_payments, F.col("payment_value") == 0)


def payment_type_distribution(m: Marketplace) -> DataFrame:
    return audit.distribution(m.order_payments, "payment_type").orderBy(F.desc("cnt"))


def split_payment_orders(m: Marketplace) -> DataFrame:
    return keys.multi_valued_groups(m.order_payments, "order_id", "payment_type", "split_payment_orders")


def latest_reviews(m: Marketplace) -> DataFrame:
    """The newest review of each order, ties by review id and score."""
    return latest_per_group(m.order_reviews, "order_id", "review_creation_date", ["review_id", "review_score"])


def reviews_with_text(m: Marketplace) -> DataFrame:
    """Reviews fit for text analysis: a comment that is neither NULL nor empty."""
    return audit.violating_rows(m.order_reviews, F.col("review_comment_message") != "")


def order_payment_totals(m: Marketplace) -> DataFrame:
    """Total paid per order over all its payments."""
    return m.order_payments.groupBy("order_id").agg(money(F.sum(cents("payment_value"))).alias("total_payment"))
