"""All reports by name, each a function of the marketplace."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from stallwise.marketplace import Marketplace
from stallwise.plans import coverage, delivery, distinct_counts, feedback_audit, key_audit, orders_audit, products_audit, report_state, revenue, rfm, rollup, row_rules
from stallwise.sources import quarantine
from stallwise.sources.clustered import from_clustered

Report = Callable[..., DataFrame]

_REPORTS: tuple[Report, ...] = (
    orders_audit.orders_null_audit,
    orders_audit.orders_duplicate_key,
    orders_audit.orders_date_sequence_violations,
    orders_audit.ghost_orders,
    orders_audit.approval_before_purchase,
    orders_audit.estimate_before_purchase,
    orders_audit.order_status_distribution,
    orders_audit.delivered_missing_date,
    orders_audit.cancelled_with_delivery_date,
    orders_audit.cancelled_with_delivery_by_status,
    orders_audit.items_null_audit,
    orders_audit.items_invalid_price,
    orders_audit.items_orphan_order,
    orders_audit.items_orphan_product,
    orders_audit.items_orphan_seller,
    orders_audit.items_duplicate_composite_key,
    orders_audit.free_shipping_share,
    products_audit.products_null_audit,
    products_audit.products_null_dimensions,
    products_audit.products_empty_category,
    products_audit.products_duplicate_key,
    products_audit.untranslated_categories,
    products_audit.category_translation_upsert,
    products_audit.verify_translation_upsert,
    products_audit.products_invalid_dimensions,
    products_audit.unsold_products,
    products_audit.products_extreme_dimensions,
    products_audit.translation_empty_english,
    products_audit.translation_empty_source,
    feedback_audit.review_score_validation,
    feedback_audit.review_duplicate_rows,
    feedback_audit.review_id_collisions_topk,
    feedback_audit.review_null_comments,
    feedback_audit.review_empty_comments,
    feedback_audit.payments_null_audit,
    feedback_audit.payments_invalid_value,
    feedback_audit.payments_zero_rows,
    feedback_audit.payment_type_distribution,
    feedback_audit.split_payment_orders,
    revenue.monthly_gmv,
    revenue.category_revenue,
    revenue.payment_type_revenue,
    revenue.installment_profile,
    revenue.state_revenue,
    revenue.day_of_week_profile,
    revenue.hour_of_day_profile,
    revenue.mom_growth,
    rfm.rfm_base,
    rfm.rfm_scores,
    rfm.rfm_segments,
    rfm.rfm_segment_summary,
    delivery.delivery_overall,
    delivery.delivery_by_state,
    delivery.punctuality_vs_review,
    delivery.monthly_on_time,
    delivery.freight_vs_speed,
    # Row rules and combined audits that the reports build on.
    row_rules.orders_rule_audit,
    row_rules.items_rule_audit,
    row_rules.products_rule_audit,
    row_rules.translation_rule_audit,
    row_rules.reviews_rule_audit,
    row_rules.payments_rule_audit,
    orders_audit.approvals_in_order,
    delivery.valid_delivery_rows,
    feedback_audit.latest_reviews,
    feedback_audit.reviews_with_text,
    feedback_audit.order_payment_totals,
    # All keys and references at once.
    key_audit.key_audit,
    key_audit.foreign_key_audit,
    key_audit.repeated_orders,
    # Sums of all order and payment reports, from one join.
    rollup.order_rollup,
    # Rows between the rules, examples of broken rules, loads with bad values, sketches.
    coverage.decision_coverage,
    row_rules.orders_rule_witnesses,
    row_rules.items_rule_witnesses,
    quarantine.orders_quarantine,
    distinct_counts.distinct_by_month,
)

# Corrected readings of reports whose plain form follows the letter of the SQL.
_VARIANTS: dict[str, Report] = {
    "products_empty_category_any_whitespace": partial(products_audit.products_empty_category, any_whitespace=True),
    "review_score_validation_all_rows": partial(feedback_audit.review_score_validation, all_rows=True),
    "review_empty_comments_any_whitespace": partial(feedback_audit.review_empty_comments, any_whitespace=True),
    "delivered_missing_date_ignore_case": partial(orders_audit.delivered_missing_date, ignore_case=True),
    "installment_profile_per_order": partial(revenue.installment_profile, per_order=True),
    "state_revenue_per_order": partial(revenue.state_revenue, per_order=True),
    "mom_growth_by_calendar": partial(revenue.mom_growth, by_calendar=True),
    "delivery_overall_full_sequence": partial(delivery.delivery_overall, full_sequence=True),
    "punctuality_vs_review_same_day": partial(delivery.punctuality_vs_review, same_day_is_first_band=True),
    "punctuality_vs_latest_review": partial(delivery.punctuality_vs_review, latest_only=True),
    "freight_vs_speed_without_gaps": partial(delivery.freight_vs_speed, without_gaps=True),
    "freight_vs_speed_weighed_only": partial(delivery.freight_vs_speed, weighed_only=True),
    "delivery_by_state_full_sequence": partial(delivery.delivery_by_state, full_sequence=True),
    "monthly_on_time_full_sequence": partial(delivery.monthly_on_time, full_sequence=True),
    "punctuality_vs_review_full_sequence": partial(delivery.punctuality_vs_review, full_sequence=True),
    "freight_vs_speed_full_sequence": partial(delivery.freight_vs_speed, full_sequence=True),
    "translation_empty_english_any_whitespace": partial(
        products_audit.translation_empty_english, any_whitespace=True
    ),
    "translation_empty_source_any_whitespace": partial(products_audit.translation_empty_source, any_whitespace=True),
    "monthly_gmv_ignore_case": partial(revenue.monthly_gmv, ignore_case=True),
    "delivery_overall_ignore_case": partial(delivery.delivery_overall, ignore_case=True),
    "category_revenue_after_upsert": products_audit.after_upsert(revenue.category_revenue),
    "category_translation_log": products_audit.category_translation_log,
    # Reports from stored sums that have followed late changes of orders.
    "monthly_gmv_after_changes": report_state.replayed("monthly_gmv"),
    "category_revenue_after_changes": report_state.replayed("category_revenue"),
    "delivery_by_state_after_changes": report_state.replayed("delivery_by_state"),
    # Reports over tables stored by order.
    "monthly_gmv_clustered": from_clustered(revenue.monthly_gmv, "orders", "order_payments"),
    "freight_vs_speed_clustered": from_clustered(delivery.freight_vs_speed, "orders", "order_items"),
    "punctuality_vs_review_clustered": from_clustered(delivery.punctuality_vs_review, "orders", "order_reviews"),
}

_PLAIN: dict[str, Report] = {report.__name__: report for report in _REPORTS}


def in_any_spelling(report: Report) -> Report:
    """The report over keys and labels compared without regard to case and accents."""
    return lambda marketplace: report(marketplace.any_spelling())


# Reports that filter, group or join by text, so that the collation of the tables matters to them.
ANY_SPELLING = (
    "order_status_distribution",
    "cancelled_with_delivery_date",
    "cancelled_with_delivery_by_status",
    "orders_rule_audit",
    "untranslated_categories",
    "foreign_key_audit",
    "payment_type_distribution",
    "split_payment_orders",
    "payment_type_revenue",
    "installment_profile",
    "category_revenue",
    "state_revenue",
    "mom_growth",
    "delivery_by_state",
    "punctuality_vs_review",
    "freight_vs_speed",
    "rfm_segment_summary",
)
_SPELLED = {f"{name}_any_spelling": in_any_spelling(_PLAIN[name]) for name in ANY_SPELLING}

REPORTS: dict[str, Report] = _PLAIN | _VARIANTS | _SPELLED


def run_report(name: str, marketplace: Marketplace) -> DataFrame:
    """A report by name. In a run of many, those that the rollup answers take it from there."""
    if marketplace.is_sharing and name in rollup.FROM_ROLLUP:
        return rollup.FROM_ROLLUP[name](rollup.order_rollup(marketplace))
    return REPORTS[name](marketplace)
