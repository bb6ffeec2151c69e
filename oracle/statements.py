"""One SQL statement per report.

Ratios are rounded in integer arithmetic, half away from zero, since DuckDB
divides decimals as doubles.
"""

from __future__ import annotations

from oracle.tables import CUSTOMERS, ITEMS, ORDERS, PAYMENTS, PRODUCTS, REVIEWS, SELLERS, TRANSLATION


def with_tables(*tables: str, query: str) -> str:
    return "WITH " + ",".join(t.strip("\n") for t in tables) + query


def half_up(numerator: str, denominator: str, places: int) -> str:
    """``numerator / denominator`` rounded exactly; both are integer expressions."""
    n, d, unit = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)", 10**places
    return (
        f"CASE WHEN {d} <> 0 THEN CAST(sign({n}) * sign({d}) * "
        f"((2 * {unit} * abs({n}) + abs({d})) // (2 * abs({d}))) AS DOUBLE) / {unit} END"
    )


def cents(amount: str) -> str:
    return f"CAST({amount} * 100 AS BIGINT)"


def amount(cents_column: str) -> str:
    return f"CAST({cents_column} AS DOUBLE) / 100"


def mean_amount(cents_column: str, count: str) -> str:
    return half_up(cents_column, f"100 * {count}", 2)


def share(part: str, whole: str) -> str:
    return half_up(f"100 * {part}", whole, 2)


def null_counts(table: str, columns: dict[str, str]) -> str:
    counts = ", ".join(f"CAST(sum(({c} IS NULL)::INT) AS BIGINT) AS {name}" for name, c in columns.items())
    return f" SELECT {counts} FROM {table}"


def count_if(table: str, condition: str, name: str) -> str:
    return f" SELECT count(*) FILTER (WHERE {condition}) AS {name} FROM {table}"


def orphans(child: str, parent: str, key: str, name: str) -> str:
    return (
        f" SELECT count(*) AS {name} FROM {child} c"
        f" WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key})"
    )


def repeated(table: str, keys: str) -> str:
    return f" SELECT {keys}, count(*) AS cnt FROM {table} GROUP BY ALL HAVING count(*) > 1"


# The statuses, limits and labels in this module are those the reports are defined by.
BAD_SEQUENCE = """order_purchase_timestamp IS NOT NULL AND order_delivered_carrier_date IS NOT NULL
    AND order_delivered_customer_date IS NOT NULL
    AND (order_delivered_carrier_date < order_purchase_timestamp
         OR order_delivered_customer_date < order_delivered_carrier_date)"""
EARLY_APPROVAL = "order_approved_at < order_purchase_timestamp"
EARLY_ESTIMATE = "order_estimated_delivery_date < order_purchase_timestamp"
UNDATED = "order_status = 'delivered' AND order_delivered_customer_date IS NULL"
DATED_INCOMPLETE = "order_status IN ('cancelled', 'unavailable') AND order_delivered_customer_date IS NOT NULL"

EXTREME = """product_weight_g > 100000 OR product_length_cm > 200
    OR product_height_cm > 200 OR product_width_cm > 200"""
NO_ENGLISH = "product_category_name_english IN ('', ' ') OR product_category_name_english IS NULL"
NO_SOURCE = "product_category_name IN ('', ' ') OR product_category_name IS NULL"

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
PRODUCT_NULLS = {
    "null_product_id": "product_id",
    "null_category": "product_category_name",
    "null_name_length": "product_name_length",
    "null_description_length": "product_description_length",
    "null_photos": "product_photos_qty",
}
DIMENSIONS = {
    "weight": "product_weight_g",
    "length": "product_length_cm",
    "height": "product_height_cm",
    "width": "product_width_cm",
}
PAYMENT_NULLS = {
    "null_order_id": "order_id",
    "null_payment_type": "payment_type",
    "null_payment_value": "payment_value",
    "null_installments": "payment_installments",
}

NEW_TRANSLATIONS = """(VALUES
    ('pc_gamer', 'PC Gamer'),
    ('portateis_cozinha_e_preparadores_de_alimentos', 'Portable Kitchen & Food Processors')
) AS added(product_category_name, product_category_name_english)"""
UPSERTED = f"""(
    SELECT * FROM m_translation
    UNION ALL
    SELECT * FROM {NEW_TRANSLATIONS}
    WHERE NOT EXISTS (SELECT 1 FROM m_translation t WHERE t.product_category_name = added.product_category_name)
)"""


def audits() -> dict[str, str]:
    invalid = ", ".join(f"CAST(sum(CASE WHEN {c} <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_{n}"
                        for n, c in DIMENSIONS.items())
    orders, items, products, reviews, payments = (
        lambda q: with_tables(ORDERS, query=q),
        lambda q: with_tables(ITEMS, query=q),
        lambda q: with_tables(PRODUCTS, query=q),
        lambda q: with_tables(REVIEWS, query=q),
        lambda q: with_tables(PAYMENTS, query=q),
    )
    translation = lambda q: with_tables(TRANSLATION, query=q)
    blank_name = "product_category_name IN ('', ' ')"
    outside = "(review_score < 1 OR review_score > 5)"
    return {
        "orders_null_audit": orders(null_counts("m_orders", ORDER_NULLS)),
        "orders_duplicate_key": orders(repeated("m_orders", "order_id")),
        "orders_date_sequence_violations": orders(count_if("m_orders", BAD_SEQUENCE, "total_invalid_dates")),
        "ghost_orders": with_tables(ORDERS, ITEMS, query=orphans("m_orders", "m_items", "order_id", "ghost_orders")),
        "approval_before_purchase": orders(count_if("m_orders", EARLY_APPROVAL, "err_approval_before_purchase")),
        "estimate_before_purchase": orders(count_if("m_orders", EARLY_ESTIMATE, "err_past_estimated_delivery")),
        "order_status_distribution": orders(" SELECT order_status, count(*) AS cnt FROM m_orders GROUP BY ALL"),
        "delivered_missing_date": orders(count_if("m_orders", UNDATED, "delivered_but_no_date")),
        "delivered_missing_date_ignore_case": orders(
            count_if("m_orders", UNDATED.replace("order_status =", "lower(order_status) ="), "delivered_but_no_date")
        ),
        "cancelled_with_delivery_date": orders(count_if("m_orders", DATED_INCOMPLETE, "cancelled_but_delivered")),
        "cancelled_with_delivery_by_status": orders(
            f" SELECT order_status, count(*) AS cnt FROM m_orders WHERE {DATED_INCOMPLETE} GROUP BY ALL"
        ),
        "orders_rule_audit": orders(
            f""" SELECT count(*) FILTER (WHERE {BAD_SEQUENCE}) AS total_invalid_dates,
                count(*) FILTER (WHERE {EARLY_APPROVAL}) AS err_approval_before_purchase,
                count(*) FILTER (WHERE {EARLY_ESTIMATE}) AS err_past_estimated_delivery,
                count(*) FILTER (WHERE {UNDATED}) AS delivered_but_no_date,
                count(*) FILTER (WHERE {DATED_INCOMPLETE}) AS cancelled_but_delivered
            FROM m_orders"""
        ),
        "items_rule_audit": items(
            """ SELECT count(*) FILTER (WHERE price <= 0) AS total_invalid_prices,
                count(*) FILTER (WHERE freight_value = 0) AS free_shipping_count FROM m_items"""
        ),
        "products_rule_audit": products(
            f""" SELECT count(*) FILTER (WHERE {blank_name}) AS empty_category_strings,
                count(*) FILTER (WHERE {EXTREME}) AS suspicious_dimensions FROM m_products"""
        ),
        "translation_rule_audit": translation(
            f""" SELECT count(*) FILTER (WHERE {NO_ENGLISH}) AS empty_english_translations,
                count(*) FILTER (WHERE {NO_SOURCE}) AS empty_portuguese_categories FROM m_translation"""
        ),
        "reviews_rule_audit": reviews(
            f""" SELECT count(*) FILTER (WHERE {outside}) AS out_of_range_scores,
                count(*) FILTER (WHERE review_comment_message IS NULL) AS reviews_without_text,
                count(*) FILTER (WHERE review_comment_message IN ('', ' ')) AS empty_comment_strings FROM m_reviews"""
        ),
        "payments_rule_audit": payments(
            """ SELECT count(*) FILTER (WHERE payment_value <= 0) AS invalid_payment_values,
                count(*) FILTER (WHERE payment_value = 0) AS zero_payment_values FROM m_payments"""
        ),
        "approvals_in_order": orders(
            " SELECT * FROM m_orders WHERE order_approved_at >= order_purchase_timestamp"
        ),
        "items_null_audit": items(null_counts("m_items", ITEM_NULLS)),
        "items_invalid_price": items(count_if("m_items", "price <= 0", "total_invalid_prices")),
        "items_orphan_order": with_tables(
            ORDERS, ITEMS, query=orphans("m_items", "m_orders", "order_id", "orphaned_items_no_order")
        ),
        "items_orphan_product": with_tables(
            PRODUCTS, ITEMS, query=orphans("m_items", "m_products", "product_id", "orphaned_products")
        ),
        "items_orphan_seller": with_tables(
            SELLERS, ITEMS, query=orphans("m_items", "m_sellers", "seller_id", "orphaned_sellers")
        ),
        "items_duplicate_composite_key": items(repeated("m_items", "order_id, order_item_id")),
        "free_shipping_share": items(
            f""" SELECT *, {share('free_shipping_count', 'total_items')} AS free_shipping_pct FROM (
                SELECT count(*) FILTER (WHERE freight_value = 0) AS free_shipping_count, count(*) AS total_items
                FROM m_items)"""
        ),
        "products_null_audit": products(null_counts("m_products", PRODUCT_NULLS)),
        "products_null_dimensions": products(
            null_counts("m_products", {f"null_{n}": c for n, c in DIMENSIONS.items()})
        ),
        "products_empty_category": products(count_if("m_products", blank_name, "empty_category_strings")),
        "products_empty_category_any_whitespace": products(
            count_if("m_products", "regexp_full_match(product_category_name, '\\s*')", "empty_category_strings")
        ),
        "products_duplicate_key": products(repeated("m_products", "product_id")),
        "untranslated_categories": with_tables(
            PRODUCTS,
            TRANSLATION,
            query=""" SELECT product_category_name FROM m_products WHERE product_category_name IS NOT NULL
                EXCEPT SELECT product_category_name FROM m_translation""",
        ),
        "category_translation_upsert": translation(f" SELECT * FROM {UPSERTED}"),
        "category_translation_log": translation(f" SELECT *, CAST(2 AS BIGINT) AS version FROM {UPSERTED}"),
        "verify_translation_upsert": translation(
            f" SELECT * FROM {UPSERTED} WHERE product_category_name IN"
            f" (SELECT product_category_name FROM {NEW_TRANSLATIONS})"
        ),
        "products_invalid_dimensions": products(f" SELECT {invalid} FROM m_products"),
        "unsold_products": with_tables(
            PRODUCTS, ITEMS, query=orphans("m_products", "m_items", "product_id", "unsold_products")
        ),
        "products_extreme_dimensions": products(
            count_if(
                "m_products", EXTREME, "suspicious_dimensions"
            )
        ),
        "translation_empty_english": translation(
            count_if("m_translation", NO_ENGLISH,
                     "empty_english_translations")
        ),
        "translation_empty_source": translation(
            count_if("m_translation", NO_SOURCE,
                     "empty_portuguese_categories")
        ),
        "translation_empty_english_any_whitespace": translation(
            count_if(
                "m_translation",
                "regexp_full_match(product_category_name_english, '\\s*') OR product_category_name_english IS NULL",
                "empty_english_translations",
            )
        ),
        "translation_empty_source_any_whitespace": translation(
            count_if(
                "m_translation",
                "regexp_full_match(product_category_name, '\\s*') OR product_category_name IS NULL",
                "empty_portuguese_categories",
            )
        ),
        "review_score_validation": reviews(
            f""" SELECT CAST(sum((review_score IS NULL)::INT) AS BIGINT) AS null_review_scores,
                count(*) AS out_of_range_scores FROM m_reviews WHERE {outside}"""
        ),
        "review_score_validation_all_rows": reviews(
            f""" SELECT CAST(sum((review_score IS NULL)::INT) AS BIGINT) AS null_review_scores,
                count(*) FILTER (WHERE {outside}) AS out_of_range_scores FROM m_reviews"""
        ),
        "review_duplicate_rows": reviews(
            """ SELECT CAST(sum(copies - 1) AS BIGINT) AS total_duplicate_rows FROM (
                SELECT count(*) AS copies FROM m_reviews GROUP BY review_id) WHERE copies > 1"""
        ),
        "review_id_collisions_topk": reviews(
            """ SELECT review_id, distinct_orders FROM (
                SELECT review_id, count(DISTINCT order_id) AS distinct_orders, count(*) AS copies
                FROM m_reviews GROUP BY review_id)
            WHERE copies > 1 ORDER BY distinct_orders DESC, review_id LIMIT 10"""
        ),
        "review_null_comments": reviews(
            """ SELECT count(*) FILTER (WHERE review_comment_message IS NULL) AS reviews_without_text,
                count(*) AS total_reviews FROM m_reviews"""
        ),
        "review_empty_comments": reviews(
            count_if("m_reviews", "review_comment_message IN ('', ' ')", "empty_comment_strings")
        ),
        "review_empty_comments_any_whitespace": reviews(
            count_if("m_reviews", "regexp_full_match(review_comment_message, '\\s*')", "empty_comment_strings")
        ),
        "payments_null_audit": payments(null_counts("m_payments", PAYMENT_NULLS)),
        "payments_invalid_value": payments(count_if("m_payments", "payment_value <= 0", "invalid_payment_values")),
        "payments_zero_rows": payments(
            """ SELECT order_id, payment_type, CAST(payment_value AS DOUBLE) AS payment_value, payment_installments
            FROM m_payments WHERE payment_value = 0"""
        ),
        "payment_type_distribution": payments(
            " SELECT payment_type, count(*) AS cnt FROM m_payments GROUP BY ALL"
        ),
        "split_payment_orders": payments(
            """ SELECT count(*) AS split_payment_orders FROM (
                SELECT order_id FROM m_payments GROUP BY order_id HAVING count(DISTINCT payment_type) > 1)"""
        ),
        "latest_reviews": reviews(
            """ SELECT * FROM m_reviews QUALIFY row_number() OVER (PARTITION BY order_id
                ORDER BY review_creation_date DESC, review_id, review_score NULLS FIRST) = 1"""
        ),
        "reviews_with_text": reviews(" SELECT * FROM m_reviews WHERE review_comment_message <> ''"),
        "order_payment_totals": payments(
            f""" SELECT order_id, {amount('paid')} AS total_payment FROM (
                SELECT order_id, sum({cents('payment_value')}) AS paid FROM m_payments GROUP BY order_id)"""
        ),
    }


PAID_ORDERS = f"""
paid_orders AS (
    SELECT o.*, p.payment_type, p.payment_installments, {cents('p.payment_value')} AS paid
    FROM m_orders o JOIN m_payments p USING (order_id)
    WHERE o.order_status = 'delivered' AND p.payment_type <> 'not_defined'
)"""
REVENUE = (ORDERS, PAYMENTS, PAID_ORDERS)


def any_case(table: str) -> str:
    """The same table with the delivered status in any case."""
    return table.replace("o.order_status = 'delivered'", "lower(o.order_status) = 'delivered'").replace(
        "WHERE order_status = 'delivered'", "WHERE lower(order_status) = 'delivered'"
    )


def paid_by(*columns: str, source: str = "paid_orders") -> str:
    """Grouped payments: orders, cents and payment rows."""
    return f"""(
        SELECT {', '.join(columns)}, count(DISTINCT order_id) AS total_orders,
               sum(paid) AS cents, count(paid) AS payment_rows
        FROM {source} GROUP BY ALL)"""


MONTHS = ("year(order_purchase_timestamp) AS order_year", "month(order_purchase_timestamp) AS order_month")


def growth(monthly: str) -> str:
    return f""" SELECT order_year, order_month, {amount('cents')} AS monthly_gmv, {amount('previous')} AS prev_month_gmv,
            {share('(cents - previous)', 'previous')} AS mom_growth_pct
        FROM (SELECT *, lag(cents) OVER (ORDER BY order_year, order_month) AS previous FROM {monthly})"""


def installments(divisor: str) -> str:
    cards = "(SELECT * FROM paid_orders WHERE payment_type = 'credit_card')"
    return with_tables(
        *REVENUE,
        query=f""" SELECT CAST(payment_installments AS BIGINT) AS payment_installments, total_orders,
            {amount('cents')} AS total_revenue, {mean_amount('cents', divisor)} AS avg_order_value
        FROM {paid_by('payment_installments', source=cards)}""",
    )


def states(divisor: str) -> str:
    placed = "(SELECT * FROM paid_orders JOIN m_customers USING (customer_id))"
    return with_tables(
        *REVENUE,
        CUSTOMERS,
        query=f""" SELECT customer_state, total_orders, {amount('cents')} AS total_revenue,
            {mean_amount('cents', divisor)} AS avg_order_value, {share('cents', 'everything')} AS revenue_share_pct
        FROM (SELECT *, sum(cents) OVER () AS everything FROM {paid_by('customer_state', source=placed)})""",
    )


def categories(translation: str) -> str:
    return with_tables(
        ORDERS,
        ITEMS,
        PRODUCTS,
        TRANSLATION,
        query=f""" SELECT category, total_orders, {amount('cents')} AS total_revenue,
            {mean_amount('cents', 'priced')} AS avg_item_price,
            {mean_amount('cents', 'total_orders')} AS revenue_per_order
        FROM (
            SELECT coalesce(t.product_category_name_english, 'Uncategorized') AS category,
                   count(DISTINCT i.order_id) AS total_orders,
                   sum({cents('i.price')}) AS cents, count(i.price) AS priced
            FROM m_items i JOIN m_products p USING (product_id) JOIN m_orders o USING (order_id)
            LEFT JOIN {translation} t ON t.product_category_name = p.product_category_name
            WHERE o.order_status = 'delivered'
            GROUP BY ALL)""",
    )


def gmv(*tables: str) -> str:
    return with_tables(
        *tables,
        query=f""" SELECT order_year, order_month, total_orders, {amount('cents')} AS monthly_gmv,
            {mean_amount('cents', 'total_orders')} AS avg_order_value FROM {paid_by(*MONTHS)}""",
    )


def rolled_up(name: str, number: str = "NULL", label: str = "NULL", source: str = "paid_orders") -> str:
    groups = f"'{name}' AS rollup", f"CAST({number} AS BIGINT) AS number", f"CAST({label} AS VARCHAR) AS name"
    return f""" SELECT rollup, number, name, total_orders, CAST(cents AS BIGINT) AS amount, payment_rows
        FROM {paid_by(*groups, source=source)}"""


ROLLUP = " UNION ALL".join(
    [
        rolled_up("month", "100 * year(order_purchase_timestamp) + month(order_purchase_timestamp)"),
        rolled_up("day_of_week", "1 + dayofweek(order_purchase_timestamp)"),
        rolled_up("hour_of_day", "hour(order_purchase_timestamp)"),
        rolled_up("payment_type", label="payment_type"),
        rolled_up("installments", "payment_installments", source="(SELECT * FROM paid_orders WHERE payment_type = 'credit_card')"),
        rolled_up("state", label="customer_state", source="(SELECT * FROM paid_orders JOIN m_customers USING (customer_id))"),
    ]
)


def revenue() -> dict[str, str]:
    calendar_months = f"""(
        SELECT year(first_day) AS order_year, month(first_day) AS order_month, cents
        FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 MONTH)) AS first_day
              FROM (SELECT make_date(order_year, order_month, 1) AS d FROM {paid_by(*MONTHS)})) every
        LEFT JOIN {paid_by(*MONTHS)} g
          ON g.order_year = year(first_day) AND g.order_month = month(first_day))"""
    return {
        "monthly_gmv": gmv(*REVENUE),
        "monthly_gmv_ignore_case": gmv(ORDERS, PAYMENTS, any_case(PAID_ORDERS)),
        "category_revenue": categories("m_translation"),
        "category_revenue_after_upsert": categories(UPSERTED),
        "payment_type_revenue": with_tables(
            *REVENUE,
            query=f""" SELECT payment_type, total_orders, {amount('cents')} AS total_revenue,
                {mean_amount('cents', 'payment_rows')} AS avg_payment_value,
                {share('cents', 'everything')} AS revenue_share_pct
            FROM (SELECT *, sum(cents) OVER () AS everything FROM {paid_by('payment_type')})""",
        ),
        "installment_profile": installments("payment_rows"),
        "installment_profile_per_order": installments("total_orders"),
        "state_revenue": states("payment_rows"),
        "state_revenue_per_order": states("total_orders"),
        "day_of_week_profile": with_tables(
            *REVENUE,
            query=f""" SELECT dayname(DATE '2023-01-01' + CAST(day_number - 1 AS INT)) AS day_of_week, day_number,
                total_orders, {amount('cents')} AS total_revenue
            FROM {paid_by('1 + dayofweek(order_purchase_timestamp) AS day_number')}""",
        ),
        "hour_of_day_profile": with_tables(
            *REVENUE,
            query=f""" SELECT hour_of_day, total_orders, {amount('cents')} AS total_revenue
            FROM {paid_by('hour(order_purchase_timestamp) AS hour_of_day')}""",
        ),
        "order_rollup": with_tables(*REVENUE, CUSTOMERS, query=ROLLUP),
        "mom_growth": with_tables(*REVENUE, query=growth(paid_by(*MONTHS))),
        "mom_growth_by_calendar": with_tables(*REVENUE, query=growth(calendar_months)),
    }


PEOPLE = """
people AS (
    SELECT customer_unique_id,
           max(order_purchase_timestamp) AS last_order_date,
           date_diff('day', max(order_purchase_timestamp),
                     (SELECT max(order_purchase_timestamp) FROM m_orders)) AS recency_days,
           count(DISTINCT order_id) AS frequency,
           sum(paid) AS cents
    FROM paid_orders JOIN m_customers USING (customer_id)
    GROUP BY customer_unique_id
)"""
SCORED = """
scored AS (
    SELECT customer_unique_id, recency_days, frequency, cents,
           ntile(5) OVER (ORDER BY recency_days DESC NULLS LAST, customer_unique_id) AS r_score,
           ntile(5) OVER (ORDER BY frequency NULLS FIRST, customer_unique_id) AS f_score,
           ntile(5) OVER (ORDER BY cents NULLS FIRST, customer_unique_id) AS m_score
    FROM people
)"""
# One row per rectangle of recency and frequency scores.
SEGMENTED = """
areas(name, r_from, r_to, f_from, f_to) AS (VALUES
    ('Loyal Customer', 4, 5, 4, 5),
    ('Potential Loyalist', 4, 5, 3, 3),
    ('New Customer', 5, 5, 1, 2),
    ('Promising', 3, 4, 1, 2),
    ('At Risk', 1, 2, 4, 5),
    ('Needs Attention', 1, 2, 2, 3),
    ('Lost', 1, 1, 1, 1),
    ('Others', 2, 2, 1, 1),
    ('Others', 3, 3, 3, 5)
),
segmented AS (
    SELECT scored.*, r_score || '' || f_score || '' || m_score AS rfm_score,
           CASE WHEN (r_score, f_score, m_score) IN ((5, 5, 5), (5, 5, 4), (4, 5, 5)) THEN 'Champion'
                ELSE name END AS segment
    FROM scored JOIN areas ON r_score BETWEEN r_from AND r_to AND f_score BETWEEN f_from AND f_to
)"""
RFM = (*REVENUE, CUSTOMERS, PEOPLE, SCORED, SEGMENTED)


def rfm() -> dict[str, str]:
    metrics = f"customer_unique_id, recency_days, frequency, {amount('cents')} AS monetary"
    scores = "r_score, f_score, m_score"
    return {
        "rfm_base": with_tables(
            *REVENUE, CUSTOMERS, PEOPLE, query=f" SELECT {metrics}, last_order_date FROM people"
        ),
        "rfm_scores": with_tables(*RFM, query=f" SELECT {metrics}, {scores} FROM scored"),
        "rfm_segments": with_tables(*RFM, query=f" SELECT {metrics}, {scores}, rfm_score, segment FROM segmented"),
        "rfm_segment_summary": with_tables(
            *RFM,
            query=f""" SELECT segment, total_customers, {share('total_customers', 'everyone')} AS pct_of_customers,
                {half_up('recency', 'people', 0)} AS avg_recency_days,
                {half_up('orders', 'people', 2)} AS avg_frequency,
                {mean_amount('cents', 'paying')} AS avg_monetary_brl,
                {amount('cents')} AS total_revenue_brl
            FROM (
                SELECT *, sum(total_customers) OVER () AS everyone FROM (
                    SELECT segment, count(customer_unique_id) AS total_customers, count(*) AS people,
                           sum(recency_days) AS recency, sum(frequency) AS orders,
                           sum(cents) AS cents, count(cents) AS paying
                    FROM segmented GROUP BY segment))""",
        ),
    }


DELIVERIES = """
deliveries AS (
    SELECT *,
           date_diff('day', order_purchase_timestamp, order_estimated_delivery_date) AS estimated_days,
           date_diff('day', order_purchase_timestamp, order_delivered_customer_date) AS actual_days,
           date_diff('day', order_estimated_delivery_date, order_delivered_customer_date) AS delay_days,
           CAST(order_delivered_customer_date <= order_estimated_delivery_date AS BIGINT) AS on_time
    FROM m_orders
    WHERE order_status = 'delivered'
      AND order_delivered_customer_date IS NOT NULL
      AND order_estimated_delivery_date IS NOT NULL
      AND order_delivered_customer_date >= order_purchase_timestamp
      AND order_delivered_carrier_date >= order_purchase_timestamp
)"""
IN_SEQUENCE = "(SELECT * FROM deliveries WHERE order_delivered_customer_date >= order_delivered_carrier_date)"


def days_by(columns: str, source: str) -> str:
    return f"""(
        SELECT {columns} count(DISTINCT order_id) AS total_orders, count(*) AS rows_counted,
               sum(estimated_days) AS estimated, sum(actual_days) AS actual, sum(delay_days) AS delay,
               sum(on_time) AS punctual
        FROM {source} GROUP BY ALL)"""


def overall(source: str, deliveries: str = DELIVERIES) -> str:
    return with_tables(
        ORDERS,
        deliveries,
        query=f""" SELECT total_orders AS total_delivered_orders,
            {half_up('estimated', 'rows_counted', 1)} AS avg_estimated_days,
            {half_up('actual', 'rows_counted', 1)} AS avg_actual_days,
            {half_up('delay', 'rows_counted', 1)} AS avg_delay_days,
            {share('punctual', 'rows_counted')} AS on_time_delivery_pct
        FROM {days_by('', source)}""",
    )


def punctuality(late_from: int, reviews: str, source: str = "deliveries") -> str:
    return with_tables(
        ORDERS,
        DELIVERIES,
        REVIEWS,
        query=f""" SELECT delivery_status, total_orders,
            {half_up('score', 'scored', 2)} AS avg_review_score,
            {share('positive', 'rows_counted')} AS pct_positive_reviews,
            {share('negative', 'rows_counted')} AS pct_negative_reviews
        FROM (
            SELECT CASE WHEN on_time = 1 THEN 'On Time'
                        WHEN delay_days BETWEEN {late_from} AND 7 THEN 'Late (1-7 days)'
                        WHEN delay_days BETWEEN 8 AND 14 THEN 'Late (8-14 days)'
                        ELSE 'Late (15+ days)' END AS delivery_status,
                   count(DISTINCT order_id) AS total_orders, count(*) AS rows_counted,
                   sum(review_score) AS score, count(review_score) AS scored,
                   count(*) FILTER (WHERE review_score >= 4) AS positive,
                   count(*) FILTER (WHERE review_score <= 2) AS negative
            FROM {source} d JOIN {reviews} r USING (order_id)
            GROUP BY ALL)""",
    )


def freight(band: str, items: str = "m_items", *tables: str, source: str = "deliveries") -> str:
    return with_tables(
        ORDERS,
        DELIVERIES,
        ITEMS,
        *tables,
        query=f""" SELECT freight_bucket, total_orders,
            {mean_amount('cents', 'charged')} AS avg_freight_brl,
            {half_up('days', 'rows_counted', 1)} AS avg_delivery_days,
            {share('punctual', 'rows_counted')} AS on_time_pct
        FROM (
            SELECT {band} AS freight_bucket, count(DISTINCT order_id) AS total_orders, count(*) AS rows_counted,
                   sum({cents('freight_value')}) AS cents, count(freight_value) AS charged,
                   sum(actual_days) AS days, sum(on_time) AS punctual
            FROM {items} i JOIN {source} d USING (order_id)
            GROUP BY ALL)""",
    )


GAPPED_BAND = """CASE WHEN freight_value = 0 THEN 'Free'
    WHEN freight_value >= 1 AND freight_value <= 20 THEN '1-20 BRL'
    WHEN freight_value >= 21 AND freight_value <= 40 THEN '21-40 BRL'
    WHEN freight_value >= 41 AND freight_value <= 60 THEN '41-60 BRL'
    WHEN freight_value >= 61 AND freight_value <= 80 THEN '61-80 BRL'
    ELSE '80+ BRL' END"""
CLOSED_BAND = """CASE WHEN freight_value = 0 THEN 'Free'
    WHEN freight_value IS NULL OR freight_value < 0 THEN 'Unknown'
    WHEN freight_value <= 20 THEN '1-20 BRL'
    WHEN freight_value <= 40 THEN '21-40 BRL'
    WHEN freight_value <= 60 THEN '41-60 BRL'
    WHEN freight_value <= 80 THEN '61-80 BRL'
    ELSE '80+ BRL' END"""


def delivery_states(source: str) -> str:
    placed = f"(SELECT * FROM {source} d JOIN m_customers USING (customer_id))"
    return with_tables(
        ORDERS,
        DELIVERIES,
        CUSTOMERS,
        query=f""" SELECT customer_state, total_orders,
            {half_up('estimated', 'rows_counted', 1)} AS avg_estimated_days,
            {half_up('actual', 'rows_counted', 1)} AS avg_actual_days,
            {half_up('delay', 'rows_counted', 1)} AS avg_delay_days,
            {share('punctual', 'rows_counted')} AS on_time_pct,
            rank() OVER (ORDER BY CAST(actual AS DOUBLE) / rows_counted DESC) AS slowest_rank
        FROM {days_by('customer_state,', placed)}""",
    )


def punctual_months(source: str) -> str:
    return with_tables(
        ORDERS,
        DELIVERIES,
        query=f""" SELECT order_year, order_month, total_orders,
            {half_up('actual', 'rows_counted', 1)} AS avg_actual_days,
            {share('punctual', 'rows_counted')} AS on_time_pct
        FROM {days_by(', '.join(MONTHS) + ',', source)}""",
    )


def delivery() -> dict[str, str]:
    newest = """(SELECT * FROM m_reviews QUALIFY row_number() OVER (PARTITION BY order_id
        ORDER BY review_creation_date DESC, review_id, review_score NULLS FIRST) = 1)"""
    weighed = "(SELECT * FROM m_items WHERE product_id IN (SELECT product_id FROM m_products WHERE product_weight_g > 0))"
    return {
        "delivery_overall": overall("deliveries"),
        "delivery_overall_full_sequence": overall(IN_SEQUENCE),
        "delivery_overall_ignore_case": overall("deliveries", any_case(DELIVERIES)),
        "delivery_by_state": delivery_states("deliveries"),
        "delivery_by_state_full_sequence": delivery_states(IN_SEQUENCE),
        "punctuality_vs_review": punctuality(1, "m_reviews"),
        "punctuality_vs_review_same_day": punctuality(0, "m_reviews"),
        "punctuality_vs_latest_review": punctuality(1, newest),
        "punctuality_vs_review_full_sequence": punctuality(1, "m_reviews", IN_SEQUENCE),
        "monthly_on_time": punctual_months("deliveries"),
        "monthly_on_time_full_sequence": punctual_months(IN_SEQUENCE),
        "freight_vs_speed": freight(GAPPED_BAND),
        "freight_vs_speed_full_sequence": freight(GAPPED_BAND, source=IN_SEQUENCE),
        "freight_vs_speed_without_gaps": freight(CLOSED_BAND),
        "freight_vs_speed_weighed_only": freight(GAPPED_BAND, weighed, PRODUCTS),
        "valid_delivery_rows": with_tables(
            ORDERS,
            DELIVERIES,
            query=f""" SELECT order_id, order_purchase_timestamp, order_delivered_customer_date,
                estimated_days, actual_days, delay_days, on_time FROM {IN_SEQUENCE}""",
        ),
    }


# The keys and references that the tables declare.
KEYS = (
    ("orders", "m_orders", "order_id"),
    ("order_items", "m_items", "order_id, order_item_id"),
    ("products", "m_products", "product_id"),
    ("category_translation", "m_translation", "product_category_name"),
    ("customers", "m_customers", "customer_id"),
    ("sellers", "m_sellers", "seller_id"),
    ("order_reviews", "m_reviews", "review_id"),
)
REFERENCES = (
    ("orders.customer_id", "m_orders", "m_customers", "customer_id"),
    ("order_items.order_id", "m_items", "m_orders", "order_id"),
    ("order_items.product_id", "m_items", "m_products", "product_id"),
    ("order_items.seller_id", "m_items", "m_sellers", "seller_id"),
    ("order_payments.order_id", "m_payments", "m_orders", "order_id"),
    ("order_reviews.order_id", "m_reviews", "m_orders", "order_id"),
    ("products.product_category_name", "m_products", "m_translation", "product_category_name"),
)


def key_audits() -> dict[str, str]:
    everything = (ORDERS, ITEMS, PAYMENTS, REVIEWS, PRODUCTS, TRANSLATION, CUSTOMERS, SELLERS)
    keys = " UNION ALL ".join(
        f"""SELECT '{name}' AS audit, '{columns}' AS key_columns, count(*) AS repeated_keys,
            CAST(coalesce(sum(cnt - 1), 0) AS BIGINT) AS excess_rows, coalesce(max(cnt), 1) AS most_rows
        FROM (SELECT count(*) AS cnt FROM {table} GROUP BY {columns} HAVING count(*) > 1)"""
        for name, table, columns in KEYS
    )
    references = " UNION ALL ".join(
        f"""SELECT '{name}' AS reference, (SELECT count(*) FROM {child}) AS child_rows,
            (SELECT count(*) FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key})) AS orphan_rows,
            (SELECT count(DISTINCT {key}) FROM {child} WHERE {key} NOT IN
                (SELECT {key} FROM {parent} WHERE {key} IS NOT NULL)) AS orphan_keys,
            (SELECT count(*) FROM {parent}) AS parent_rows,
            (SELECT count(*) FROM {parent} p WHERE NOT EXISTS (SELECT 1 FROM {child} c WHERE c.{key} = p.{key})) AS childless_rows"""
        for name, child, parent, key in REFERENCES
    )
    details = "(order_status, customer_id, order_purchase_timestamp, order_approved_at, order_delivered_carrier_date," + (
        " order_delivered_customer_date, order_estimated_delivery_date)"
    )
    return {
        "key_audit": with_tables(*everything, query=" " + keys),
        "foreign_key_audit": with_tables(*everything, query=" " + references),
        "repeated_orders": with_tables(
            ORDERS,
            query=f""" SELECT order_id, count(*) AS cnt, count(DISTINCT {details}) > 1 AS conflicting
            FROM m_orders GROUP BY order_id HAVING count(*) > 1""",
        ),
    }


def witnessed(table: str, key: str, rules: dict[str, str]) -> str:
    """Violations and the three keys with the least MD5 of each rule."""
    each = " UNION ALL ".join(
        f"""SELECT '{rule}' AS rule, violations, position, witness
        FROM (SELECT count(*) FILTER (WHERE {condition}) AS violations FROM {table})
        LEFT JOIN (SELECT row_number() OVER (ORDER BY md5(witness), witness) AS position, witness
                   FROM (SELECT DISTINCT {key} AS witness FROM {table} WHERE {condition}) QUALIFY position <= 3) ON true"""
        for rule, condition in rules.items()
    )
    return " " + each


def further() -> dict[str, str]:
    dollars = "CAST(freight_value AS DECIMAL(18,2))"
    holes = {
        "freight (-inf, 0)": f"{dollars} < 0",
        "freight (0, 1)": f"{dollars} > 0 AND {dollars} < 1",
        **{f"freight ({n}, {n + 1})": f"{dollars} > {n} AND {dollars} < {n + 1}" for n in (20, 40, 60)},
        "NULL": "freight_value IS NULL",
    }
    freight = " UNION ALL ".join(
        f"SELECT 'freight' AS decision, '{region}' AS region, count(*) FILTER (WHERE {condition}) AS rows FROM m_items"
        for region, condition in holes.items()
    )
    outcomes = {
        "kept": "NOT (soon OR impossible)",
        "not a timestamp_ntz in order_approved_at": "soon",
        "not a timestamp_ntz in order_delivered_carrier_date": "impossible",
    }
    loads = " UNION ALL ".join(
        f"SELECT '{outcome}' AS outcome, count(*) AS rows FROM loads WHERE {condition} HAVING count(*) > 0"
        for outcome, condition in outcomes.items()
    )
    return {
        "decision_coverage": with_tables(
            ORDERS,
            ITEMS,
            DELIVERIES,
            query=f""" {freight}
            UNION ALL SELECT 'lateness', 'on_time 0 and delay_days (-inf, 0]', count(*) FILTER (WHERE on_time = 0 AND delay_days <= 0) FROM deliveries
            UNION ALL SELECT 'lateness', 'NULL', count(*) FILTER (WHERE on_time IS NULL OR delay_days IS NULL) FROM deliveries""",
        ),
        "orders_rule_witnesses": with_tables(
            ORDERS,
            query=witnessed(
                "m_orders",
                "coalesce(CAST(order_id AS VARCHAR), '')",
                {
                    "total_invalid_dates": BAD_SEQUENCE,
                    "err_approval_before_purchase": EARLY_APPROVAL,
                    "err_past_estimated_delivery": EARLY_ESTIMATE,
                    "delivered_but_no_date": UNDATED,
                    "cancelled_but_delivered": DATED_INCOMPLETE,
                },
            ),
        ),
        "items_rule_witnesses": with_tables(
            ITEMS,
            query=witnessed(
                "m_items",
                "coalesce(CAST(order_id AS VARCHAR), '') || ',' || coalesce(CAST(order_item_id AS VARCHAR), '')",
                {"total_invalid_prices": "price <= 0", "free_shipping_count": "freight_value = 0"},
            ),
        ),
        "orders_quarantine": with_tables(
            ORDERS,
            query=f""" SELECT * FROM (WITH loads AS (
                SELECT coalesce(hour(order_purchase_timestamp) = 3, false) AS soon,
                       coalesce(day(order_purchase_timestamp) = 13, false) AS impossible FROM m_orders) {loads})""",
        ),
        "distinct_by_month": with_tables(
            ORDERS,
            CUSTOMERS,
            query=""" SELECT year(order_purchase_timestamp) AS order_year, month(order_purchase_timestamp) AS order_month, customer_state,
                count(DISTINCT order_id) AS orders, count(DISTINCT customer_unique_id) AS persons,
                true AS orders_within_bound, true AS persons_within_bound
            FROM m_orders JOIN m_customers USING (customer_id) WHERE order_status = 'delivered' GROUP BY ALL""",
        ),
    }


# The text columns that are keys or labels, by table expression.
LABELS = {
    "orders": (ORDERS, ("order_status",)),
    "payments": (PAYMENTS, ("payment_type",)),
    "products": (PRODUCTS, ("product_category_name",)),
    "translation": (TRANSLATION, ("product_category_name", "product_category_name_english")),
    "customers": (CUSTOMERS, ("customer_state",)),
}


def any_spelling(query: str) -> str:
    """The query over tables whose labels are in small letters and without accents."""
    for name, (table, columns) in LABELS.items():
        table = table.strip("\n")
        spelled = ", ".join(f"strip_accents(lower({column})) AS {column}" for column in columns)
        wrapped = f"{table.replace(f'm_{name} AS', f'given_{name} AS')},\nm_{name} AS (SELECT * REPLACE ({spelled}) FROM given_{name})"
        query = query.replace(table, wrapped)
    return query


def oracle_sql() -> dict[str, str]:
    plain = audits() | revenue() | rfm() | delivery() | key_audits() | further()
    # a state that has followed changes gives what a full run gives
    changed = ("monthly_gmv", "category_revenue", "delivery_by_state")
    # and neither does it matter how tables are stored
    clustered = ("monthly_gmv", "freight_vs_speed", "punctuality_vs_review")
    spelled = (
        "order_status_distribution cancelled_with_delivery_date cancelled_with_delivery_by_status orders_rule_audit "
        "untranslated_categories foreign_key_audit payment_type_distribution split_payment_orders payment_type_revenue "
        "installment_profile category_revenue state_revenue mom_growth delivery_by_state punctuality_vs_review "
        "freight_vs_speed rfm_segment_summary"
    ).split()
    return (
        plain
        | {f"{name}_after_changes": plain[name] for name in changed}
        | {f"{name}_clustered": plain[name] for name in clustered}
        | {f"{name}_any_spelling": any_spelling(plain[name]) for name in spelled}
    )
