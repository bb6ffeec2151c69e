"""The marketplace tables of ``stallwise.sources.testbed`` as common table expressions."""

ORDERS = """
loaded_orders AS (
    SELECT
        o_orderkey AS order_id,
        CASE WHEN o_orderkey % 613 <> 0 THEN o_custkey END AS customer_id,
        CASE
            WHEN o_orderkey % 601 = 0 THEN NULL
            WHEN o_orderstatus = 'F' AND o_orderkey % 11 = 0 THEN 'Delivered'
            WHEN o_orderstatus = 'F' THEN 'delivered'
            WHEN o_orderstatus = 'O' THEN 'shipped'
            WHEN o_orderkey % 4 = 1 THEN 'cancelled'
            ELSE 'unavailable'
        END AS order_status,
        o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS order_purchase_timestamp,
        CASE WHEN o_orderkey % 97 <> 0
             THEN o_orderdate + to_hours(CAST(o_orderkey % 24 + o_orderkey % 50 - 1 AS INT)) END AS order_approved_at,
        CASE WHEN o_orderkey % 53 <> 0
             THEN o_orderdate + to_hours(CAST(o_orderkey % 24 + 24 * (o_orderkey % 5)
                  - (CASE WHEN o_orderkey % 31 = 0 THEN 120 ELSE 0 END) AS INT)) END AS order_delivered_carrier_date,
        CASE WHEN o_orderstatus = 'O' OR o_orderkey % 61 = 0 OR (o_orderstatus = 'P' AND o_orderkey % 3 <> 0) THEN NULL
             ELSE o_orderdate + to_hours(CAST(o_orderkey % 24 + 24 * (3 + o_orderkey % 37)
                  - (CASE WHEN o_orderkey % 41 = 0 THEN 120 ELSE 0 END) AS INT)) END AS order_delivered_customer_date,
        CASE WHEN o_orderkey % 89 <> 0
             THEN o_orderdate + to_hours(CASE WHEN o_orderkey % 71 = 0 THEN -24 ELSE 480 END)
             END AS order_estimated_delivery_date
    FROM orders
),
m_orders AS (
    SELECT * FROM loaded_orders
    UNION ALL
    SELECT * FROM loaded_orders WHERE order_id % 499 = 0
)"""

ITEMS = """
m_items AS (
    SELECT
        CASE WHEN l_partkey % 251 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS order_id,
        l_linenumber AS order_item_id,
        CASE WHEN l_orderkey % 233 = 0 THEN -l_partkey - 1
             WHEN l_partkey % 127 = 0 AND l_partkey > 0 THEN l_partkey - 1
             ELSE l_partkey END AS product_id,
        CASE WHEN l_orderkey % 241 = 0 THEN -l_suppkey - 1 ELSE l_suppkey END AS seller_id,
        CASE WHEN l_partkey % 313 = 0 THEN NULL
             WHEN l_orderkey % 317 = 0 THEN CAST(0 AS DECIMAL(18,2))
             ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS price,
        CASE WHEN l_orderkey % 331 <> 0
             THEN CAST(CAST(l_quantity AS INT) * CAST(round(l_discount * 100) AS INT) * 2 AS DECIMAL(18,2)) / 10
             END::DECIMAL(18,2) AS freight_value
    FROM lineitem
)"""

PAYMENTS = """
m_payments AS (
    SELECT
        CASE WHEN l_partkey % 419 <> 0 THEN l_orderkey END AS order_id,
        CASE WHEN l_partkey % 409 = 0 THEN NULL
             WHEN l_returnflag = 'A' THEN 'credit_card'
             WHEN l_returnflag = 'R' THEN 'boleto'
             WHEN l_linenumber = 7 THEN 'not_defined'
             WHEN l_linenumber = 6 THEN 'debit_card'
             ELSE 'voucher' END AS payment_type,
        CASE WHEN l_partkey % 397 = 0 THEN NULL
             WHEN l_quantity = 1 THEN CAST(0 AS DECIMAL(18,2))
             WHEN l_partkey % 401 = 0 THEN -CAST(l_extendedprice AS DECIMAL(18,2))
             ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS payment_value,
        CASE WHEN l_partkey % 389 <> 0 THEN l_linenumber END AS payment_installments
    FROM lineitem
)"""

REVIEWS = """
m_reviews AS (
    SELECT
        l_partkey AS review_id,
        l_orderkey AS order_id,
        CASE WHEN l_suppkey % 53 = 0 THEN NULL
             WHEN l_partkey % 307 = 0 THEN 0
             WHEN l_partkey % 311 = 0 THEN 6
             ELSE 1 + CAST(l_quantity AS INT) % 5 END AS review_score,
        CASE WHEN l_orderkey % 29 = 0 THEN NULL
             WHEN l_orderkey % 31 = 0 THEN ' '
             WHEN l_orderkey % 37 = 0 THEN chr(9) || '  '
             WHEN l_suppkey % 2 = 0 THEN ''
             ELSE 'ok' END AS review_comment_message,
        l_shipdate AS review_creation_date
    FROM lineitem
)"""

PRODUCTS = """
loaded_products AS (
    SELECT
        p_partkey AS product_id,
        CASE WHEN p_partkey % 33 = 0 THEN NULL
             WHEN p_partkey % 101 = 0 THEN ''
             WHEN p_partkey % 103 = 0 THEN ' '
             WHEN p_partkey % 107 = 0 THEN '  '
             WHEN p_partkey % 109 = 0 THEN 'pc_gamer'
             WHEN p_partkey % 113 = 0 THEN 'portateis_cozinha_e_preparadores_de_alimentos'
             ELSE p_type END AS product_category_name,
        CASE WHEN p_partkey % 41 <> 0 THEN length(p_name) END AS product_name_length,
        CASE WHEN p_partkey % 43 <> 0 THEN p_size * 37 END AS product_description_length,
        CASE WHEN p_partkey % 47 <> 0 THEN p_size % 6 + 1 END AS product_photos_qty,
        CASE WHEN p_partkey % 263 = 0 THEN NULL WHEN p_partkey % 257 = 0 THEN 0
             WHEN p_partkey % 251 = 0 THEN 150000 ELSE p_size * 100 END AS product_weight_g,
        CASE WHEN p_partkey % 277 = 0 THEN NULL WHEN p_partkey % 269 = 0 THEN 0
             WHEN p_partkey % 271 = 0 THEN 201 ELSE p_size + 10 END AS product_length_cm,
        CASE WHEN p_partkey % 293 = 0 THEN NULL WHEN p_partkey % 281 = 0 THEN -1
             WHEN p_partkey % 283 = 0 THEN 250 ELSE p_size + 5 END AS product_height_cm,
        CASE WHEN p_partkey % 313 = 0 THEN NULL WHEN p_partkey % 307 = 0 THEN 0
             WHEN p_partkey % 311 = 0 THEN 200 ELSE p_size + 8 END AS product_width_cm
    FROM part
),
m_products AS (
    SELECT * FROM loaded_products
    UNION ALL
    SELECT * FROM loaded_products WHERE product_id % 499 = 0
)"""

TRANSLATION = """
m_translation AS (
    SELECT p_type AS product_category_name,
           CASE WHEN p_type <> 'PROMO' THEN 'English ' || p_type END AS product_category_name_english
    FROM part
    WHERE p_type NOT IN ('SMALL', 'LARGE')
    UNION
    SELECT CASE p_brand WHEN 'Brand#13' THEN '' WHEN 'Brand#14' THEN ' ' WHEN 'Brand#15' THEN NULL
                        WHEN 'Brand#19' THEN chr(9) || ' ' ELSE p_brand END,
           CASE p_brand WHEN 'Brand#16' THEN '' WHEN 'Brand#17' THEN ' ' WHEN 'Brand#18' THEN NULL
                        WHEN 'Brand#20' THEN '  '
                        ELSE 'English ' || p_brand END
    FROM part
)"""

CUSTOMERS = """
loaded_customers AS (
    SELECT c_custkey AS customer_id, c_custkey - c_custkey % 3 AS customer_unique_id, n_name AS customer_state
    FROM customer JOIN nation ON c_nationkey = n_nationkey
),
m_customers AS (
    SELECT * FROM loaded_customers
    UNION ALL
    SELECT * FROM loaded_customers WHERE customer_id % 997 = 0
)"""

SELLERS = """
m_sellers AS (
    SELECT s_suppkey AS seller_id FROM supplier
)"""
