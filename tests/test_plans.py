"""Physical plans: what reaches the scan, what is exchanged, and how skew is met."""

from __future__ import annotations

import re

import pytest
from market import rows
from pyspark.sql import functions as F

from stallwise import REPORTS, Marketplace
from stallwise.plans import rfm
from stallwise.plans.catalog import run_report
from stallwise.sources.schemas import SCHEMAS
from stallwise.sources import testbed as derived

HOT = "hot"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


@pytest.fixture(scope="module")
def hot_folder(spark, tmp_path_factory):
    """A marketplace where one customer and one product hold a third of all rows,
    and one order a third of the items, payments and reviews."""
    folder = str(tmp_path_factory.mktemp("hot"))
    n = F.col("id")
    text = n.cast("string")
    day = F.expr("timestamp_ntz'2018-01-01 00:00:00'")

    def hot_third(column):
        return F.when(n % 3 == 0, HOT).otherwise(column)

    orders = spark.range(0, 12000, 1, 6).select(
        F.when(n == 0, HOT).otherwise(text).alias("order_id"),
        hot_third(text).alias("customer_id"),
        F.lit("delivered").alias("order_status"),
        F.timestamp_add("DAY", n % 300, day).alias("order_purchase_timestamp"),
        F.timestamp_add("DAY", n % 300 + 1, day).alias("order_delivered_carrier_date"),
        F.timestamp_add("DAY", n % 300 + 2 + n % 9, day).alias("order_delivered_customer_date"),
        F.timestamp_add("DAY", n % 300 + 6, day).alias("order_estimated_delivery_date"),
    )
    spread = F.xxhash64("id")
    tables = {
        "orders": orders,
        "order_items": spark.range(0, 12000, 1, 6).select(
            hot_third(text).alias("order_id"),
            (n % 4).cast("int").alias("order_item_id"),
            F.when(spread % 3 == 0, HOT).otherwise((n % 3000).cast("string")).alias("product_id"),
            (n % 500).cast("decimal(18,2)").alias("price"),
            (n % 90).cast("decimal(18,2)").alias("freight_value"),
        ),
        "order_payments": spark.range(0, 12000, 1, 6).select(
            hot_third(text).alias("order_id"),
            F.when(spread % 3 == 0, "boleto").otherwise("credit_card").alias("payment_type"),
            (n % 700).cast("decimal(18,2)").alias("payment_value"),
            (n % 5).cast("int").alias("payment_installments"),
        ),
        "order_reviews": spark.range(0, 12000, 1, 6).select(
            text.alias("review_id"), hot_third(text).alias("order_id"), (n % 5 + 1).cast("int").alias("review_score")
        ),
        "customers": spark.range(0, 12000, 1, 6).select(
            F.when(n == 0, HOT).otherwise(text).alias("customer_id"),
            (n % 900).cast("string").alias("customer_unique_id"),
            (n % 27).cast("string").alias("customer_state"),
        ),
        "products": spark.range(0, 3000, 1, 3).select(
            F.when(n == 1, HOT).otherwise(text).alias("product_id"),
            (n % 40).cast("string").alias("product_category_name"),
        ),
        "category_translation": spark.range(0, 30, 1, 1).select(
            text.alias("product_category_name"), F.concat(F.lit("c"), text).alias("product_category_name_english")
        ),
    }
    for name, schema in SCHEMAS.items():
        df = tables.get(name)
        df = spark.createDataFrame([], schema) if df is None else df
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in df.columns]
        df.select("*", *missing).select(*schema.names).write.parquet(f"{folder}/{name}")
    return folder


@pytest.fixture
def hot_market(spark, hot_folder):
    return Marketplace.from_folder(spark, hot_folder)


@pytest.fixture
def no_broadcast(setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")


def test_filters_and_columns_reach_the_scan(hot_market):
    text = plan(run_report("monthly_gmv", hot_market))
    assert "EqualTo(order_status,delivered)" in text
    assert "Not(EqualTo(payment_type,not_defined))" in text
    assert "ReadSchema: struct<order_id:string,order_status:string,order_purchase_timestamp:timestamp_ntz>" in text
    assert "LessThanOrEqual(price,0.00)" in plan(run_report("items_invalid_price", hot_market))
    orphans = plan(run_report("items_orphan_seller", hot_market))
    assert "ReadSchema: struct<seller_id:string>" in orphans and "order_id" not in orphans


@pytest.mark.parametrize("name", REPORTS)
def test_no_python_no_cross_join(hot_market, no_broadcast, name):
    text = plan(run_report(name, hot_market))
    for operator in ("Python", "Pandas", "CartesianProduct", "NestedLoop"):
        assert operator not in text


@pytest.mark.parametrize(
    ("name", "folded", "unique"),
    # Orders and payments once each and the groups; folded orders travel twice.
    # The heavy keys of rfm_base are counted by one exchange on either side of its order join.
    [
        ("monthly_gmv", 4, 3),
        ("freight_vs_speed", 4, 4),
        ("rfm_base", 10, 6),
        ("state_revenue", 7, 6),
        ("delivery_by_state", 5, 3),
        ("monthly_on_time", 2, 1),
        ("delivery_overall", 1, 0),
    ],
)
def test_exchanges(hot_market, no_broadcast, hot_folder, spark, name, folded, unique):
    assert exchanges(run_report(name, hot_market)) == folded
    trusted = Marketplace.from_folder(spark, hot_folder, unique=["orders", "customers", "products"])
    assert exchanges(run_report(name, trusted)) == unique


def test_order_fold_is_partial_before_the_exchange(hot_market, no_broadcast):
    """A hot order leaves each task as one row."""
    text = plan(run_report("monthly_gmv", hot_market))
    payments = text[text.rindex("Sort [order_id") :]
    assert payments.index("functions=[sum(") < payments.index("Exchange") < payments.index("partial_sum(")


@pytest.mark.parametrize("name", ["state_revenue", "rfm_base", "delivery_by_state", "category_revenue"])
def test_hot_customer_or_product_is_split(hot_market, no_broadcast, setting, name):
    expected = sorted(rows(run_report(name, hot_market)), key=str)
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "4KB")
    setting("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8KB")
    df = run_report(name, hot_market)
    assert sorted(rows(df), key=str) == expected
    assert "skew=true" in plan(df)


def test_items_never_travel_by_category(hot_market, no_broadcast):
    text = plan(run_report("category_revenue", hot_market))
    exchanges_by_category = [
        line for line in text.splitlines() if re.search(r"Exchange hashpartitioning\(product_category_name", line)
    ]
    assert exchanges_by_category
    below = text[text.index("Exchange hashpartitioning(product_category_name") :]
    assert "product_category_name" in below and "order_item" not in below and "price" not in below.split("FileScan")[0]


def test_hot_order_of_many_persons_is_split(spark, tmp_path, no_broadcast, setting):
    """One key on a third of the orders, each with a customer of its own."""
    n, text = F.col("id"), F.col("id").cast("string")
    key = F.when(n % 3 == 0, HOT).otherwise(text)
    day = F.expr("timestamp_ntz'2018-01-01 00:00:00'")
    tables = {
        "orders": spark.range(0, 12000, 1, 6).select(
            key.alias("order_id"), text.alias("customer_id"), F.lit("delivered").alias("order_status"),
            F.timestamp_add("DAY", n % 300, day).alias("order_purchase_timestamp"),
        ),
        "customers": spark.range(0, 12000, 1, 6).select(
            text.alias("customer_id"), text.alias("customer_unique_id"), F.lit("SP").alias("customer_state")
        ),
        "order_payments": spark.range(0, 12000, 1, 6).select(
            key.alias("order_id"), F.lit("boleto").alias("payment_type"), (n % 7).cast("decimal(18,2)").alias("payment_value")
        ),
    }
    for name, schema in SCHEMAS.items():
        df = tables.get(name, spark.createDataFrame([], schema))
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in df.columns]
        df.select("*", *missing).select(*schema.names).write.parquet(f"{tmp_path}/{name}")
    market = Marketplace.from_folder(spark, str(tmp_path))
    market.register_views()
    expected = spark.sql(
        """SELECT customer_unique_id, count(DISTINCT order_id), cast(sum(payment_value) AS double)
        FROM orders JOIN customers USING (customer_id) JOIN order_payments USING (order_id) GROUP BY 1"""
    )
    found = run_report("rfm_base", market)
    assert sorted(rows(found.select("customer_unique_id", "frequency", "monetary"))) == sorted(rows(expected))
    setting("spark.sql.adaptive.enabled", "false")
    setting("spark.sql.shuffle.partitions", "16")
    per_task = rfm.paid_orders(market).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) < 12000 / 16 * 2


PLAIN_SQL = {
    "monthly_gmv": """
        SELECT year(order_purchase_timestamp), month(order_purchase_timestamp), count(DISTINCT order_id),
               cast(sum(payment_value) AS double)
        FROM orders JOIN order_payments USING (order_id) GROUP BY 1, 2""",
    "state_revenue": """
        SELECT customer_state, count(DISTINCT order_id), cast(sum(payment_value) AS double)
        FROM orders JOIN customers USING (customer_id) JOIN order_payments USING (order_id) GROUP BY 1""",
    "category_revenue": """
        SELECT coalesce(product_category_name_english, 'Uncategorized'), count(DISTINCT order_id),
               cast(sum(price) AS double)
        FROM orders JOIN order_items USING (order_id) JOIN products USING (product_id)
        LEFT JOIN category_translation USING (product_category_name) GROUP BY 1""",
    "payment_type_revenue": """
        SELECT payment_type, count(DISTINCT order_id), cast(sum(payment_value) AS double)
        FROM orders JOIN order_payments USING (order_id) GROUP BY 1""",
}


@pytest.mark.parametrize("name", PLAIN_SQL)
def test_hot_keys_lose_no_rows(spark, hot_market, name):
    hot_market.register_views()
    expected = sorted(rows(spark.sql(PLAIN_SQL[name])), key=str)
    found = run_report(name, hot_market)
    assert sorted(rows(found.select(*found.columns[: len(expected[0])])), key=str) == expected


def test_latest_review_is_limited_before_the_exchange(hot_market):
    assert plan(run_report("latest_reviews", hot_market)).count("WindowGroupLimit") == 2


def test_top_collisions_are_not_sorted_in_full(hot_market):
    assert "TakeOrderedAndProject" in plan(run_report("review_id_collisions_topk", hot_market))


def test_test_tables_are_read_with_declared_columns(spark):
    text = plan(run_report("payments_invalid_value", derived.testbed(spark, "/root/testdata/sf0.001")))
    assert "l_shipdate" not in text and "l_extendedprice" in text
