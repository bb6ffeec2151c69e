"""Marketplace tables derived from the order-processing test tables.

The test tables have no payments, reviews or delivery dates and hold no faults.
Missing columns and faults are derived by fixed arithmetic on the keys, so each
audit has something to find and SQL can derive the same rows. They are test
inputs, not facts about the data.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwise.marketplace import Marketplace

_LONG, _INT, _TEXT, _REAL, _TIME = (
    T.LongType(),
    T.IntegerType(),
    T.StringType(),
    T.DoubleType(),
    T.TimestampNTZType(),
)
TEST_SCHEMAS = {
    "nation": {"n_nationkey": _INT, "n_name": _TEXT},
    "customer": {"c_custkey": _LONG, "c_nationkey": _INT},
    "supplier": {"s_suppkey": _LONG},
    "part": {"p_partkey": _LONG, "p_name": _TEXT, "p_brand": _TEXT, "p_type": _TEXT, "p_size": _INT},
    "orders": {"o_orderkey": _LONG, "o_custkey": _LONG, "o_orderstatus": _TEXT, "o_orderdate": _TIME},
    "lineitem": {
        "l_orderkey": _LONG,
        "l_partkey": _LONG,
        "l_suppkey": _LONG,
        "l_linenumber": _INT,
        "l_quantity": _REAL,
        "l_extendedprice": _REAL,
        "l_discount": _REAL,
        "l_returnflag": _TEXT,
        "l_shipdate": _TIME,
    },
}

# Types without a translation, and the one translated to nothing.
UNTRANSLATED_TYPES = ("SMALL", "LARGE")
BLANK_TYPE = "PROMO"


def testbed(spark: SparkSession, folder: str, unique: tuple[str, ...] = ()) -> Marketplace:
    """Marketplace over the test tables in ``folder``."""

    def read(table: str) -> DataFrame:
        schema = T.StructType([T.StructField(n, kind, True) for n, kind in TEST_SCHEMAS[table].items()])
        return spark.read.schema(schema).parquet(f"{folder}/{table}.parquet")

    return Marketplace(lambda name: _BUILDERS[name](read), unique)


Read = Callable[[str], DataFrame]


def _every(key: str, n: int) -> Column:
    return F.col(key) % n == 0


def _twice(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of every n-th key once more, as a batch loaded twice would leave them."""
    times = F.when(_every(key, n), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return df.withColumn("_copy", F.explode(times)).drop("_copy")


def _decimal(amount: str) -> Column:
    """A double of two places as a decimal, without Spark's detour through text."""
    whole = F.floor(F.col(amount) * 100 + 0.5).cast("decimal(18,0)")
    return (whole * F.lit(Decimal("0.01"))).cast("decimal(18,2)")


def _null_every(key: str, n: int, value: Column) -> Column:
    return F.when(~_every(key, n), value)


def _orders(read: Read) -> DataFrame:
    k = F.col("o_orderkey")
    part_status = F.when(k % 4 == 1, "cancelled").otherwise("unavailable")
    status = F.col("o_orderstatus")

    def after(hours: Column) -> Column:
        return F.timestamp_add("HOUR", hours, F.col("o_orderdate"))

    carrier = k % 24 + 24 * (k % 5) - F.when(k % 31 == 0, 120).otherwise(0)
    arrival = k % 24 + 24 * (3 + k % 37) - F.when(k % 41 == 0, 120).otherwise(0)
    no_arrival = (status == "O") | (k % 61 == 0) | ((status == "P") & (k % 3 != 0))
    rows = read("orders").select(
        k.alias("order_id"),
        _null_every("o_orderkey", 613, F.col("o_custkey")).alias("customer_id"),
        _null_every(
            "o_orderkey",
            601,
            F.when((status == "F") & (k % 11 == 0), "Delivered")
            .when(status == "F", "delivered")
            .when(status == "O", "shipped")
            .otherwise(part_status),
        ).alias("order_status"),
        after(k % 24).alias("order_purchase_timestamp"),
        _null_every("o_orderkey", 97, after(k % 24 + k % 50 - 1)).alias("order_approved_at"),
        _null_every("o_orderkey", 53, after(carrier)).alias("order_delivered_carrier_date"),
        F.when(~no_arrival, after(arrival)).alias("order_delivered_customer_date"),
        _null_every("o_orderkey", 89, after(F.when(k % 71 == 0, -24).otherwise(480))).alias(
            "order_estimated_delivery_date"
        ),
    )
    return _twice(rows, "order_id", 499)


def _order_items(read: Read) -> DataFrame:
    part = F.col("l_partkey")
    price = F.when(_every("l_orderkey", 317), F.lit(0)).otherwise(_decimal("l_extendedprice"))
    percent = F.round(F.col("l_discount") * 100).cast("int")
    freight = (F.col("l_quantity").cast("int") * percent).cast("decimal(18,2)") * F.lit(0.2).cast("decimal(2,1)")
    return read("lineitem").select(
        F.when(_every("l_partkey", 251), -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")).alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.when(_every("l_orderkey", 233), -part - 1)
        .when(_every("l_partkey", 127) & (part > 0), part - 1)
        .otherwise(part)
        .alias("product_id"),
        F.when(_every("l_orderkey", 241), -F.col("l_suppkey") - 1).otherwise(F.col("l_suppkey")).alias("seller_id"),
        _null_every("l_partkey", 313, price).cast("decimal(18,2)").alias("price"),
        _null_every("l_orderkey", 331, freight).cast("decimal(18,2)").alias("freight_value"),
    )


def _order_payments(read: Read) -> DataFrame:
    line = F.col("l_linenumber")
    unreturned = F.when(line == 7, "not_defined").when(line == 6, "debit_card").otherwise("voucher")
    kind = (
        F.when(F.col("l_returnflag") == "A", "credit_card")
        .when(F.col("l_returnflag") == "R", "boleto")
        .otherwise(unreturned)
    )
    paid = _decimal("l_extendedprice")
    value = F.when(F.col("l_quantity") == 1, F.lit(0)).when(_every("l_partkey", 401), -paid).otherwise(paid)
    return read("lineitem").select(
        _null_every("l_partkey", 419, F.col("l_orderkey")).alias("order_id"),
        _null_every("l_partkey", 409, kind).alias("payment_type"),
        _null_every("l_partkey", 397, value).cast("decimal(18,2)").alias("payment_value"),
        _null_every("l_partkey", 389, line).alias("payment_installments"),
    )


def _order_reviews(read: Read) -> DataFrame:
    score = (
        F.when(_every("l_partkey", 307), 0)
        .when(_every("l_partkey", 311), 6)
        .otherwise(1 + F.col("l_quantity").cast("int") % 5)
    )
    comment = (
        F.when(_every("l_orderkey", 31), " ")
        .when(_every("l_orderkey", 37), "\t  ")
        .when(_every("l_suppkey", 2), "")
        .otherwise("ok")
    )
    return read("lineitem").select(
        F.col("l_partkey").alias("review_id"),
        F.col("l_orderkey").alias("order_id"),
        _null_every("l_suppkey", 53, score).cast("int").alias("review_score"),
        _null_every("l_orderkey", 29, comment).alias("review_comment_message"),
        F.col("l_shipdate").alias("review_creation_date"),
    )


def _dimension(base: Column, null_every: int, fault_every: int, fault: int, extreme_every: int, extreme: int) -> Column:
    value = (
        F.when(_every("p_partkey", fault_every), fault).when(_every("p_partkey", extreme_every), extreme).otherwise(base)
    )
    return _null_every("p_partkey", null_every, value).cast("int")


def _products(read: Read) -> DataFrame:
    size = F.col("p_size")
    category = (
        F.when(_every("p_partkey", 101), "")
        .when(_every("p_partkey", 103), " ")
        .when(_every("p_partkey", 107), "  ")
        .when(_every("p_partkey", 109), "pc_gamer")
        .when(_every("p_partkey", 113), "portateis_cozinha_e_preparadores_de_alimentos")
        .otherwise(F.col("p_type"))
    )
    rows = read("part").select(
        F.col("p_partkey").alias("product_id"),
        _null_every("p_partkey", 33, category).alias("product_category_name"),
        _null_every("p_partkey", 41, F.length("p_name")).alias("product_name_length"),
        _null_every("p_partkey", 43, size * 37).alias("product_description_length"),
        _null_every("p_partkey", 47, size % 6 + 1).alias("product_photos_qty"),
        _dimension(size * 100, 263, 257, 0, 251, 150000).alias("product_weight_g"),
        _dimension(size + 10, 277, 269, 0, 271, 201).alias("product_length_cm"),
        _dimension(size + 5, 293, 281, -1, 283, 250).alias("product_height_cm"),
        _dimension(size + 8, 313, 307, 0, 311, 200).alias("product_width_cm"),
    )
    return _twice(rows, "product_id", 499)


def _category_translation(read: Read) -> DataFrame:
    """Translated types, and brands as further entries with faults on both sides."""
    kind, brand = F.col("p_type"), F.col("p_brand")
    types = (
        read("part")
        .filter(~kind.isin(*UNTRANSLATED_TYPES))
        .select(
            kind.alias("product_category_name"),
            F.when(kind != BLANK_TYPE, F.concat(F.lit("English "), kind)).alias("product_category_name_english"),
        )
    )
    brands = read("part").select(
        F.when(brand == "Brand#13", "")
        .when(brand == "Brand#14", " ")
        .when(brand == "Brand#19", "\t ")
        .when(brand != "Brand#15", brand),
        F.when(brand == "Brand#16", "")
        .when(brand == "Brand#17", " ")
        .when(brand == "Brand#20", "  ")
        .when(brand != "Brand#18", F.concat(F.lit("English "), brand)),
    )
    return types.union(brands).distinct()


def _customers(read: Read) -> DataFrame:
    customer, nation = read("customer"), read("nation")
    rows = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(
        F.col("c_custkey").alias("customer_id"),
        (F.col("c_custkey") - F.col("c_custkey") % 3).alias("customer_unique_id"),
        F.col("n_name").alias("customer_state"),
    )
    return _twice(rows, "customer_id", 997)


def _sellers(read: Read) -> DataFrame:
    return read("supplier").select(F.col("s_suppkey").alias("seller_id"))


_BUILDERS: dict[str, Callable[[Read], DataFrame]] = {
    "orders": _orders,
    "order_items": _order_items,
    "products": _products,
    "category_translation": _category_translation,
    "order_reviews": _order_reviews,
    "order_payments": _order_payments,
    "customers": _customers,
    "sellers": _sellers,
}
