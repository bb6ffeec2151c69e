"""All declared keys and references of the marketplace, audited together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.marketplace import Marketplace
from stallwise.operators import references, singletons
from stallwise.operators.references import ForeignKey
from stallwise.sources.schemas import PRIMARY_KEYS

# Keys that are audited beside the primary keys: reviews should have an id of their own.
OTHER_KEYS = {"order_reviews": ("review_id",)}

FOREIGN_KEYS = (
    ForeignKey("orders.customer_id", "orders", "customer_id", "customers", "customer_id"),
    ForeignKey("order_items.order_id", "order_items", "order_id", "orders", "order_id"),
    ForeignKey("order_items.product_id", "order_items", "product_id", "products", "product_id"),
    ForeignKey("order_items.seller_id", "order_items", "seller_id", "sellers", "seller_id"),
    ForeignKey("order_payments.order_id", "order_payments", "order_id", "orders", "order_id"),
    ForeignKey("order_reviews.order_id", "order_reviews", "order_id", "orders", "order_id"),
    ForeignKey(
        "products.product_category_name", "products", "product_category_name", "category_translation", "product_category_name"
    ),
)


def key_audit(m: Marketplace) -> DataFrame:
    """Every declared key with the number of its values that repeat."""
    return singletons.key_audit({name: (getattr(m, name), keys) for name, keys in (PRIMARY_KEYS | OTHER_KEYS).items()})


def foreign_key_audit(m: Marketplace) -> DataFrame:
    """Every reference between the tables with its orphans, and the parents that nothing refers to."""
    names = dict.fromkeys(name for c in FOREIGN_KEYS for name in (c.child, c.parent))
    return references.foreign_key_audit({name: getattr(m, name) for name in names}, FOREIGN_KEYS)


def repeated_orders(m: Marketplace) -> DataFrame:
    """Orders that are in the table more than once: their rows, and how many differ in status or dates."""
    few = singletons.rows_that_may_repeat(m.orders, ["order_id"])
    others = F.struct(*[F.col(name) for name in m.orders.columns if name != "order_id"])
    counted = few.groupBy("order_id").agg(F.count(F.lit(1)).alias("cnt"), F.min(others).alias("low"), F.max(others).alias("high"))
    differ = ~F.col("low").eqNullSafe(F.col("high"))
    return counted.filter(F.col("cnt") > 1).select("order_id", "cnt", differ.alias("conflicting"))
