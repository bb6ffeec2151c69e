"""Declared schemas of the marketplace tables.

Every column is nullable: the audits exist to count the NULLs.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "orders": _schema(
        order_id=T.StringType(),
        customer_id=T.StringType(),
        order_status=T.StringType(),
        order_purchase_timestamp=T.TimestampNTZType(),
        order_approved_at=T.TimestampNTZType(),
        order_delivered_carrier_date=T.TimestampNTZType(),
        order_delivered_customer_date=T.TimestampNTZType(),
        order_estimated_delivery_date=T.TimestampNTZType(),
    ),
    "order_items": _schema(
        order_id=T.StringType(),
        order_item_id=T.IntegerType(),
        product_id=T.StringType(),
        seller_id=T.StringType(),
        price=MONEY,
        freight_value=MONEY,
    ),
    "products": _schema(
        product_id=T.StringType(),
        product_category_name=T.StringType(),
        product_name_length=T.IntegerType(),
        product_description_length=T.IntegerType(),
        product_photos_qty=T.IntegerType(),
        product_weight_g=T.IntegerType(),
        product_length_cm=T.IntegerType(),
        product_height_cm=T.IntegerType(),
        product_width_cm=T.IntegerType(),
    ),
    "category_translation": _schema(
        product_category_name=T.StringType(),
        product_category_name_english=T.StringType(),
    ),
    "order_reviews": _schema(
        review_id=T.StringType(),
        order_id=T.StringType(),
        review_score=T.IntegerType(),
        review_comment_message=T.StringType(),
        review_creation_date=T.TimestampNTZType(),
    ),
    "order_payments": _schema(
        order_id=T.StringType(),
        payment_type=T.StringType(),
        payment_value=MONEY,
        payment_installments=T.IntegerType(),
    ),
    "customers": _schema(
        customer_id=T.StringType(),
        customer_unique_id=T.StringType(),
        customer_state=T.StringType(),
    ),
    "sellers": _schema(seller_id=T.StringType()),
}

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "products": ("product_id",),
    "category_translation": ("product_category_name",),
    "customers": ("customer_id",),
    "sellers": ("seller_id",),
}

# Text that is neither a key nor a label.
FREE_TEXT = ("review_comment_message",)
