"""Small hand-written marketplaces in the native schema."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from stallwise.marketplace import Marketplace
from stallwise.sources.schemas import SCHEMAS


def at(text):
    """'2017-11-27 10:00' or '2017-11-27' as a timestamp; None stays None."""
    if text is None:
        return None
    return datetime.fromisoformat(text)


def amount(value):
    return None if value is None else Decimal(str(value))


def marketplace(spark, unique=(), **tables):
    """Rows are dicts; absent columns are NULL and absent tables are empty."""
    frames = {}
    for name, schema in SCHEMAS.items():
        rows = [tuple(row.get(f.name) for f in schema) for row in tables.get(name, [])]
        frames[name] = spark.createDataFrame(rows, schema)
    return Marketplace.from_frames(frames, unique)


def order(order_id, customer="c1", status="delivered", purchase="2018-01-01", carrier=None, arrival=None,
          promise=None, approved=None):
    return {
        "order_id": order_id,
        "customer_id": customer,
        "order_status": status,
        "order_purchase_timestamp": at(purchase),
        "order_approved_at": at(approved),
        "order_delivered_carrier_date": at(carrier),
        "order_delivered_customer_date": at(arrival),
        "order_estimated_delivery_date": at(promise),
    }


def item(order_id, number=1, product="p1", seller="s1", price=1, freight=1):
    return {
        "order_id": order_id,
        "order_item_id": number,
        "product_id": product,
        "seller_id": seller,
        "price": amount(price),
        "freight_value": amount(freight),
    }


def payment(order_id, kind="credit_card", value=1, installments=1):
    return {
        "order_id": order_id,
        "payment_type": kind,
        "payment_value": amount(value),
        "payment_installments": installments,
    }


def review(review_id, order_id, score=5, comment="fine", created="2018-02-01"):
    return {
        "review_id": review_id,
        "order_id": order_id,
        "review_score": score,
        "review_comment_message": comment,
        "review_creation_date": at(created),
    }


def customer(customer_id, person=None, state="SP"):
    return {"customer_id": customer_id, "customer_unique_id": person or customer_id, "customer_state": state}


def product(product_id, category=None, **sizes):
    return {"product_id": product_id, "product_category_name": category} | sizes


def translation(name, english):
    return {"product_category_name": name, "product_category_name_english": english}


def rows(df):
    return [tuple(r) for r in df.collect()]


def only(df):
    (row,) = rows(df)
    return row
