"""Keys and labels compared without regard to case and accents."""

from __future__ import annotations

import pytest
from compare import connect, difference
from conftest import TESTDATA
from market import item, marketplace, order, payment
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as contract
from stallwise.functions.text import one_spelling
from stallwise.marketplace import Marketplace
from stallwise.plans import orders_audit, revenue
from stallwise.plans.catalog import ANY_SPELLING, REPORTS
from stallwise.plans.row_rules import DELIVERED, NEVER_COMPLETED
from stallwise.sources import testbed as given

FOLDER = str(TESTDATA / "sf0.001")


def rows(df):
    return [tuple(row) for row in df.collect()]


def test_one_spelling(spark):
    given = ["São Paulo", "SAO PAULO", "sa\u0303o paulo", "", " Ab ", None, "ÀÉÎÕÜÇÑ ŠŽ Ệ", "日本", "straße", "\u0130"]
    found = spark.createDataFrame([(t,) for t in given], "t string").select(one_spelling("t").alias("t"))
    expected = ["sao paulo"] * 3 + ["", " ab ", None, "aeioucn sz e", "日本", "straße", "i"]
    assert [t for (t,) in rows(found)] == expected


def test_fixed_labels_are_in_that_spelling(spark):
    labels = [DELIVERED, *NEVER_COMPLETED, revenue.UNDEFINED_PAYMENT, revenue.CREDIT_CARD]
    found = spark.createDataFrame([(t,) for t in labels], "t string").select(one_spelling("t"))
    assert [t for (t,) in rows(found)] == labels


def test_filters_lists_groups_and_joins(spark):
    m = marketplace(
        spark,
        unique=["orders"],
        orders=[
            order("A1", status="Delivered"),
            order("b2", status="délivered"),
            order("c3", status="CANCELLED", arrival="2018-01-02"),
            order("d4", status="Unavailable", arrival="2018-01-02"),
            order("e5", status=None, arrival="2018-01-02"),
        ],
        order_items=[item("a1"), item("B2"), item("x9")],
        order_payments=[
            payment("a1", "Credit_Card", 2),
            payment("B2", "CREDIT_CARD", 3),
            payment("b2", "Not_Defined", 7),
            payment("A1", "voucher", 1),
        ],
    )
    spelled = m.any_spelling()
    assert rows(REPORTS["cancelled_with_delivery_date_any_spelling"](m)) == [(2,)]
    assert rows(orders_audit.cancelled_with_delivery_date(m)) == [(0,)]
    assert sorted(rows(orders_audit.cancelled_with_delivery_by_status(spelled))) == [("cancelled", 1), ("unavailable", 1)]
    assert rows(orders_audit.order_status_distribution(spelled))[0] == ("delivered", 2)
    assert rows(orders_audit.items_orphan_order(spelled)) == [(1,)]
    assert rows(revenue.payment_type_revenue(spelled)) == [("credit_card", 2, 5.0, 2.5, 83.33), ("voucher", 1, 1.0, 1.0, 16.67)]
    assert rows(revenue.installment_profile(spelled)) == [(1, 2, 5.0, 2.5)]
    assert rows(revenue.payment_type_revenue(m)) == []
    assert m.is_unique("orders") and not spelled.is_unique("orders")


def test_keys_that_differ_in_spelling_are_repeated(spark):
    m = marketplace(spark, orders=[order("A1"), order("a1"), order("Á1"), order("b")]).any_spelling()
    assert rows(orders_audit.orders_duplicate_key(m)) == [("a1", 3)]


def test_comments_stay(spark):
    m = marketplace(spark, order_reviews=[{"review_id": "R", "order_id": "O", "review_comment_message": "Muito BOM"}])
    row = m.any_spelling().order_reviews.first()
    assert (row.review_id, row.review_comment_message) == ("r", "Muito BOM")


def test_filters_on_other_columns_still_reach_the_scan(spark, tmp_path):
    marketplace(spark, order_items=[item("a")]).order_items.write.parquet(f"{tmp_path}/order_items")
    items = Marketplace.from_folder(spark, str(tmp_path)).any_spelling().order_items
    plan = items.filter(F.col("order_item_id") > 5).select("product_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(order_item_id,5)" in plan and "BatchEvalPython" not in plan
    assert "seller_id" not in plan


def respelled(table):
    """Every label in a spelling that hangs on its row."""
    texts = [f.name for f in table.schema if isinstance(f.dataType, T.StringType) and f.name != "review_comment_message"]
    accent = lambda c: F.translate(c, "aeiou", "áéíóú")
    turn = F.pmod(F.xxhash64(*table.columns), F.lit(3))
    return table.withColumns({c: F.when(turn == 0, F.upper(c)).when(turn == 1, accent(F.col(c))).otherwise(F.col(c)) for c in texts})


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", ANY_SPELLING)
def test_spelling_does_not_matter(spark, duck, name):
    """Tables with labels in mixed spellings give what SQL gives over the plain ones."""
    plain = given.testbed(spark, FOLDER)
    names = ("orders", "order_payments", "products", "category_translation", "customers")
    mixed = plain.replace(**{n: respelled(getattr(plain, n)) for n in names})
    report = REPORTS[f"{name}_any_spelling"](mixed)
    decimals = [column for column, kind in report.dtypes if kind.startswith("decimal")]
    report = report.withColumns({column: report[column].cast("double") for column in decimals})
    assert difference(report, duck, contract.oracle_sql()[f"{name}_any_spelling"]) is None
