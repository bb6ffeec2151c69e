from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from market import item, marketplace, order, payment, product, rows, translation

from stallwise import Marketplace
from stallwise.plans.catalog import run_report
from stallwise.plans.products_audit import category_translation_upsert
from stallwise.sources.schemas import SCHEMAS
from stallwise.sources.sinks import versions_folder, write_reference_version, write_report

ORDERS_CSV = """order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,\
order_delivered_customer_date,order_estimated_delivery_date
a,c1,delivered,2017-10-02 10:56:33,2017-10-02 11:07:15,{blank},2017-10-10 21:25:13,2017-10-18 00:00:00
"""


def store(m, folder):
    for name in SCHEMAS:
        getattr(m, name).write.parquet(f"{folder}/{name}")


def test_parquet_folder(spark, tmp_path):
    m = marketplace(spark, orders=[order("a"), order("b")], order_payments=[payment("a", value=1.5)])
    store(m, tmp_path)
    stored = Marketplace.from_folder(spark, str(tmp_path))
    assert stored.order_payments.schema == SCHEMAS["order_payments"]
    assert rows(run_report("monthly_gmv", stored)) == [(2018, 1, 1, 1.5, 1.5)]
    stored.register_views()
    assert spark.sql("SELECT count(*) FROM orders").first()[0] == 2
    assert rows(run_report("ghost_orders", Marketplace.from_catalog(spark))) == [(2,)]


def test_csv(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(ORDERS_CSV.format(blank=""))
    row = Marketplace.from_folder(spark, str(tmp_path), "csv").orders.first()
    assert row["order_purchase_timestamp"] == datetime(2017, 10, 2, 10, 56, 33)
    assert row["order_delivered_carrier_date"] is None


def test_impossible_dates(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(ORDERS_CSV.format(blank="0000-00-00 00:00:00"))
    with pytest.raises(Exception, match="not a timestamp"):
        Marketplace.from_folder(spark, str(tmp_path), "csv").orders.collect()
    row = Marketplace.from_folder(spark, str(tmp_path), "csv", blank_as_null=True).orders.first()
    assert row["order_delivered_carrier_date"] is None
    assert row["order_delivered_customer_date"] == datetime(2017, 10, 10, 21, 25, 13)


def test_comments_over_several_lines(spark, tmp_path):
    (tmp_path / "order_reviews.csv").write_text(
        "review_id,order_id,review_score,review_comment_message,review_creation_date\n"
        'r1,a,5,"said ""good""\nand meant it",2018-01-01 00:00:00\n'
        'r2,b,4,"   ",2018-01-01 00:00:00\n'
    )
    found = Marketplace.from_folder(spark, str(tmp_path), "csv", multi_line=True).order_reviews.collect()
    assert [r["review_comment_message"] for r in found] == ['said "good"\nand meant it', "   "]
    lenient = Marketplace.from_folder(spark, str(tmp_path), "csv", multi_line=True, blank_as_null=True)
    assert [r["review_score"] for r in lenient.order_reviews.collect()] == [5, 4]
    assert lenient.order_reviews.collect()[1]["review_comment_message"] is None


REVIEWS_CSV = "review_id,order_id,review_score,review_comment_message,review_creation_date\n"


def test_line_break_without_multi_line_fails(spark, tmp_path):
    (tmp_path / "order_reviews.csv").write_text(
        REVIEWS_CSV + 'r1,a,5,"said ""good""\nand meant it",2018-01-01 00:00:00\n'
    )
    for lenient in (False, True):
        with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
            Marketplace.from_folder(spark, str(tmp_path), "csv", blank_as_null=lenient).order_reviews.collect()


ITEMS_CSV = """seller_id,note,price,shipping_limit_date,freight_value,order_item_id,product_id,order_id
s,extra,19.99,2018-01-01 00:00:00,{freight},1,p,a
"""


@pytest.mark.parametrize("lenient", [False, True])
def test_csv_columns_are_found_by_name(spark, tmp_path, lenient):
    (tmp_path / "order_items.csv").write_text(ITEMS_CSV.format(freight="0.29"))
    found = Marketplace.from_folder(spark, str(tmp_path), "csv", blank_as_null=lenient).order_items
    assert found.schema == SCHEMAS["order_items"]
    assert rows(found) == [("a", 1, "p", "s", Decimal("19.99"), Decimal("0.29"))]


def test_missing_column(spark, tmp_path):
    (tmp_path / "sellers.csv").write_text("seller\ns\n")
    with pytest.raises(ValueError, match="seller_id"):
        Marketplace.from_folder(spark, str(tmp_path), "csv").sellers


@pytest.mark.parametrize("value", ["12x", "1.999", "1e30", "x"])
@pytest.mark.parametrize("lenient", [False, True])
def test_values_that_do_not_fit_fail(spark, tmp_path, value, lenient):
    (tmp_path / "order_items.csv").write_text(ITEMS_CSV.format(freight=value))
    tables = Marketplace.from_folder(spark, str(tmp_path), "csv", blank_as_null=lenient)
    with pytest.raises(Exception, match="not a decimal"):
        tables.order_items.collect()


def test_dates_that_do_not_exist_fail(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(ORDERS_CSV.format(blank="2018-02-30 00:00:00"))
    with pytest.raises(Exception, match="not a timestamp"):
        Marketplace.from_folder(spark, str(tmp_path), "csv", blank_as_null=True).orders.collect()


def test_doubles_and_numbers_from_a_catalog(spark, tmp_path):
    paid = spark.sql(
        "SELECT cast(id AS int) AS order_id, 'boleto' AS payment_type, cast(element_at(array(0.29D, 19.99D, 1.15D), id + 1) AS double)"
        " AS payment_value, 1L AS payment_installments, 'more' AS further FROM (SELECT cast(id AS int) AS id FROM range(3))"
    )
    m = marketplace(spark, orders=[order("0"), order("1"), order("2")])
    frames = {name: getattr(m, name) for name in SCHEMAS} | {"order_payments": paid}
    expected = [(2018, 1, 3, 21.43, 7.14)]
    assert rows(run_report("monthly_gmv", Marketplace.from_frames(frames))) == expected
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    catalog = Marketplace.from_catalog(spark)
    assert catalog.order_payments.dtypes == [(f.name, f.dataType.simpleString()) for f in SCHEMAS["order_payments"]]
    assert rows(run_report("monthly_gmv", catalog)) == expected
    store(Marketplace.from_frames(frames), tmp_path / "parquet")
    assert rows(run_report("monthly_gmv", Marketplace.from_folder(spark, str(tmp_path / "parquet")))) == expected
    (tmp_path / "orders.csv").write_text(
        ORDERS_CSV.split("a,c1")[0] + "".join(f"{i},c1,delivered,2018-01-01 00:00:00,,,,\n" for i in range(3))
    )
    (tmp_path / "order_payments.csv").write_text(
        "payment_value,order_id,payment_installments,payment_type\n0.29,0,1,boleto\n19.99,1,1,boleto\n1.15,2,1,boleto\n"
    )
    assert rows(run_report("monthly_gmv", Marketplace.from_folder(spark, str(tmp_path), "csv"))) == expected


def test_overflow_fails(spark):
    paid = [payment("a", value="9000000000000000.00") for _ in range(12)]
    m = marketplace(spark, orders=[order("a")], order_payments=paid)
    with pytest.raises(Exception, match="OVERFLOW"):
        run_report("monthly_gmv", m).collect()


def test_a_stored_version_is_read_back(spark, tmp_path):
    m = marketplace(
        spark,
        orders=[order("a")], order_items=[item("a", product="p")], products=[product("p", "pc_gamer")],
        category_translation=[translation("x", "X"), translation(None, "nothing")],
    )
    store(m, tmp_path)
    before = Marketplace.from_folder(spark, str(tmp_path))
    assert [r["category"] for r in run_report("category_revenue", before).collect()] == ["Uncategorized"]
    write_reference_version(category_translation_upsert(before), versions_folder(str(tmp_path), "category_translation"), 2)
    after = Marketplace.from_folder(spark, str(tmp_path), versions={"category_translation": 2})
    assert [r["category"] for r in run_report("category_revenue", after).collect()] == ["PC Gamer"]
    assert [r["category"] for r in run_report("category_revenue_after_upsert", before).collect()] == ["PC Gamer"]
    assert sorted(rows(category_translation_upsert(after)), key=str) == sorted(rows(after.category_translation), key=str)


def test_upsert_of_null_and_repeated_keys(spark):
    m = marketplace(spark, category_translation=[translation("a", "A")])
    added = ((None, "nothing"), ("b", "B"), ("b", "B"))
    once = category_translation_upsert(m, added)
    assert sorted(rows(once), key=str) == sorted([("a", "A"), (None, "nothing"), ("b", "B")], key=str)
    twice = category_translation_upsert(m.replace(category_translation=once), added)
    assert sorted(rows(twice), key=str) == sorted(rows(once), key=str)
    with pytest.raises(Exception, match="conflicting rows"):
        category_translation_upsert(m, (("b", "B"), ("b", "C"))).collect()


def test_sinks_never_overwrite(spark, tmp_path):
    m = marketplace(spark, category_translation=[translation("a", "A")])
    report = run_report("translation_empty_english", m)
    write_report(report, f"{tmp_path}/report")
    write_report(report, f"{tmp_path}/report_csv", "csv")
    with pytest.raises(Exception, match="(?i)exists"):
        write_report(report, f"{tmp_path}/report")
    path = write_reference_version(category_translation_upsert(m), f"{tmp_path}/translation", 2)
    assert spark.read.parquet(path).count() == 3
    assert spark.read.option("header", True).csv(f"{tmp_path}/report_csv").columns == ["empty_english_translations"]


def test_unknown_names(spark):
    m = marketplace(spark)
    with pytest.raises(AttributeError):
        m.nothing
    with pytest.raises(ValueError):
        Marketplace.from_frames({}, unique=["order_reviews"])
    with pytest.raises(ValueError):
        Marketplace.from_folder(spark, "/nowhere", "orc").orders
