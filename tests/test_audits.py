from market import at, customer, item, marketplace, only, order, payment, product, review, rows, translation  # noqa: F401

from stallwise.plans import feedback_audit, orders_audit, products_audit
from stallwise.plans.catalog import run_report


def test_null_counts_and_empty_tables(spark):
    m = marketplace(spark, orders=[order("a"), order(None, customer=None)], order_items=[item("a", price=None)])
    assert only(run_report("orders_null_audit", m)) == (1, 1, 0, 0, 2, 2, 2, 2)
    assert only(run_report("items_null_audit", m)) == (0, 0, 0, 1, 0)
    assert only(run_report("payments_null_audit", m)) == (None,) * 4
    assert only(run_report("review_null_comments", m)) == (None, 0)


def test_date_sequence(spark):
    day = "2018-01-{:02d}".format
    m = marketplace(
        spark,
        orders=[
            order("early carrier", purchase=day(5), carrier=day(4), arrival=day(6)),
            order("early arrival", purchase=day(5), carrier=day(7), arrival=day(6)),
            order("both", purchase=day(5), carrier=day(4), arrival=day(3)),
            order("unknown arrival", purchase=day(5), carrier=day(4)),
            order("fine", purchase=day(5), carrier=day(5), arrival=day(5)),
        ],
    )
    assert only(run_report("orders_date_sequence_violations", m)) == (3,)


def test_approval_and_estimate(spark):
    noon = "2018-01-01 12:00:00"
    m = marketplace(
        spark,
        orders=[
            order("early", purchase=noon, approved="2018-01-01 11:59:59", promise="2018-01-01 00:00:00"),
            order("equal", purchase=noon, approved=noon, promise=noon),
            order("never", purchase=noon),
        ],
    )
    assert only(run_report("approval_before_purchase", m)) == (1,)
    assert only(run_report("estimate_before_purchase", m)) == (1,)
    assert [r[0] for r in rows(run_report("approvals_in_order", m))] == ["equal"]


def test_status_consistency(spark):
    m = marketplace(
        spark,
        orders=[
            order("a", status="delivered"),
            order("b", status="Delivered"),
            order("c", status="unavailable", arrival="2018-01-02"),
            order("d", status="cancelled", arrival="2018-01-02"),
            order("e", status="cancelled"),
            order("f", status="cancelled"),
            order("g", status=None, arrival="2018-01-02"),
        ],
    )
    assert only(run_report("delivered_missing_date", m)) == (1,)
    assert only(orders_audit.delivered_missing_date(m, ignore_case=True)) == (2,)
    assert only(run_report("cancelled_with_delivery_date", m)) == (2,)
    assert sorted(rows(run_report("cancelled_with_delivery_by_status", m))) == [("cancelled", 1), ("unavailable", 1)]
    assert rows(run_report("order_status_distribution", m))[0] == ("cancelled", 3)
    single = run_report("orders_rule_audit", m).first().asDict()
    for name in ("delivered_missing_date", "cancelled_with_delivery_date", "orders_date_sequence_violations"):
        assert run_report(name, m).first().asDict().items() <= single.items()


def test_orphans(spark):
    m = marketplace(
        spark,
        orders=[order("a"), order("ghost"), order("ghost"), order(None)],
        order_items=[
            item("a"),
            item("a", product="p2"),
            item("x", product="nope", seller="nope"),
            item("x"),
            item(None, product=None, seller=None),
        ],
        products=[product("p1"), product("p2"), product("unsold"), product(None)],
        sellers=[{"seller_id": "s1"}],
    )
    assert only(run_report("ghost_orders", m)) == (3,)
    assert only(run_report("items_orphan_order", m)) == (3,)
    assert only(run_report("items_orphan_product", m)) == (2,)
    assert only(run_report("items_orphan_seller", m)) == (2,)
    assert only(run_report("unsold_products", m)) == (2,)
    whole = marketplace(spark, orders=[order("a")], order_items=[item("a")])
    assert only(run_report("ghost_orders", whole)) == (0,)


def test_duplicates_and_free_shipping(spark):
    m = marketplace(
        spark,
        orders=[order("a"), order("a"), order("b")],
        order_items=[item("a", 1, freight=0), item("a", 1), item("a", 2)],
        products=[product("p"), product("p")],
    )
    assert rows(run_report("orders_duplicate_key", m)) == [("a", 2)]
    assert rows(run_report("items_duplicate_composite_key", m)) == [("a", 1, 2)]
    assert rows(run_report("products_duplicate_key", m)) == [("p", 2)]
    assert only(run_report("free_shipping_share", m)) == (1, 3, 33.33)
    assert only(run_report("free_shipping_share", marketplace(spark))) == (None, 0, None)


def test_prices(spark):
    m = marketplace(spark, order_items=[item("a", price=p) for p in (0, -1, 0.01, None)])
    assert only(run_report("items_invalid_price", m)) == (2,)


def test_categories(spark):
    m = marketplace(
        spark,
        products=[product(f"p{i}", c) for i, c in enumerate([None, "", " ", "  ", "\t", "toys", "toys", "books"])],
        category_translation=[translation("books", "Books"), translation("", " "), translation(None, None)],
    )
    assert only(run_report("products_empty_category", m)) == (2,)
    assert only(products_audit.products_empty_category(m, any_whitespace=True)) == (4,)
    assert sorted(rows(run_report("untranslated_categories", m))) == [("\t",), (" ",), ("  ",), ("toys",)]
    assert only(run_report("translation_empty_english", m)) == (2,)
    assert only(run_report("translation_empty_source", m)) == (2,)


def test_upsert_twice_is_upsert_once(spark):
    m = marketplace(spark, category_translation=[translation("pc_gamer", "Already here"), translation("a", "A")])
    once = products_audit.category_translation_upsert(m)
    twice = products_audit.category_translation_upsert(m.replace(category_translation=once))
    assert sorted(rows(once)) == sorted(rows(twice))
    assert once.count() == 3
    assert ("pc_gamer", "Already here") in rows(run_report("verify_translation_upsert", m))
    fresh = marketplace(spark)
    assert sorted(rows(run_report("verify_translation_upsert", fresh))) == sorted(products_audit.NEW_TRANSLATIONS)


def test_dimensions(spark):
    weights = [product(f"w{w}", product_weight_g=w) for w in (-1, 0, 1, None, 100000, 100001)]
    sides = [product(f"s{s}", product_length_cm=s) for s in (200, 201)]
    m = marketplace(spark, products=weights + sides)
    assert only(run_report("products_invalid_dimensions", m)) == (2, 0, 0, 0)
    assert only(run_report("products_extreme_dimensions", m)) == (2,)
    assert only(run_report("products_null_dimensions", m)) == (3, 6, 8, 8)


def test_review_scores(spark):
    m = marketplace(spark, order_reviews=[review(f"r{s}", "o", score=s) for s in (None, 0, 1, 5, 6)])
    assert only(run_report("review_score_validation", m)) == (0, 2)
    assert only(feedback_audit.review_score_validation(m, all_rows=True)) == (1, 2)
    valid = marketplace(spark, order_reviews=[review("a", "o", 1), review("b", "o", 5)])
    assert only(run_report("review_score_validation", valid)) == (None, 0)


def test_review_ids(spark):
    m = marketplace(
        spark, order_reviews=[review("x", o) for o in "abc"] + [review("y", "a"), review("y", "a"), review("z", "a")]
    )
    assert only(run_report("review_duplicate_rows", m)) == (3,)
    assert rows(run_report("review_id_collisions_topk", m)) == [("x", 3), ("y", 1)]
    assert only(run_report("review_duplicate_rows", marketplace(spark, order_reviews=[review("x", "a")]))) == (None,)


def test_comments(spark):
    m = marketplace(spark, order_reviews=[review(str(i), "o", comment=c) for i, c in enumerate([None, "", " ", "\n", "x"])])
    assert only(run_report("review_null_comments", m)) == (1, 5)
    assert only(run_report("review_empty_comments", m)) == (2,)
    assert only(feedback_audit.review_empty_comments(m, any_whitespace=True)) == (3,)
    assert run_report("reviews_with_text", m).count() == 3


def test_latest_review(spark):
    m = marketplace(
        spark,
        order_reviews=[
            review("old", "o", created="2018-01-01"),
            review("new", "o", created="2018-01-02"),
            review("b", "tie"),
            review("a", "tie"),
            review("undated", "p", created=None),
            review("dated", "p"),
        ],
    )
    assert {r["order_id"]: r["review_id"] for r in feedback_audit.latest_reviews(m).collect()} == {
        "o": "new",
        "tie": "a",
        "p": "dated",
    }


def test_payments(spark):
    m = marketplace(
        spark,
        order_payments=[
            payment("a", "voucher", 0),
            payment("b", "not_defined", 0),
            payment("c", value=-1),
            payment("c", value=1.5),
            payment("d", "voucher", 2),
            payment("d", "credit_card", 3),
            payment("e", None, None),
            payment("e", "boleto", 1),
        ],
    )
    assert only(run_report("payments_invalid_value", m)) == (3,)
    assert sorted(r[1] for r in rows(run_report("payments_zero_rows", m))) == ["not_defined", "voucher"]
    assert only(run_report("split_payment_orders", m)) == (1,)
    assert dict(rows(run_report("payment_type_distribution", m)))["credit_card"] == 3
    totals = dict(rows(run_report("order_payment_totals", m)))
    assert (totals["c"], totals["d"], totals["e"]) == (0.5, 5.0, 1.0)
