from market import customer, item, marketplace, only, order, payment, product, rows, translation

from stallwise.plans import revenue
from stallwise.plans.catalog import run_report


def test_order_with_two_payments_counts_once(spark):
    m = marketplace(
        spark,
        orders=[order("a"), order("b"), order("late", status="shipped")],
        customers=[customer("c1")],
        order_payments=[
            payment("a", "voucher", 10),
            payment("a", "credit_card", 20, installments=2),
            payment("b", "boleto", 5),
            payment("b", "not_defined", 100),
            payment("b", None, 100),
            payment("late", value=100),
            payment("unknown", value=100),
        ],
    )
    assert rows(run_report("monthly_gmv", m)) == [(2018, 1, 2, 35.0, 17.5)]
    assert rows(run_report("state_revenue", m)) == [("SP", 2, 35.0, 11.67, 100.0)]
    assert rows(revenue.state_revenue(m, per_order=True)) == [("SP", 2, 35.0, 17.5, 100.0)]
    assert rows(run_report("installment_profile", m)) == [(2, 1, 20.0, 20.0)]
    assert rows(run_report("payment_type_revenue", m)) == [
        ("credit_card", 1, 20.0, 20.0, 57.14),
        ("voucher", 1, 10.0, 10.0, 28.57),
        ("boleto", 1, 5.0, 5.0, 14.29),
    ]


def test_halves_round_away_from_zero(spark):
    m = marketplace(
        spark, orders=[order("a"), order("b")], order_payments=[payment("a", value=1.0), payment("b", value=1.01)]
    )
    assert only(run_report("monthly_gmv", m))[4] == 1.01
    back = marketplace(
        spark, orders=[order("a"), order("b")], order_payments=[payment("a", value=-1.0), payment("b", value=-1.01)]
    )
    assert only(run_report("monthly_gmv", back))[4] == -1.01


def copies_market(spark, unique=()):
    """Copies of orders, customers, products and translations, one order in two states."""
    return marketplace(
        spark,
        unique,
        orders=[order("a", "c1"), order("a", "c1"), order("a", "c2"), order("b", "c2"), order("b", "c2", purchase="2018-02-01")],
        customers=[customer("c1"), customer("c1"), customer("c1", state="RJ"), customer("c2")],
        order_payments=[payment("a", value=1), payment("a", value=2), payment("b", value=4), payment("b", value=None)],
        order_items=[item("a", price=1), item("a", 2, "p2", price=2), item("b", product="p1", price=None)],
        products=[product("p1", "x"), product("p1", "x"), product("p1", "y"), product("p2", None)],
        category_translation=[translation("x", "X"), translation("x", "X"), translation("x", "Y")],
    )


def test_copies_multiply_sums_but_not_distinct_orders(spark):
    """Figures follow the plain joins: every copy joins every copy."""
    m = copies_market(spark)
    assert rows(run_report("monthly_gmv", m)) == [(2018, 1, 2, 13.0, 6.5), (2018, 2, 1, 4.0, 4.0)]
    # SP: order a twice via c1, each with two copies of c1, and once via c2; order b twice.
    assert rows(run_report("state_revenue", m)) == [("SP", 2, 23.0, 1.92, 79.31), ("RJ", 1, 6.0, 1.5, 20.69)]
    # p1 has two copies in x (X twice, Y once) and one in y; order a has three copies.
    assert sorted(rows(run_report("category_revenue", m))) == [
        ("Uncategorized", 2, 9.0, 1.5, 4.5),
        ("X", 2, 12.0, 1.0, 6.0),
        ("Y", 2, 6.0, 1.0, 3.0),
    ]


def test_unique_tables_give_the_same_reports(spark):
    tables = dict(
        orders=[order("a"), order("b", "c2", purchase="2018-02-03 04:05:06"), order("c", "c2")],
        customers=[customer("c1", "u", "SP"), customer("c2", "u", "RJ")],
        order_payments=[payment("a", value=1), payment("a", "voucher", 2), payment("b", value=4), payment("c", value=9)],
        order_items=[item("a", price=1), item("b", product="p2", price=2), item("b", 2, price=7)],
        products=[product("p1", "x"), product("p2")],
        category_translation=[translation("x", "X")],
    )
    plain = marketplace(spark, **tables)
    audited = plain.audited()
    assert all(audited.is_unique(t) for t in ("orders", "customers", "products", "category_translation"))
    copied = copies_market(spark).audited()
    assert not any(copied.is_unique(t) for t in ("orders", "customers", "products", "category_translation"))
    for name in (
        "monthly_gmv", "category_revenue", "payment_type_revenue", "installment_profile", "state_revenue",
        "day_of_week_profile", "hour_of_day_profile", "mom_growth", "rfm_base",
    ):
        assert sorted(rows(run_report(name, plain))) == sorted(rows(run_report(name, audited))), name


def test_uncategorized_collects_null_and_untranslated(spark):
    m = marketplace(
        spark,
        orders=[order("a"), order("b")],
        order_items=[item("a", product="p1", price=3), item("b", product="p2", price=4), item("b", 2, "gone", price=50)],
        products=[product("p1", None), product("p2", "unknown")],
        category_translation=[translation("x", "X")],
    )
    assert rows(run_report("category_revenue", m)) == [("Uncategorized", 2, 7.0, 3.5, 3.5)]


def test_day_and_hour(spark):
    m = marketplace(
        spark,
        orders=[order("a", purchase="2017-11-27 23:59:59"), order("b", purchase="2017-11-26 00:00:00")],
        order_payments=[payment("a", value=2), payment("b", value=3)],
    )
    assert rows(run_report("day_of_week_profile", m)) == [("Sunday", 1, 1, 3.0), ("Monday", 2, 1, 2.0)]
    assert rows(run_report("hour_of_day_profile", m)) == [(0, 1, 3.0), (23, 1, 2.0)]


def test_growth_uses_the_previous_row_and_survives_zero(spark):
    months = {"2018-01-05": 100, "2018-03-05": 150, "2018-04-05": 0, "2018-05-05": 10}
    m = marketplace(
        spark,
        orders=[order(day, purchase=day) for day in months],
        order_payments=[payment(day, value=value) for day, value in months.items()],
    )
    assert rows(run_report("mom_growth", m)) == [
        (2018, 1, 100.0, None, None),
        (2018, 3, 150.0, 100.0, 50.0),
        (2018, 4, 0.0, 150.0, -100.0),
        (2018, 5, 10.0, 0.0, None),
    ]
    assert rows(revenue.mom_growth(m, by_calendar=True))[1:3] == [
        (2018, 2, None, 100.0, None),
        (2018, 3, 150.0, None, None),
    ]


def test_unknown_purchase_month_comes_first(spark):
    m = marketplace(
        spark,
        orders=[order("a", purchase=None), order("b")],
        order_payments=[payment("a", value=2), payment("b", value=3)],
    )
    expected = [(None, None, 2.0, None, None), (2018, 1, 3.0, 2.0, 50.0)]
    assert rows(run_report("mom_growth", m)) == expected
    assert rows(revenue.mom_growth(m, by_calendar=True)) == expected


def test_status_case(spark):
    m = marketplace(spark, orders=[order("a", status="DELIVERED")], order_payments=[payment("a", value=2)])
    assert rows(run_report("monthly_gmv", m)) == []
    assert rows(revenue.monthly_gmv(m, ignore_case=True)) == [(2018, 1, 1, 2.0, 2.0)]


def test_empty_marketplace(spark):
    m = marketplace(spark)
    for name in ("monthly_gmv", "category_revenue", "payment_type_revenue", "state_revenue", "mom_growth"):
        assert rows(run_report(name, m)) == []
