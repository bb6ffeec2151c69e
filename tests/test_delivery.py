from __future__ import annotations

from market import customer, item, marketplace, only, order, product, review, rows

from stallwise.plans import delivery
from stallwise.plans.catalog import run_report


def delivered(order_id, arrival, promise="2018-01-10 00:00:00", carrier="2018-01-02", **more):
    return order(order_id, arrival=arrival, promise=promise, carrier=carrier, **more)


LATENESS = [
    delivered("exact", "2018-01-10 00:00:00"),
    delivered("same day", "2018-01-10 00:00:01"),
    delivered("+1", "2018-01-11"),
    delivered("+7", "2018-01-17"),
    delivered("+8", "2018-01-18"),
    delivered("+14", "2018-01-24"),
    delivered("+15", "2018-01-25"),
]


def test_lateness_bands(spark):
    m = marketplace(spark, orders=LATENESS, order_reviews=[review(o["order_id"], o["order_id"]) for o in LATENESS])
    plain = {r[0]: r[1] for r in rows(run_report("punctuality_vs_review", m))}
    assert plain == {"On Time": 1, "Late (1-7 days)": 2, "Late (8-14 days)": 2, "Late (15+ days)": 2}
    moved = {r[0]: r[1] for r in rows(delivery.punctuality_vs_review(m, same_day_is_first_band=True))}
    assert moved == {"On Time": 1, "Late (1-7 days)": 3, "Late (8-14 days)": 2, "Late (15+ days)": 1}


def test_review_weights(spark):
    m = marketplace(
        spark,
        orders=[delivered("a", "2018-01-05"), delivered("b", "2018-01-05"), delivered("unreviewed", "2018-01-05")],
        order_reviews=[
            review("1", "a", 5, created="2018-02-01"),
            review("2", "a", 2, created="2018-02-02"),
            review("3", "b", 4),
            review("4", "b", None, created="2018-01-31"),
        ],
    )
    assert rows(run_report("punctuality_vs_review", m)) == [("On Time", 2, 3.67, 50.0, 25.0)]
    assert rows(delivery.punctuality_vs_review(m, latest_only=True)) == [("On Time", 2, 3.0, 50.0, 50.0)]


def test_which_deliveries_count(spark):
    m = marketplace(
        spark,
        orders=[
            delivered("fine", "2018-01-05"),
            delivered("no carrier", "2018-01-05", carrier=None),
            delivered("no arrival", None),
            delivered("no promise", "2018-01-05", promise=None),
            delivered("arrived before purchase", "2017-12-31"),
            delivered("carried before purchase", "2018-01-05", carrier="2017-12-31"),
            delivered("not delivered", "2018-01-05", status="shipped"),
            delivered("arrived before handover", "2018-01-04", carrier="2018-01-05"),
        ],
    )
    assert only(run_report("delivery_overall", m)) == (2, 9.0, 3.5, -5.5, 100.0)
    assert only(delivery.delivery_overall(m, full_sequence=True)) == (1, 9.0, 4.0, -5.0, 100.0)
    assert [r[0] for r in rows(delivery.valid_delivery_rows(m))] == ["fine"]


def test_overall_of_nothing(spark):
    assert only(run_report("delivery_overall", marketplace(spark))) == (0, None, None, None, None)


def test_slowest_states_share_a_rank(spark):
    m = marketplace(
        spark,
        orders=[
            delivered("a", "2018-01-11", customer="x"),
            delivered("b", "2018-01-10", customer="y"),
            delivered("c", "2018-01-12", customer="y"),
            delivered("d", "2018-01-03", customer="z"),
        ],
        customers=[customer("x", state="AM"), customer("y", state="RR"), customer("z", state="SP")],
    )
    ranks = {r["customer_state"]: r["slowest_rank"] for r in run_report("delivery_by_state", m).collect()}
    assert ranks == {"AM": 1, "RR": 1, "SP": 3}


def test_copies_of_an_order_weigh_twice_but_count_once(spark):
    slow, fast = delivered("a", "2018-01-11"), delivered("b", "2018-01-05")
    m = marketplace(
        spark,
        orders=[slow, slow, fast],
        customers=[customer("c1")],
        order_items=[item("a", freight=10), item("a", 2, freight=20), item("b", freight=5)],
        order_reviews=[review("1", "a", 1), review("2", "b", 5)],
    )
    assert only(run_report("delivery_overall", m)) == (2, 9.0, 8.0, -1.0, 33.33)
    assert rows(run_report("monthly_on_time", m)) == [(2018, 1, 2, 8.0, 33.33)]
    assert rows(run_report("delivery_by_state", m)) == [("SP", 2, 9.0, 8.0, -1.0, 33.33, 1)]
    assert rows(run_report("freight_vs_speed", m)) == [("1-20 BRL", 2, 13.0, 8.8, 20.0)]
    assert rows(run_report("punctuality_vs_review", m)) == [
        ("On Time", 1, 5.0, 100.0, 0.0),
        ("Late (1-7 days)", 1, 1.0, 0.0, 100.0),
    ]


def test_freight_bands(spark):
    values = [0, 0.5, 1, 20, 20.5, 21, 80, 80.01, None, -1]
    m = marketplace(
        spark,
        orders=[delivered(str(v), "2018-01-05") for v in values],
        order_items=[item(str(v), freight=v) for v in values],
    )
    assert {r[0]: r[1] for r in rows(run_report("freight_vs_speed", m))} == {
        "Free": 1,
        "1-20 BRL": 2,
        "21-40 BRL": 1,
        "61-80 BRL": 1,
        "80+ BRL": 5,
    }
    assert {r[0]: r[1] for r in rows(delivery.freight_vs_speed(m, without_gaps=True))} == {
        "Free": 1,
        "1-20 BRL": 3,
        "21-40 BRL": 2,
        "61-80 BRL": 1,
        "80+ BRL": 1,
        "Unknown": 2,
    }


def test_freight_of_weighed_products(spark):
    m = marketplace(
        spark,
        orders=[delivered("a", "2018-01-05")],
        order_items=[item("a", i, p, freight=i) for i, p in enumerate(["heavy", "void", "gone", "unweighed"], 1)],
        products=[product("heavy", product_weight_g=5), product("heavy", product_weight_g=6),
                  product("void", product_weight_g=0), product("unweighed")],
    )
    assert rows(delivery.freight_vs_speed(m, weighed_only=True)) == [("1-20 BRL", 1, 1.0, 4.0, 100.0)]


def test_unique_tables_give_the_same_reports(spark):
    m = marketplace(
        spark,
        orders=[*LATENESS, delivered("other", "2018-01-05", customer="c2")],
        customers=[customer("c1"), customer("c2", state="RJ")],
        order_items=[item("exact", freight=5), item("+1", freight=30), item("+1", 2, freight=30), item("other", freight=0)],
        order_reviews=[review("1", "exact", 5), review("2", "+8", 1), review("3", "+8", 2), review("4", "other", 3)],
    )
    audited = m.audited()
    assert audited.is_unique("orders") and audited.is_unique("customers")
    for name in ("delivery_overall", "delivery_by_state", "punctuality_vs_review", "monthly_on_time", "freight_vs_speed"):
        assert sorted(rows(run_report(name, m))) == sorted(rows(run_report(name, audited))), name
