from __future__ import annotations

from datetime import datetime
from itertools import product as pairs

from market import customer, marketplace, only, order, payment, rows
from pyspark.sql import functions as F

from stallwise.functions.bands import customer_segment
from stallwise.plans.catalog import run_report


def expected_segment(r, f, m):
    if f == 5 and (r, m) in {(5, 5), (5, 4), (4, 5)}:
        return "Champion"
    if r >= 4:
        if f >= 4:
            return "Loyal Customer"
        if f == 3:
            return "Potential Loyalist"
        return "New Customer" if r == 5 else "Promising"
    if r == 3:
        return "Promising" if f <= 2 else "Others"
    if f == 1:
        return "Lost" if r == 1 else "Others"
    return "At Risk" if f >= 4 else "Needs Attention"


def test_every_score_combination(spark):
    cube = list(pairs(range(1, 6), repeat=3))
    df = spark.createDataFrame(cube, "r bigint, f bigint, m bigint")
    found = {tuple(row)[:3]: row["segment"] for row in df.withColumn("segment", customer_segment("r", "f", "m")).collect()}
    assert found == {scores: expected_segment(*scores) for scores in cube}


def test_base_counts_persons_not_order_customers(spark):
    m = marketplace(
        spark,
        orders=[
            order("a", "c1", purchase="2018-01-01 23:59:00"),
            order("b", "c2", purchase="2018-01-05 12:00:00"),
            order("c", "c3", purchase="2018-01-03"),
            order("latest", "c3", status="shipped", purchase="2018-01-11 00:01:00"),
        ],
        customers=[customer("c1", "u"), customer("c2", "u"), customer("c3", "v")],
        order_payments=[payment("a", value=1), payment("a", value=2), payment("b", value=4), payment("c", value=None)],
    )
    assert sorted(rows(run_report("rfm_base", m))) == [
        ("u", datetime(2018, 1, 5, 12), 6, 2, 7.0),
        ("v", datetime(2018, 1, 3), 8, 1, None),
    ]


def seven_persons(spark):
    days = ["2018-01-0%d" % (i + 1) for i in range(7)]
    return marketplace(
        spark,
        orders=[order(f"o{i}", f"c{i}", purchase=day) for i, day in enumerate(days)],
        customers=[customer(f"c{i}") for i in range(7)],
        order_payments=[payment(f"o{i}", value=10 * (7 - i)) for i in range(7)],
    )


def test_scores_of_seven_persons(spark):
    found = {r["customer_unique_id"]: r for r in run_report("rfm_scores", seven_persons(spark)).collect()}
    assert [found[f"c{i}"]["r_score"] for i in range(7)] == [1, 1, 2, 2, 3, 4, 5]
    assert [found[f"c{i}"]["m_score"] for i in range(7)] == [5, 4, 3, 2, 2, 1, 1]
    assert [found[f"c{i}"]["f_score"] for i in range(7)] == [1, 1, 2, 2, 3, 4, 5]


def test_segments_and_summary(spark):
    m = seven_persons(spark)
    found = {r["customer_unique_id"]: (r["rfm_score"], r["segment"]) for r in run_report("rfm_segments", m).collect()}
    assert found["c0"] == ("115", "Lost")
    assert found["c6"] == ("551", "Loyal Customer")
    summary = run_report("rfm_segment_summary", m)
    total = summary.agg(F.sum("total_customers"), F.sum("total_revenue_brl"), F.round(F.sum("pct_of_customers"), 0))
    assert only(total) == (7, 280.0, 100.0)
    by_name = {r["segment"]: r for r in summary.collect()}
    # c2 and c3 score 2 on recency and frequency: paid 50 and 40, last seen 4 and 3 days ago.
    attention = by_name["Needs Attention"]
    assert tuple(attention)[1:] == (2, 28.57, 4.0, 1.0, 45.0, 90.0)


def test_no_persons(spark):
    assert rows(run_report("rfm_segment_summary", marketplace(spark))) == []
