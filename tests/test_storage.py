"""Tables stored by order, and the summary that finds heavy keys."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from market import item, marketplace, order, payment, review, rows
from pyspark.sql import functions as F
from test_keys import exchanged

from stallwise.operators.heavy import heavy_keys
from stallwise.plans.catalog import REPORTS
from stallwise.sources.clustered import open_clustered, write_clustered

TABLES = ("orders", "order_items", "order_payments", "order_reviews")


def market(spark, hot=0, extra=()):
    draw = random.Random(3)
    names = [f"o{i}" for i in range(60)]
    pick = lambda: draw.choice([*names, None]) if draw.random() > hot else "o1"
    return marketplace(
        spark,
        orders=[order(n, "c1", "delivered", f"2018-0{1 + i % 3}-01", "2018-05-02", "2018-05-20", "2018-05-1%d" % (i % 9)) for i, n in enumerate(names)] + list(extra),
        order_items=[item(pick(), k, price=k % 7, freight=k % 90) for k in range(300)],
        order_payments=[payment(pick(), value=k % 11) for k in range(300)],
        order_reviews=[review(f"r{k}", pick(), 1 + k % 5) for k in range(300)],
    )


@pytest.mark.parametrize("name", ["monthly_gmv", "freight_vs_speed", "punctuality_vs_review"])
@pytest.mark.parametrize("extra", [(), (order("o1", "c9", purchase="2018-02-02"),)])
def test_orders_meet_without_an_exchange(spark, tmp_path, setting, name, extra):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    m = market(spark, extra=extra)
    write_clustered(m, str(tmp_path / "t"), 4, TABLES)
    stored = open_clustered(spark, str(tmp_path / "t"))
    assert stored.is_unique("orders") == (not extra)
    found = REPORTS[name](stored)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(order_id" not in plan and "hashpartitioning(order_id" in REPORTS[name](m)._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == rows(REPORTS[name](m))


def test_a_folder_opens_in_another_session(spark, tmp_path):
    m = market(spark)
    write_clustered(m, str(tmp_path / "t"), 4)
    other = spark.newSession()
    for table in spark.catalog.listTables():
        if table.name.startswith("clustered_"):
            spark.sql(f"DROP TABLE {table.name}")
    again = open_clustered(other, str(tmp_path / "t"))
    assert rows(REPORTS["monthly_gmv"](again)) == rows(REPORTS["monthly_gmv"](m))
    assert "Bucketed: true" in again.orders.groupBy("order_id").count()._jdf.queryExecution().executedPlan().toString()


def test_a_heavy_order_is_not_one_bucket(spark, tmp_path):
    m = market(spark, hot=0.5)
    write_clustered(m, str(tmp_path / "t"), 40, TABLES)
    manifest = {r["table"]: r["buckets"] for r in spark.read.parquet(str(tmp_path / "t" / "manifest")).collect()}
    assert manifest == {"orders": 40, "order_items": 0, "order_payments": 0, "order_reviews": 0}
    for name in ("monthly_gmv", "freight_vs_speed"):
        assert rows(REPORTS[name](open_clustered(spark, str(tmp_path / "t")))) == rows(REPORTS[name](m))


@pytest.mark.parametrize("one_in", [2, 10, 100])
@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_heavy_keys_are_exact(spark, one_in, partitions):
    draw = random.Random(one_in)
    values = [draw.choice(["hot", None]) if draw.random() < 0.4 else f"k{min(int(draw.paretovariate(0.7)), 3000)}" for _ in range(6000)]
    df = spark.createDataFrame([(v,) for v in values], "k string").repartition(partitions)
    counts = Counter(values)
    del counts[None]
    assert dict(rows(heavy_keys(df, "k", one_in))) == {k: n for k, n in counts.items() if n * one_in > len(values)}


def test_heavy_keys_of_nothing_and_of_unique_ones(spark):
    assert rows(heavy_keys(spark.range(0), "id", 10)) == []
    assert rows(heavy_keys(spark.range(5000), "id", 100)) == []


def test_light_keys_are_not_exchanged(spark):
    df = spark.range(0, 50_000, 1, 8).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    found = heavy_keys(df, "k", 1000)
    assert sum(exchanged(found)) <= 8 * 2000 and rows(found) == [(-1, 16667)]
