"""Key and reference audits over many tables: exact, and exchanging little."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from market import customer, item, marketplace, order, product, review, rows
from pyspark.sql import functions as F

from stallwise.operators import keys, singletons
from stallwise.operators.references import ForeignKey, foreign_key_audit
from stallwise.plans.key_audit import FOREIGN_KEYS, key_audit, repeated_orders
from stallwise.plans import key_audit as plans


def test_packing_round_trip():
    draw = np.random.default_rng(0)
    for size, most in [(1, 2), (1, 2**48 - 1), (50, 2**20), (1000, 2**48 - 1), (3000, 4000)]:
        cells = np.unique(draw.integers(0, most, size))
        twice = draw.random(len(cells)) < 0.3
        found = singletons.unpack_cells(singletons.pack_cells(cells, twice))
        assert (found[0] == cells).all() and (found[1] == twice).all()
    dense = np.arange(10_000)
    assert len(singletons.pack_cells(dense, dense < 0)) == 10_009


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("held", [1 << 22, 10])
def test_duplicates_equal_the_plain_audit(spark, setting, monkeypatch, partitions, held):
    setting("spark.sql.shuffle.partitions", "5")
    draw = random.Random(4)
    data = [(draw.choice([None, *"abc"]), draw.randrange(400) if draw.random() < 0.9 else None) for _ in range(600)] + [("hot", 1)] * 300
    df = spark.createDataFrame(data, "a string, b int").repartition(partitions)
    monkeypatch.setattr(singletons, "TASK_CELLS", held)
    expected = sorted(rows(keys.duplicate_keys(df, ["a", "b"])), key=str)
    assert expected and sorted(rows(singletons.duplicate_keys(df, ["a", "b"])), key=str) == expected
    monkeypatch.setattr(singletons, "BROADCAST_CELLS", 0)
    assert sorted(rows(singletons.duplicate_keys(df, ["a", "b"])), key=str) == expected


def test_false_hits_do_no_harm(spark, monkeypatch):
    """With 64 cells nearly every key shares one with another."""
    monkeypatch.setattr(singletons, "cell", lambda keys, tag="": F.pmod(F.xxhash64(F.lit(tag), *keys), F.lit(64)))
    df = spark.range(500).select((F.col("id") % 490).alias("k"))
    assert sorted(rows(singletons.duplicate_keys(df, ["k"]))) == [(k, 2) for k in range(10)]


def test_unique_and_empty_tables_have_no_duplicates(spark):
    assert rows(singletons.duplicate_keys(spark.range(1000), ["id"])) == []
    assert rows(singletons.duplicate_keys(spark.range(0), ["id"])) == []


def _nodes(plan):
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    if "QueryStage" in plan.getClass().getSimpleName():
        plan = plan.plan()
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def exchanged(df):
    """Rows written to each exchange of an executed plan."""
    df.collect()
    metric = "shuffleRecordsWritten"
    return [n.metrics().apply(metric).value() for n in _nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName() == "Exchange"]


def test_few_keys_are_exchanged(spark, tmp_path):
    """Of 200,000 keys 300 repeat: at most their own rows travel, against all keys by the plain audit."""
    key = F.when(F.col("id") < 300, F.col("id") + 1000).otherwise(F.col("id"))
    spark.range(0, 200_000, 1, 8).select(F.sha2(key.cast("string"), 256).alias("k")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    filtered = singletons.duplicate_keys(df, ["k"])
    assert filtered.count() == 300
    assert sum(exchanged(filtered)) <= 2 * 300
    assert sum(exchanged(keys.duplicate_keys(df, ["k"]))) > 190_000
    sizes = df.select(singletons.cell(["k"])).mapInArrow(lambda b: singletons._pack_partition(b, 4), "block int, packed binary")
    assert sizes.agg(F.sum(F.length("packed"))).first()[0] < 200_000 * 6


def test_key_audit_by_hand(spark):
    m = marketplace(
        spark,
        orders=[order("o1"), order("o1"), order("o1", status="shipped"), order(None), order(None), order("o2")],
        order_items=[item("o1", 1), item("o1", 2), item("o1", 2)],
        products=[product("p1"), product("p2")],
        order_reviews=[review("r1", "o1"), review("r1", "o2")],
    )
    found = {r.audit: (r.key_columns, r.repeated_keys, r.excess_rows, r.most_rows) for r in key_audit(m).collect()}
    assert found == {
        "orders": ("order_id", 2, 3, 3),
        "order_items": ("order_id, order_item_id", 1, 1, 2),
        "products": ("product_id", 0, 0, 1),
        "category_translation": ("product_category_name", 0, 0, 1),
        "customers": ("customer_id", 0, 0, 1),
        "sellers": ("seller_id", 0, 0, 1),
        "order_reviews": ("review_id", 1, 1, 2),
    }
    assert sorted(rows(repeated_orders(m)), key=str) == [("o1", 3, True), (None, 2, False)]


def test_keys_of_different_tables_do_not_meet(spark):
    df = spark.range(10)
    found = singletons.key_audit({"a": (df, ["id"]), "b": (df, ["id"]), "c": (df.union(df), ["id"])})
    assert sorted(rows(found)) == [("a", "id", 0, 0, 1), ("b", "id", 0, 0, 1), ("c", "id", 10, 10, 2)]


def test_foreign_keys_by_hand(spark):
    m = marketplace(
        spark,
        orders=[order("o1", "c1"), order("o2", "c9"), order("o3", None), order(None, "c1"), order("o4", "c1"), order("o4", "c1")],
        customers=[customer("c1"), customer("c2"), customer(None)],
        order_items=[item("o1"), item("o1", 2), item("zz"), item("zz", 2, "p7"), item(None, 3, None)],
        products=[product("p1"), product("p2"), product("p2")],
    )
    found = {r[0]: tuple(r[1:]) for r in plans.foreign_key_audit(m).collect()}
    assert found["orders.customer_id"] == (6, 2, 1, 3, 2)
    assert found["order_items.order_id"] == (5, 3, 1, 6, 5)
    assert found["order_items.product_id"] == (5, 2, 1, 3, 2)
    assert found["order_items.seller_id"] == (5, 5, 1, 0, 0)
    assert found["order_reviews.order_id"] == (0, 0, 0, 6, 6)
    assert len(found) == len(FOREIGN_KEYS)


def test_orphans_equal_the_anti_joins(spark):
    draw = random.Random(8)
    child = spark.createDataFrame([(draw.choice([None, *range(40)]),) for _ in range(200)] + [(7,)] * 400, "k int")
    parent = spark.createDataFrame([(k,) for k in [None, None, *range(20, 60), 25, 25]], "k int")
    (row,) = foreign_key_audit({"c": child, "p": parent}, [ForeignKey("r", "c", "k", "p", "k")]).collect()
    assert row.orphan_rows == rows(keys.orphan_count(child, parent, "k", "n"))[0][0]
    assert row.childless_rows == rows(keys.orphan_count(parent, child, "k", "n"))[0][0]


def test_each_table_is_scanned_once_in_one_exchange(spark, tmp_path, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    tables = {"f": "a int, b int, c int", "p": "a int", "q": "b int", "r": "c int"}
    for name, schema in tables.items():
        n = schema.count("int")
        spark.createDataFrame([(i,) * n for i in range(30)] + [(5,) * n] * 300, schema).repartition(3).write.parquet(f"{tmp_path}/{name}")
    frames = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables}
    references = [ForeignKey(f"f.{c}", "f", c, p, c) for c, p in zip("abc", "pqr")]
    found = foreign_key_audit(frames, references)
    counts = exchanged(found)
    nodes = Counter(n.nodeName() for n in _nodes(found._jdf.queryExecution().executedPlan()))
    assert nodes["Scan parquet "] == len(tables)
    # keys, sums by reference, and the list of references: a hot key is one row of each task
    assert sorted(counts)[-1] <= 6 * 3 * 31 and len(counts) <= 4
