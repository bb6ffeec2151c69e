"""One rollup for many reports, and stored sums that follow late changes."""

from __future__ import annotations

import random
import re

import pytest
from market import customer, item, marketplace, order, payment, product, review, rows, translation
from pyspark.sql import functions as F

from stallwise import Marketplace
from stallwise.plans import report_state, rollup
from stallwise.plans.catalog import REPORTS, run_report
from stallwise.plans.report_state import ReportState, add_up, partial_sums, restrict

STATES = ["SP", "RJ", None]


def random_tables(draw, orders, changed=0):
    """Orders with duplicates, NULLs and hot keys; ``changed`` varies what is in them."""
    names = [f"o{i}" for i in range(orders)] + ["o1", "o2", "o2", None]
    made = []
    for name in names:
        day = f"2018-0{draw.randrange(1, 4)}-1{draw.randrange(10)} 0{draw.randrange(10)}:00"
        made.append(
            order(name, draw.choice(["c1", "c2", "c3", "c4", None]), draw.choice(["delivered"] * 4 + ["shipped", None]), draw.choice([day, day, None]),
                  "2018-04-01", draw.choice(["2018-04-03", "2018-05-20", None]), draw.choice(["2018-04-03 10:00", "2018-04-20"]))
        )
    pick = lambda: draw.choice([*names, "o1", "o1", "zz"])
    kinds = ["credit_card", "credit_card", "boleto", "voucher", "not_defined", None]
    return dict(
        orders=made,
        order_payments=[payment(pick(), draw.choice(kinds), draw.choice([None, 0, 1.25, 7, 30 + changed]), draw.choice([1, 2, None])) for _ in range(3 * orders)],
        order_items=[item(pick(), k, draw.choice(["p1", "p2", "p3", "p9"]), "s1", draw.choice([None, 2, 5.5]), draw.choice([0, 20.5, 30, 90, None])) for k in range(2 * orders)],
        order_reviews=[review(f"r{k}", pick(), draw.choice([None, 1, 2, 3, 5])) for k in range(2 * orders)],
    )


DIMENSIONS = dict(
    customers=[customer("c1", state="SP"), customer("c2", state="RJ"), customer("c3", state=None), customer("c1", "again", "RJ"), customer("c4")],
    products=[product("p1", "toys"), product("p2", None), product("p2", "toys"), product("p3", "art")],
    category_translation=[translation("toys", "Toys"), translation("toys", "Games")],
)


def same(left, right):
    assert left.columns == right.columns and left.dtypes == right.dtypes
    assert sorted(rows(left), key=str) == sorted(rows(right), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_rollup_answers_the_reports(spark, seed):
    m = marketplace(spark, **random_tables(random.Random(seed), 40), **DIMENSIONS)
    whole = rollup.order_rollup(m)
    for name, finish in rollup.FROM_ROLLUP.items():
        same(finish(whole), REPORTS[name](m))


def test_rollup_of_nothing(spark):
    m = marketplace(spark)
    for name, finish in rollup.FROM_ROLLUP.items():
        same(finish(rollup.order_rollup(m)), REPORTS[name](m))


@pytest.fixture
def stored(spark, tmp_path):
    m = marketplace(spark, **random_tables(random.Random(3), 200), **DIMENSIONS)
    for name in ("orders", "order_payments", "customers"):
        getattr(m, name).write.parquet(f"{tmp_path}/{name}")
    return Marketplace.from_folder(spark, str(tmp_path))


def test_one_join_of_orders_and_payments(stored, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = rollup.order_rollup(stored)._jdf.queryExecution().executedPlan().toString()
    initial = text.split("== Initial Plan ==")[-1]
    scans = re.findall(r"FileScan parquet .*?ReadSchema: struct<([^>]*)>", initial)
    assert sum("payment_type" in s for s in scans) == 1
    assert len(re.findall(r"SortMergeJoin \[order_id", initial)) == 1


def test_a_run_of_many_reports_joins_once(stored, monkeypatch):
    built = []
    plain = rollup._payment_groups
    monkeypatch.setattr(rollup, "_payment_groups", lambda m: built.append(1) or plain(m))
    shared = stored.sharing()
    for name in rollup.FROM_ROLLUP:
        same(run_report(name, shared), REPORTS[name](stored))
    assert len(built) == 1


def _merged(tables, more):
    return {name: tables[name] + more[name] for name in tables}


def _without(tables, ids):
    return {name: [row for row in tables[name] if row["order_id"] not in ids] for name in tables}


def _with_only(tables, ids):
    return {name: [row for row in tables[name] if row["order_id"] in ids] for name in tables}


def test_state_equals_the_full_run_after_any_changes(spark, tmp_path):
    draw = random.Random(9)
    build = lambda tables: marketplace(spark, **tables, **DIMENSIONS)
    now = random_tables(draw, 30)
    state = ReportState(spark, str(tmp_path / "state"))
    state.start(build(now))
    for turn in range(3):
        ids = {f"o{draw.randrange(30)}" for _ in range(8)} | ({None, "o1"} if turn else {"zz"})
        new = _with_only(random_tables(draw, 30, changed=turn + 1), set(list(ids - {None})[: len(ids) // 2]) | (ids & {None}))
        before, now = now, _merged(_without(now, ids), new)
        version = state.apply(build(_with_only(before, ids)), build(_with_only(now, ids)))
        assert version == turn + 2
    whole = build(now)
    for name in report_state.REPORTS:
        same(state.report(name), REPORTS[name](whole))
    kept = sorted(rows(state.log.read()), key=str)
    assert kept == sorted(rows(add_up((1, partial_sums(whole)))), key=str)


def test_taking_all_out_leaves_nothing(spark, tmp_path):
    m = marketplace(spark, **random_tables(random.Random(5), 12), **DIMENSIONS)
    state = ReportState(spark, str(tmp_path / "state"))
    state.start(m)
    state.apply(m, None)
    assert state.log.read().isEmpty()
    nothing = marketplace(spark, **DIMENSIONS)
    for name in ("monthly_gmv", "delivery_overall", "category_revenue"):
        same(state.report(name), REPORTS[name](nothing))
    assert len(rows(state.report("monthly_gmv", version=1))) > 0


def test_a_change_reads_its_own_orders_only(spark):
    m = marketplace(spark, **random_tables(random.Random(6), 25), **DIMENSIONS)
    ids = spark.createDataFrame([("o3",), (None,), ("o3",)], "order_id string")
    few = restrict(m, ids)
    for name in report_state.ORDER_TABLES:
        expected = [r for r in getattr(m, name).collect() if r.order_id in ("o3", None)]
        assert sorted(getattr(few, name).collect(), key=str) == sorted(expected, key=str)


def test_sums_have_one_schema(spark):
    m = marketplace(spark, **random_tables(random.Random(7), 5), **DIMENSIONS)
    assert partial_sums(m).dtypes == [("rollup", "string"), ("number", "bigint"), ("name", "string"), *[(c, "bigint") for c in report_state._SUMS]]
    assert partial_sums(m, ["monthly_gmv"]).select("rollup").distinct().filter(F.col("rollup") == "category_revenue").isEmpty()
