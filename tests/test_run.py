"""A run of many reports: shared work, the same results, and no scratch left."""

from __future__ import annotations

import os

import pytest
from conftest import TESTDATA
from market import rows

from stallwise import REPORTS
from stallwise.plans import row_rules
from stallwise.plans.catalog import run_report
from stallwise.session import scratch, scratch_root
from stallwise.sources import testbed as derived

FOLDER = str(TESTDATA / "sf0.001")
SINGLE_RULES = {
    "orders_date_sequence_violations": "orders",
    "approval_before_purchase": "orders",
    "estimate_before_purchase": "orders",
    "delivered_missing_date": "orders",
    "cancelled_with_delivery_date": "orders",
    "items_invalid_price": "order_items",
    "products_empty_category": "products",
    "products_extreme_dimensions": "products",
    "translation_empty_english": "category_translation",
    "translation_empty_source": "category_translation",
    "review_empty_comments": "order_reviews",
    "payments_invalid_value": "order_payments",
}

# Reports that read something shared.
SHARING = [*SINGLE_RULES, *(n for n in REPORTS if n.endswith("rule_audit") or n.startswith(("rfm", "delivery", "monthly")))]


def tables_in(spark):
    return {name for name in os.listdir(scratch_root(spark).removeprefix("file:")) if name.startswith("stallwise-")}


def test_shared_run_gives_the_same_and_leaves_nothing(spark):
    plain = derived.testbed(spark, FOLDER)
    before = tables_in(spark)
    with scratch(spark):
        shared = derived.testbed(spark, FOLDER).sharing()
        for name in SHARING:
            found = sorted(rows(run_report(name, shared)), key=str)
            with scratch(spark):
                assert found == sorted(rows(run_report(name, plain)), key=str), name
        assert tables_in(spark) - before
        # one scan per table for all its rules
        assert {n.removeprefix("rules of ") for n in shared._shared if n.startswith("rules of ")} == set(row_rules.RULES)
        for name, table in SINGLE_RULES.items():
            assert "stallwise-" in str(run_report(name, shared).inputFiles()), name
    assert tables_in(spark) == before


def test_scratch_of_the_machine_is_refused_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://elsewhere:7077"

    class Session:
        sparkContext, conf, _jvm, _jsc = Context(), spark.conf, spark._jvm, spark._jsc

    with pytest.raises(ValueError, match="do not share"):
        scratch_root(Session())


class Cluster:
    """A session whose master is a cluster's; its tasks run in the given one."""

    def __init__(self, spark, **settings):
        self.conf = dict(settings)
        self.range, self.read, self._jvm, self._jsc = spark.range, spark.read, spark._jvm, spark._jsc
        self.sparkContext = type("Context", (), {"master": "spark://elsewhere:7077", "applicationId": str(id(self)), "defaultParallelism": 3})()


def test_a_share_by_its_path_is_used_on_a_cluster(spark, tmp_path):
    """A mounted share has a path like a machine's own disk: it is tried."""
    for folder in (f"{tmp_path}/plain", f"file://{tmp_path}/named"):
        cluster = Cluster(spark, **{"spark.checkpoint.dir": folder})
        assert scratch_root(cluster) == folder
        cluster.range = None  # tried once
        assert scratch_root(cluster) == folder
    warehouse = Cluster(spark, **{"spark.sql.warehouse.dir": f"{tmp_path}/warehouse"})
    assert scratch_root(warehouse) == f"{tmp_path}/warehouse"
    assert not [name for _, names, _ in os.walk(tmp_path) for name in names if "probe" in name]


def test_rows_that_tasks_left_elsewhere_refuse_a_folder(spark, tmp_path):
    cluster = Cluster(spark, **{"spark.checkpoint.dir": str(tmp_path)})
    cluster.range = lambda begin, end, step, tasks: spark.range(begin, end - 1, step, tasks)
    with pytest.raises(ValueError, match="do not share"):
        scratch_root(cluster)
