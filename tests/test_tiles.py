from __future__ import annotations

import random

import pytest
from market import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import TESTDATA

from stallwise.operators import tiles
from stallwise.operators.tiles import SortKey, tile_starts, with_tiles
from stallwise.plans.catalog import run_report
from stallwise.sources import testbed as derived

ORDERINGS = {
    "down": (SortKey("n", ascending=False), SortKey("id")),
    "up": (SortKey("n"), SortKey("id")),
    "name": (SortKey("id"),),
}


def by_window(df, k):
    windows = {
        "down": Window.orderBy(F.col("n").desc_nulls_last(), "id"),
        "up": Window.orderBy(F.col("n").asc_nulls_first(), "id"),
        "name": Window.orderBy("id"),
    }
    return df.withColumns({name: F.ntile(k).over(w).cast("bigint") for name, w in windows.items()})


def frame(spark, values, partitions=4):
    data = [(f"k{random.Random(i).random():.12f}", v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "id string, n bigint").repartition(partitions)


@pytest.fixture
def small_steps(monkeypatch):
    """Force several sampling rounds on small data."""
    monkeypatch.setattr(tiles, "FIRST_ROWS", 80)
    monkeypatch.setattr(tiles, "SAMPLE_ROWS", 40)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 6, 7, 500, 501, 502, 503, 504])
def test_equals_ntile(spark, n):
    df = frame(spark, [i * 7919 % 13 for i in range(n)])
    assert sorted(rows(with_tiles(df, 5, ORDERINGS))) == sorted(rows(by_window(df, 5)))


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_equals_ntile_through_sampling(spark, small_steps, partitions):
    df = frame(spark, [None if i % 17 == 0 else i * 7919 % 101 for i in range(1203)], partitions)
    assert sorted(rows(with_tiles(df, 5, ORDERINGS))) == sorted(rows(by_window(df, 5)))


def test_one_value_holds_almost_all_rows(spark, small_steps):
    df = frame(spark, [2 if i % 50 == 0 else 1 for i in range(1000)])
    found = with_tiles(df, 5, ORDERINGS)
    assert sorted(rows(found)) == sorted(rows(by_window(df, 5)))
    assert {r["cnt"] for r in found.groupBy("up").agg(F.count("*").alias("cnt")).collect()} == {200}


def test_the_table_is_passed_three_times(spark, small_steps, monkeypatch):
    """Sampled, counted and cut; later rounds read the stored intervals, which hold a part of the rows."""
    read, stored = [], []
    narrow, store = tiles._narrow, tiles.materialise
    monkeypatch.setattr(tiles, "_narrow", lambda positions, *rest: (read.append(positions.count()), narrow(positions, *rest)))
    monkeypatch.setattr(tiles, "materialise", lambda df: stored.append(store(df)) or stored[-1])
    monkeypatch.setattr(tiles, "FIRST_ROWS", 1500)
    df = frame(spark, [None if i % 17 == 0 else i * 7919 % 101 for i in range(6000)], 8)
    assert sorted(rows(with_tiles(df, 5, ORDERINGS))) == sorted(rows(by_window(df, 5)))
    assert len(stored) == 1 and read[0] == 6000 and len(read) > 2
    assert set(read[1:]) == {stored[0].count()} and stored[0].count() < 6000


def test_boundaries_come_from_counting_rounds(spark, monkeypatch):
    """Also on the smallest of the test tables, where whole intervals fit the sample."""
    rounds = []
    resolve = tiles._resolve
    monkeypatch.setattr(tiles, "_resolve", lambda *args: rounds.append(resolve(*args)))
    assert run_report("rfm_scores", derived.testbed(spark, str(TESTDATA / "sf0.01"))).count() > 0
    assert rounds and rounds[0] >= 1


def test_an_unlucky_sample_is_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(tiles, "FIRST_ROWS", 1)
    monkeypatch.setattr(tiles, "SAMPLE_ROWS", 1)
    df = frame(spark, range(300))
    assert sorted(rows(with_tiles(df, 5, ORDERINGS))) == sorted(rows(by_window(df, 5)))


def test_keys_must_tell_rows_apart(spark, small_steps):
    with pytest.raises(ValueError, match="tie key"):
        with_tiles(frame(spark, [1] * 300), 5, {"up": (SortKey("n"),)})
    with pytest.raises(ValueError, match="tie key"):
        with_tiles(frame(spark, [1] * 6), 5, {"up": (SortKey("n"),)})


def test_tile_sizes_differ_by_at_most_one():
    assert tile_starts(7, 5) == [3, 5, 6, 7]
    assert tile_starts(3, 5) == [2, 3]
    assert tile_starts(10, 5) == [3, 5, 7, 9]
    assert tile_starts(0, 5) == []


def test_rows_are_neither_sorted_nor_exchanged(spark):
    plan = with_tiles(frame(spark, range(100)), 5, ORDERINGS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
