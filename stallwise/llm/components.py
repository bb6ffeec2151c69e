"""Connected components of a link table, by alternating stars.

Each round links every node to the least node among its neighbours and itself, first for the
larger neighbours, then for the smaller ones, until nothing changes: a forest of stars whose
centres are the least nodes. A round is two grouped minima, which combine before the exchange,
and joins that the adaptive skew rule can split, so a hub with a third of all links is no
single task's work. Rounds grow with the logarithm of the longest path. Links stay in tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.tables import materialise


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    pairs = _both_ways(links)
    centre = _least(pairs).select("a", F.least("a", "least").alias("centre"))
    return pairs.filter(F.col("b") > F.col("a")).join(centre, "a").select(F.col("b").alias("a"), F.col("centre").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(pairs)
    moved = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).filter(F.col("a") != F.col("b")).distinct()


def _state(links: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    return tuple(links.agg(F.count("*"), total).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the component's least node."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
    stars = materialise(links.distinct())
    state = _state(stars)
    while True:
        stars = materialise(_small_star(_large_star(stars)))
        before, state = state, _state(stars)
        if state == before:
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
