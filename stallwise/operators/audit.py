"""Row-level audits: NULL counts, rule violations, distributions and shares."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.measures import count_rows, count_where, percent


def null_audit(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One row with the NULL count of each column, keyed by result name."""
    return df.agg(*[count_where(F.col(column).isNull()).alias(name) for name, column in columns.items()])


def violation_count(df: DataFrame, predicate: Column, name: str) -> DataFrame:
    """Rows that break one rule. The rule is a filter, so it can reach the scan."""
    return df.filter(predicate).agg(count_rows().alias(name))


def rule_audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each of many rules, counted in a single scan."""
    return df.agg(*[F.count(F.when(rule, 1)).alias(name) for name, rule in rules.items()])


def violating_rows(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(predicate)


def distribution(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Row count per value, as ``cnt``."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(column).agg(count_rows().alias("cnt"))


def conditional_share(df: DataFrame, predicate: Column, hits: str, rows: str, share: str) -> DataFrame:
    """Hits, rows and the rounded percentage of hits, in one pass."""
    counted = df.agg(count_where(predicate).alias(hits), count_rows().alias(rows))
    return counted.withColumn(share, percent(hits, rows))
