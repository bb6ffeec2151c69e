"""Grouping operators: folds by key, shares, growth, ranks, latest row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.measures import count_rows, percent


def fold(
    df: DataFrame,
    key: str,
    attributes: Sequence[str] = (),
    measures: Mapping[str, Column] | None = None,
    unique: bool = False,
) -> DataFrame:
    """One row per key and attributes, with ``copies`` and the summed measures.

    Joining two folded inputs on the key pairs no copy with another: sums over
    the unfolded join are products with ``copies``, and as a joined row is unique
    per key and attributes, counting rows counts distinct keys. The fold collapses
    a hot key before the exchange. With ``unique`` the key is known to be free of
    copies and the rows pass through unexchanged.
    """
    measures = measures or {}
    if unique:
        return df.select(key, *attributes, F.lit(1).cast("bigint").alias("copies"), *_named(measures))
    sums = _named({name: F.sum(measure) for name, measure in measures.items()})
    return df.groupBy(key, *attributes).agg(count_rows().alias("copies"), *sums)


def _named(columns: Mapping[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def with_share_of_total(df: DataFrame, value: str, name: str) -> DataFrame:
    """Each group's percentage of the total; input is a grouped report."""
    return df.withColumn(name, percent(value, F.sum(value).over(Window.partitionBy())))


def period_growth(df: DataFrame, periods: Sequence[str], value: str, previous: str, growth: str) -> DataFrame:
    """Previous row's amount and the percentage change against it.

    Input is a report with one row per period. The change is NULL for the first
    row and after an amount of 0.
    """
    by_period = Window.orderBy(*[F.col(p).asc_nulls_first() for p in periods])
    with_previous = df.withColumn(previous, F.lag(value).over(by_period))
    return with_previous.withColumn(growth, percent(F.col(value) - F.col(previous), previous))


def fill_months(df: DataFrame, year: str, month: str) -> DataFrame:
    """Monthly report with a row for every calendar month it spans.

    A row without a month stays.
    """
    dated = df.withColumn("_first", F.make_date(F.col(year).cast("int"), F.col(month).cast("int"), F.lit(1)))
    span = dated.agg(F.min("_first").alias("low"), F.max("_first").alias("high"))
    every = F.expr("explode(sequence(low, high, interval 1 month))")
    return (
        span.select(every.alias("_first"))
        .join(dated.drop(year, month), "_first", "full")
        .withColumn(year, F.year("_first").cast("bigint"))
        .withColumn(month, F.month("_first").cast("bigint"))
        .select(*df.columns)
    )


def with_rank(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Competition rank over a grouped report."""
    return df.withColumn(name, F.rank().over(Window.orderBy(order)).cast("bigint"))


def latest_per_group(df: DataFrame, group: str, order: str, tie_keys: Sequence[str]) -> DataFrame:
    """The newest row of each group, ties broken by the given columns.

    Spark limits each group to one row on the map side as well, so a hot group
    does not travel whole.
    """
    newest = Window.partitionBy(group).orderBy(F.col(order).desc_nulls_last(), *[F.col(k).asc() for k in tie_keys])
    return df.withColumn("_position", F.row_number().over(newest)).filter("_position = 1").drop("_position")
