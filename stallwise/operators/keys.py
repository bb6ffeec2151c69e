"""Key audits: duplicates, collisions, orphans, uncovered values, upsert.

Each side of a key comparison is first folded to one row per key. The fold
happens before the exchange, so a key that holds a third of all rows travels as
one row per task, and the comparison reuses the fold's partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions.measures import count_rows, total


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(count_rows().alias("cnt")).filter(F.col("cnt") > 1)


def duplicate_excess(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows beyond the first of each key; NULL when no key repeats."""
    return duplicate_keys(df, keys).agg(F.sum(F.col("cnt") - 1).alias(name))


def key_collisions(df: DataFrame, key: str, other: str, name: str, top: int) -> DataFrame:
    """Repeated keys with the most distinct partners; ties go by key."""
    return (
        df.groupBy(key)
        .agg(count_rows().alias("cnt"), F.countDistinct(other).alias(name))
        .filter(F.col("cnt") > 1)
        .select(key, name)
        .orderBy(F.desc(name), F.asc(key))
        .limit(top)
    )


def multi_valued_groups(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Number of keys with more than one distinct non-NULL value.

    More than one value means the smallest differs from the largest, which needs
    one exchange where a distinct count needs two. Smallest and largest of a string
    sort each side of the exchange.
    """
    spans = df.groupBy(key).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return spans.filter(F.col("low") != F.col("high")).agg(count_rows().alias(name))


def orphan_rows(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child keys without a parent, with the child rows that carry them."""
    children = child.groupBy(key).agg(count_rows().alias("cnt"))
    return children.join(parent.select(key).distinct(), key, "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Child rows without a parent; a NULL key has no parent."""
    return orphan_rows(child, parent, key).agg(total("cnt").alias(name))


def uncovered_values(df: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """Distinct non-NULL values that the reference table lacks."""
    used = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return used.join(reference.select(column).distinct(), column, "left_anti")


def upsert_reference(reference: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Reference table plus the rows whose key it lacks; NULL is a key like any other.

    Inputs stay as they are; the result is the next version of the table, and
    applying the same rows to it again changes nothing. Rows that repeat are one
    row; rows with one key and different values fail the job.
    """
    others = F.struct(*[F.col(name) for name in rows.columns if name != key])
    by_key = rows.groupBy(key).agg(F.min(others).alias("low"), F.max(others).alias("high"))
    conflict = F.raise_error(F.concat(F.lit(f"conflicting rows for {key} "), F.coalesce(F.col(key), F.lit("NULL"))))
    agreed = F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low"))
    agreed = agreed.otherwise(conflict.cast(by_key.schema["low"].dataType))
    single = by_key.select(key, agreed.alias("row")).select(
        *[F.col(key) if name == key else F.col("row").getField(name).alias(name) for name in rows.columns]
    )
    present = reference.select(F.col(key).alias("_present")).distinct()
    return reference.unionByName(single.join(present, single[key].eqNullSafe(present["_present"]), "left_anti"))
