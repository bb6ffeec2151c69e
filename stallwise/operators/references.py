"""Foreign keys of many tables checked in one exchange.

Each table is read once. Its rows give one (constraint, key) entry for every constraint that it takes part
in, as child or as parent; the entries are added up by constraint and key before and after a single
exchange, so a key that a third of all rows hold travels once per task, and what remains is one
row per key, with its child and parent rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions.measures import total


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` refers to ``parent.parent_column``."""

    name: str
    child: str
    column: str
    parent: str
    parent_column: str


def _entries(table: str, df: DataFrame, constraints: Sequence[ForeignKey]) -> DataFrame | None:
    """(name, key, child, parent): an entry of each row of a table for each constraint on it."""
    entry = lambda c, column, child: F.struct(
        F.lit(c.name).alias("name"),
        F.col(column).cast("string").alias("key"),
        F.lit(child).cast("bigint").alias("child"),
        F.lit(1 - child).cast("bigint").alias("parent"),
    )
    found = [entry(c, c.column, 1) for c in constraints if c.child == table]
    found += [entry(c, c.parent_column, 0) for c in constraints if c.parent == table]
    return df.select(F.inline(F.array(*found))) if found else None


def foreign_key_audit(tables: Mapping[str, DataFrame], constraints: Sequence[ForeignKey]) -> DataFrame:
    """Per constraint: child rows and those without a parent, the keys these have, parent rows and those without a child.

    A NULL key refers to nothing and is referred to by nothing; NULL is not counted as a key.
    """
    parts = [_entries(name, df, constraints) for name, df in tables.items()]
    entries = reduce(DataFrame.unionByName, [part for part in parts if part is not None])
    keys = entries.groupBy("name", "key").agg(F.sum("child").alias("child"), F.sum("parent").alias("parent"))
    known = F.col("key").isNotNull()
    orphan = ~known | (F.col("parent") == 0)
    childless = ~known | (F.col("child") == 0)
    found = keys.groupBy("name").agg(
        F.sum("child").alias("child_rows"),
        total(F.when(orphan, F.col("child"))).alias("orphan_rows"),
        F.count(F.when(known & (F.col("parent") == 0), 1)).alias("orphan_keys"),
        F.sum("parent").alias("parent_rows"),
        total(F.when(childless, F.col("parent"))).alias("childless_rows"),
    )
    names = entries.sparkSession.createDataFrame([(c.name,) for c in constraints], "name string")
    counts = ("child_rows", "orphan_rows", "orphan_keys", "parent_rows", "childless_rows")
    return names.join(found, "name", "left").select(
        F.col("name").alias("reference"), *[F.coalesce(count, F.lit(0)).alias(count) for count in counts]
    )
