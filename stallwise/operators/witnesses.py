"""Rules counted together with examples of the rows that break them, in one scan.

The examples of a rule are the ``k`` distinct keys with the least hash among all that break it: a
sample that any task can build for its own rows and that merges by taking the least again, so
the same keys come out however the table is partitioned. A task hands on at most ``k`` keys and one count a rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.session import materialise


def _least(table: pa.Table, k: int) -> pa.Table:
    """The ``k`` first distinct (hash, key) rows."""
    distinct = table.group_by(["hash", "key"]).aggregate([])
    return distinct.take(pc.select_k_unstable(distinct, k, [("hash", "ascending"), ("key", "ascending")]))


def _gather(batches: Iterator[pa.RecordBatch], rules: int, k: int) -> Iterator[pa.RecordBatch]:
    counts = [0] * rules
    held: list[pa.Table | None] = [None] * rules
    for batch in batches:
        keys = pa.table({"hash": batch.column("hash"), "key": batch.column("key")})
        for i in range(rules):
            hit = pc.fill_null(batch.column(f"r{i}"), False)
            number = pc.sum(hit).as_py() or 0
            if number:
                counts[i] += number
                own = keys.filter(hit)
                held[i] = _least(own if held[i] is None else pa.concat_tables([held[i], own]), k)
    rows = [{"rule": i, "count": counts[i], "hash": None, "key": None} for i in range(rules) if counts[i]]
    for i, table in enumerate(held):
        if table is not None:
            rows += [{"rule": i, "count": None} | row for row in table.to_pylist()]
    if rows:
        schema = pa.schema([("rule", pa.int32()), ("count", pa.int64()), ("hash", pa.string()), ("key", pa.string())])
        yield pa.RecordBatch.from_pylist(rows, schema)


def rule_witnesses(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str], k: int) -> DataFrame:
    """One row for each rule and witness: ``rule, violations, position, witness``; a rule that nothing breaks has one
    row without a witness. A witness is the key as text, parts separated by commas, NULL as an empty part.
    """
    key = F.concat_ws(",", *[F.coalesce(F.col(name).cast("string"), F.lit("")) for name in keys])
    marks = [rule.alias(f"r{i}") for i, rule in enumerate(rules.values())]
    rows = df.select(F.md5(key.cast("binary")).alias("hash"), key.alias("key"), *marks)
    gather = partial(_gather, rules=len(rules), k=k)
    gathered = materialise(rows.mapInArrow(gather, "rule int, count bigint, hash string, key string"))
    first = Window.partitionBy("rule").orderBy("hash", "key")
    keys_of = gathered.filter(F.col("key").isNotNull()).select("rule", "hash", "key").distinct()
    examples = keys_of.withColumn("position", F.row_number().over(first)).filter(F.col("position") <= k)
    counts = gathered.groupBy("rule").agg(F.sum("count").alias("violations"))
    names = df.sparkSession.createDataFrame(list(enumerate(rules)), "rule int, name string")
    found = names.join(counts, "rule", "left").join(examples, "rule", "left")
    return found.select(
        F.col("name").alias("rule"),
        F.coalesce("violations", F.lit(0)).alias("violations"),
        F.col("position").cast("bigint").alias("position"),
        F.col("key").alias("witness"),
    )
