"""Reading the test tables and handing Arrow batches through Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwise.session import materialise

__all__ = ["held_out", "map_batches", "materialise", "read", "unpacked", "whole_row"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, out of the way of an operator's own names."""
    return F.struct(*[F.col("`{}`".format(name.replace("`", "``"))) for name in docs.columns]).alias("row")


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, from ``row``."""
    return df.select(*[F.col("row").getField(name).alias(name) for name in docs.columns])


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """crc32(id as text) mod ``parts`` equals ``part``; a NULL id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts == part


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | None], schema: T.StructType
) -> DataFrame:
    """``df.mapInArrow`` for a function of one batch at a time that yields batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)
