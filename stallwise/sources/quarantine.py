"""Reading tables with bad rows: good rows typed, bad ones set aside with their reasons.

The strict readers fail a job at the first value that does not fit its declared type. Here one pass writes
both: rows that fit, in the declared types, and rows that do not, as text, with a reason for each value refused. No
row is lost: kept and refused rows add up to the rows read. The two parts are stored in one folder and read back.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwise.marketplace import Marketplace
from stallwise.session import keep_until_end, scratch_root
from stallwise.sources.readers import _checked, _not_a, _not_blank
from stallwise.sources.schemas import SCHEMAS

MALFORMED = "row does not fit the header"
_RECORD = "_record"


@dataclass(frozen=True)
class Quarantine:
    """``kept`` has the table's declared schema; ``refused`` the values as text, ``reasons``, and the text of a malformed row."""

    kept: DataFrame
    refused: DataFrame


def set_aside(df: DataFrame, table: str, folder: str) -> Quarantine:
    """Split a table in one pass into a new folder. A missing column is still an error, as it concerns every row."""
    schema = SCHEMAS[table]
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    checked = {f.name: _checked(df.schema[f.name], f.dataType) for f in schema}
    faults = [F.when(refused, _not_a(df.schema[name], schema[name].dataType)) for name, (_, refused) in checked.items() if refused is not None]
    if _RECORD in df.columns:
        faults.append(F.when(F.col(_RECORD).isNotNull(), MALFORMED))
    reasons = F.array_compact(F.array(*faults)) if faults else F.array().cast("array<string>")
    raw = F.struct(*[F.col(f.name).cast("string").alias(f.name) for f in schema], (F.col(_RECORD) if _RECORD in df.columns else F.lit(None).cast("string")).alias(_RECORD))
    good = F.struct(*[value.alias(name) for name, (value, _) in checked.items()])
    split = df.select(reasons.alias("reasons"), raw.alias("raw"), good.alias("row")).select(
        (F.size("reasons") > 0).alias("refused"),
        F.when(F.size("reasons") == 0, F.col("row")).alias("row"),
        F.when(F.size("reasons") > 0, F.struct("reasons", "raw")).alias("bad"),
    )
    split.write.mode("errorifexists").partitionBy("refused").parquet(folder)
    stored = df.sparkSession.read.schema(split.schema).parquet(folder)
    kept = stored.filter(~F.col("refused")).select("row.*")
    refused = stored.filter(F.col("refused")).select("bad.reasons", "bad.raw.*").withColumnRenamed(_RECORD, "record")
    return Quarantine(kept.select(*[F.col(f.name) for f in schema]), refused)


def read_csv(spark: SparkSession, path: str, table: str, folder: str, blank_as_null: bool = False) -> Quarantine:
    """A CSV file or folder with a header, split into a new folder; rows that do not fit the header are refused too."""
    reader = spark.read.option("header", True).option("escape", '"')
    names = reader.option("inferSchema", False).csv(path).columns
    text = T.StructType([T.StructField(name, T.StringType(), True) for name in [*names, _RECORD]])
    raw = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RECORD).schema(text).csv(path)
    if blank_as_null:
        raw = raw.select(*[_not_blank(name).alias(name) for name in names], _RECORD)
    return set_aside(raw, table, folder)


def orders_quarantine(m: Marketplace) -> DataFrame:
    """Orders loaded from CSV with faults: rows kept, and refused by reason (a row may have several).

    The approval is not a date for purchases at 3 o'clock, and the handover is an impossible day for those on a 13th.
    """
    spark = m.orders.sparkSession
    folder = f"{scratch_root(spark)}/stallwise-{uuid.uuid4().hex}"
    keep_until_end(folder)
    purchase = F.col("order_purchase_timestamp")
    time = lambda name: F.date_format(name, "yyyy-MM-dd HH:mm:ss")
    text = {f.name: time(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name).cast("string") for f in m.orders.schema}
    text["order_approved_at"] = F.when(F.hour(purchase) == 3, "soon").otherwise(text["order_approved_at"])
    text["order_delivered_carrier_date"] = F.when(F.day(purchase) == 13, "2018-02-30 00:00:00").otherwise(text["order_delivered_carrier_date"])
    m.orders.select(*[column.alias(name) for name, column in text.items()]).write.option("header", True).csv(f"{folder}/csv")
    found = read_csv(spark, f"{folder}/csv", "orders", f"{folder}/split")
    kept = found.kept.select(F.lit("kept").alias("outcome"))
    refused = found.refused.select(F.explode("reasons").alias("outcome"))
    return kept.unionByName(refused).groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))
