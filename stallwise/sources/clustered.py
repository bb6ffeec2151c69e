"""Tables stored by order: bucketed and sorted by ``order_id``, with a manifest of what is known of their keys.

Reports on tables stored so meet orders, items, payments and reviews without exchanging them. The manifest, beside the
tables, says how each is bucketed and whether an audit found its primary key unique, so a reader needs no
audit of its own; :func:`open_clustered` registers the tables of a folder in the session's catalog.

A bucket is one task's work. So a table in which one order has more than ``HEAVIEST`` times a bucket's share of the rows
is stored without buckets: its reports exchange it, and fold the heavy order before they do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from stallwise.marketplace import FOLDED_TABLES, Marketplace
from stallwise.operators.heavy import heavy_keys
from stallwise.operators.singletons import duplicate_keys
from stallwise.session import keep_until_end, scratch_root
from stallwise.sources.schemas import PRIMARY_KEYS, SCHEMAS

KEY = "order_id"
HEAVIEST = 4
_MANIFEST = "table string, buckets int, unique boolean"


def write_clustered(m: Marketplace, folder: str, buckets: int, tables: Iterable[str] = tuple(SCHEMAS)) -> None:
    """Store tables of a marketplace in a new folder, those with an order key by order; the manifest comes last."""
    spark, entries = None, []
    for name in tables:
        df = getattr(m, name)
        spark = df.sparkSession
        split = KEY in df.columns and not _has_heavy_order(df, buckets)
        unique = name in FOLDED_TABLES and duplicate_keys(df, PRIMARY_KEYS[name]).isEmpty()
        _write(df, f"{folder}/{name}", buckets if split else 0)
        entries.append((name, buckets if split else 0, unique))
    if spark is not None:
        spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/manifest")


def _has_heavy_order(df: DataFrame, buckets: int) -> bool:
    return buckets > HEAVIEST and not heavy_keys(df, KEY, max(buckets // HEAVIEST, 1)).isEmpty()


def _write(df: DataFrame, path: str, buckets: int) -> None:
    if not buckets:
        df.write.mode("errorifexists").parquet(path)
        return
    # one file a bucket, so that it is read back as sorted
    writer = df.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY)
    table = _table_name(path)
    writer.mode("errorifexists").format("parquet").option("path", path).saveAsTable(table)


def _table_name(path: str) -> str:
    return f"clustered_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"


def open_clustered(spark: SparkSession, folder: str) -> Marketplace:
    """The marketplace stored in a folder by :func:`write_clustered`."""
    entries = {row["table"]: row for row in spark.read.parquet(f"{folder}/manifest").collect()}

    def load(name: str) -> DataFrame:
        path = f"{folder}/{name}"
        if not entries[name]["buckets"]:
            return spark.read.schema(SCHEMAS[name]).parquet(path)
        table = _table_name(path)
        if not spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
            spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet OPTIONS (path '{path}')"
                f" CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {entries[name]['buckets']} BUCKETS"
            )
        return spark.table(table)

    return Marketplace(load, [name for name, row in entries.items() if row["unique"]])


def from_clustered(report: Callable[[Marketplace], DataFrame], *tables: str) -> Callable[[Marketplace], DataFrame]:
    """The same report over the given tables once they are stored by order."""

    def run(m: Marketplace) -> DataFrame:
        spark = getattr(m, tables[0]).sparkSession
        folder = f"{scratch_root(spark)}/stallwise-{uuid.uuid4().hex}"
        keep_until_end(folder)
        write_clustered(m, folder, int(spark.conf.get("spark.sql.shuffle.partitions")), tables)
        return report(open_clustered(spark, folder))

    return run
