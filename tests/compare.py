"""Run each query in Spark and its SQL in DuckDB, and compare rows and types."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between the two results, or None."""
    cursor = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected_rows = cursor.fetchall()
    names = sorted(kinds)
    if sorted(spark_df.columns) != names:
        return f"columns {sorted(spark_df.columns)} != {names}"
    types = {n: (t, KINDS.get(kinds[n], kinds[n])) for n, t in spark_df.dtypes if t != KINDS.get(kinds[n], kinds[n])}
    if types:
        return f"types differ: {types}"
    order = [list(kinds).index(n) for n in names]
    expected = Counter(tuple(row[i] for i in order) for row in expected_rows)
    found = Counter(tuple(row[n] for n in names) for row in spark_df.collect())
    if expected != found:
        return f"missing {list((expected - found).items())[:3]}, surplus {list((found - expected).items())[:3]}"
    return None


def main(folder: str, only: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = contract.queries(), contract.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if only and name not in only:
            continue
        problem = difference(query(spark, folder), con, oracles[name]) if name in oracles else "no SQL"
        failed += problem is not None
        print(f"{name}: {problem or 'equal'}", flush=True)
    print(f"{failed} of {len(only or queries)} differ")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
