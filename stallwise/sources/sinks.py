"""Sinks: report tables and versions of reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_report(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Hand a report over to whatever reads it next, as parquet or CSV."""
    writer = df.write.mode("errorifexists")
    if file_format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(file_format).save(path)


def write_reference_version(df: DataFrame, root: str, version: int) -> str:
    """Store a new version of a reference table next to, never over, the old one."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def versions_folder(folder: str, table: str) -> str:
    """Where the versions of a reference table are kept, beside the tables."""
    return f"{folder.rstrip('/')}/{table}_versions"


def read_reference_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/version={version}")
