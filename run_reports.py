"""Run reports over stored marketplace tables: ``spark-submit run_reports.py --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from stallwise import REPORTS, Marketplace, run_report
from stallwise.plans.products_audit import category_translation_upsert, commit_translations
from stallwise.session import configure, scratch
from stallwise.sources.readers import conform
from stallwise.sources.sinks import versions_folder, write_reference_version, write_report
from stallwise.sources.versions import VersionLog


def arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--tables", help="folder with one parquet folder or CSV file per table")
    source.add_argument("--catalog", help="database of the session catalog that has the tables")
    parser.add_argument("--out", required=True, help="folder for one result per report")
    parser.add_argument("--report", action="append", choices=sorted(REPORTS), help="repeatable; all by default")
    parser.add_argument("--input-format", default="parquet", choices=["parquet", "csv"])
    parser.add_argument("--output-format", default="parquet", choices=["parquet", "csv"])
    parser.add_argument("--blank-as-null", action="store_true", help="read blanks and zero dates as NULL")
    parser.add_argument("--multi-line", action="store_true", help="CSV comments may hold line breaks")
    parser.add_argument("--any-spelling", action="store_true", help="compare keys and labels without regard to case and accents")
    parser.add_argument("--audit-keys", action="store_true", help="check primary keys first, for cheaper joins")
    parser.add_argument("--translation-version", type=int, help="stored version of the translations to read")
    parser.add_argument("--upsert-translations", type=int, metavar="VERSION", help="store this version first and read it")
    parser.add_argument("--commit-translations", action="store_true", help="upsert them through their commit log, and read it")
    return parser.parse_args()


def marketplace(spark: SparkSession, args: argparse.Namespace) -> Marketplace:
    if args.catalog:
        return Marketplace.from_catalog(spark, args.catalog)

    def tables(version: int | None) -> Marketplace:
        versions = {} if version is None else {"category_translation": version}
        return Marketplace.from_folder(
            spark, args.tables, args.input_format, versions=versions, blank_as_null=args.blank_as_null, multi_line=args.multi_line
        )

    if args.commit_translations:
        market = tables(args.translation_version)
        log = VersionLog(spark, f"{args.tables.rstrip('/')}/category_translation_log")
        version = commit_translations(log, market.category_translation)
        return market.replace(category_translation=conform(log.read(version), "category_translation"))
    if args.upsert_translations is None:
        return tables(args.translation_version)
    upserted = category_translation_upsert(tables(args.translation_version))
    write_reference_version(upserted, versions_folder(args.tables, "category_translation"), args.upsert_translations)
    return tables(args.upsert_translations)


def main() -> None:
    args = arguments()
    spark = configure(SparkSession.builder.appName("marketplace reports").getOrCreate())
    with scratch(spark):
        tables = marketplace(spark, args)
        tables = tables.any_spelling() if args.any_spelling else tables
        tables = (tables.audited() if args.audit_keys else tables).sharing()
        for name in args.report or REPORTS:
            write_report(run_report(name, tables), f"{args.out}/{name}", args.output_format)
    spark.stop()


if __name__ == "__main__":
    main()
