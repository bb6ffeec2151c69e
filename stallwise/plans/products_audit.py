"""Audit of products and the category translation table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions import text
from stallwise.functions.measures import count_where
from stallwise.marketplace import Marketplace
from stallwise.operators import audit, keys
from stallwise.plans.row_rules import rule_count, unusable
from stallwise.session import keep_until_end, scratch_root
from stallwise.sources.versions import VersionLog

# Result names of the NULL counts.
PRODUCT_NULLS = {
    "null_product_id": "product_id",
    "null_category": "product_category_name",
    "null_name_length": "product_name_length",
    "null_description_length": "product_description_length",
    "null_photos": "product_photos_qty",
}
DIMENSION_NULLS = {
    "null_weight": "product_weight_g",
    "null_length": "product_length_cm",
    "null_height": "product_height_cm",
    "null_width": "product_width_cm",
}

# Result names of the dimensions.
INVALID_DIMENSIONS = {
    "invalid_weight": "product_weight_g",
    "invalid_length": "product_length_cm",
    "invalid_height": "product_height_cm",
    "invalid_width": "product_width_cm",
}
# Translations to add to the reference table.
NEW_TRANSLATIONS = (
    ("pc_gamer", "PC Gamer"),
    ("portateis_cozinha_e_preparadores_de_alimentos", "Portable Kitchen & Food Processors"),
)


def products_null_audit(m: Marketplace) -> DataFrame:
    return audit.null_audit(m.products, PRODUCT_NULLS)


def products_null_dimensions(m: Marketplace) -> DataFrame:
    return audit.null_audit(m.products, DIMENSION_NULLS)


def products_empty_category(m: Marketplace, any_whitespace: bool = False) -> DataFrame:
    if not any_whitespace:
        return rule_count(m, "products", "empty_category_strings")
    blank = text.is_blank("product_category_name", any_whitespace)
    return audit.violation_count(m.products, blank, "empty_category_strings")


def products_duplicate_key(m: Marketplace) -> DataFrame:
    return keys.duplicate_keys(m.products, ["product_id"])


def untranslated_categories(m: Marketplace) -> DataFrame:
    return keys.uncovered_values(m.products, "product_category_name", m.category_translation)


def category_translation_upsert(m: Marketplace, rows: tuple[tuple[str, str], ...] = NEW_TRANSLATIONS) -> DataFrame:
    """Next version of the translation table; store it with ``write_reference_version``."""
    table = m.category_translation
    new = table.sparkSession.createDataFrame(list(rows), table.schema)
    return keys.upsert_reference(table, new, "product_category_name")


def after_upsert(
    report: Callable[[Marketplace], DataFrame], rows: tuple[tuple[str, str], ...] = NEW_TRANSLATIONS
) -> Callable[[Marketplace], DataFrame]:
    """The same report over the next version of the translation table."""
    return lambda m: report(m.replace(category_translation=category_translation_upsert(m, rows)))


def commit_translations(log: VersionLog, first: DataFrame, rows: tuple[tuple[str, str], ...] = NEW_TRANSLATIONS) -> int:
    """Commit the upsert to a log of the translation table, which starts as ``first``; gives the version that holds it.

    Writers at the same time each find their rows in the version they are given, and committing rows that are
    there changes nothing.
    """
    key = "product_category_name"
    new = first.sparkSession.createDataFrame(list(rows), first.schema)

    def change(table: DataFrame | None) -> DataFrame | None:
        if table is not None:
            there = table.select(F.col(key).alias("_there")).distinct()
            if new.join(there, new[key].eqNullSafe(there["_there"]), "left_anti").isEmpty():
                return None
        return keys.upsert_reference(first if table is None else table, new, key)

    return log.update(change)


def category_translation_log(m: Marketplace, rows: tuple[tuple[str, str], ...] = NEW_TRANSLATIONS) -> DataFrame:
    """The translation table committed as it is, then upserted twice: the newest version, and its number."""
    spark = m.category_translation.sparkSession
    log = VersionLog(spark, f"{scratch_root(spark)}/stallwise-{uuid.uuid4().hex}")
    keep_until_end(log.root)
    log.commit(m.category_translation, 0)
    commit_translations(log, m.category_translation, rows)
    version = commit_translations(log, m.category_translation, rows)
    return log.read(version).withColumn("version", F.lit(version).cast("bigint"))


def verify_translation_upsert(m: Marketplace, rows: tuple[tuple[str, str], ...] = NEW_TRANSLATIONS) -> DataFrame:
    """The upserted rows as found in the next version of the table."""
    names = [name for name, _ in rows]
    return audit.violating_rows(category_translation_upsert(m, rows), F.col("product_category_name").isin(*names))


def products_invalid_dimensions(m: Marketplace) -> DataFrame:
    return m.products.agg(*[count_where(F.col(c) <= 0).alias(name) for name, c in INVALID_DIMENSIONS.items()])


def unsold_products(m: Marketplace) -> DataFrame:
    return keys.orphan_count(m.products, m.order_items, "product_id", "unsold_products")


def products_extreme_dimensions(m: Marketplace) -> DataFrame:
    return rule_count(m, "products", "suspicious_dimensions")


def translation_empty_english(m: Marketplace, any_whitespace: bool = False) -> DataFrame:
    return _unusable(m, "product_category_name_english", any_whitespace, "empty_english_translations")


def translation_empty_source(m: Marketplace, any_whitespace: bool = False) -> DataFrame:
    return _unusable(m, "product_category_name", any_whitespace, "empty_portuguese_categories")


def _unusable(m: Marketplace, column: str, any_whitespace: bool, name: str) -> DataFrame:
    if not any_whitespace:
        return rule_count(m, "category_translation", name)
    return audit.violation_count(m.category_translation, unusable(column, any_whitespace), name)
