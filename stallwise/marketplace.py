"""The eight marketplace tables as one lazily loaded unit."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stallwise.functions.text import one_spelling
from stallwise.operators.keys import duplicate_keys
from stallwise.session import materialise
from stallwise.sources.readers import conform, read_table
from stallwise.sources.schemas import FREE_TEXT, PRIMARY_KEYS, SCHEMAS
from stallwise.sources.sinks import read_reference_version, versions_folder

# Tables that reports fold by their primary key.
FOLDED_TABLES = ("orders", "customers", "products", "category_translation")


class Marketplace:
    """Access to the tables by attribute; each is loaded on first use.

    ``unique`` names tables whose primary key an audit has found free of
    duplicates. Reports then skip the step that folds copies of a key together,
    which saves one exchange. Without it results are exact for any input.
    """

    def __init__(self, load: Callable[[str], DataFrame], unique: Iterable[str] = ()):
        self._load = load
        self._tables: dict[str, DataFrame] = {}
        self._unique = frozenset(unique)
        self._shared: dict[str, DataFrame] | None = None
        unknown = self._unique - PRIMARY_KEYS.keys()
        if unknown:
            raise ValueError(f"tables without a primary key: {sorted(unknown)}")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self._load(name)
        return self._tables[name]

    def is_unique(self, table: str) -> bool:
        return table in self._unique

    def sharing(self) -> Marketplace:
        """Same marketplace, for a run of many reports: what several of them need is written
        once, as a scratch table, and read by each."""
        shared = Marketplace(lambda n: getattr(self, n), self._unique)
        shared._shared = {}
        return shared

    @property
    def is_sharing(self) -> bool:
        return self._shared is not None

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What ``build`` gives; in a sharing marketplace, stored on first use."""
        if self._shared is None:
            return build()
        if name not in self._shared:
            self._shared[name] = materialise(build())
        return self._shared[name]

    def audited(self) -> Marketplace:
        """Same marketplace, with tables whose primary key holds marked as unique.

        Costs one aggregate per keyed table that reports join on, and saves an
        exchange of that table in each report.
        """
        return Marketplace(
            lambda n: getattr(self, n),
            [t for t in FOLDED_TABLES if duplicate_keys(getattr(self, t), PRIMARY_KEYS[t]).isEmpty()],
        )

    def any_spelling(self) -> Marketplace:
        """Same marketplace, read as by a database whose collation ignores case and accents.

        Keys and labels come in one spelling, so filters, IN lists, groups, distinct values and key joins of
        every report agree on it, as plain byte comparisons, and results show it. Comments stay as they are.
        What an audit said of the primary keys no longer holds: two of them may differ in spelling only.
        """

        def load(name: str) -> DataFrame:
            table = getattr(self, name)
            texts = [f.name for f in table.schema if isinstance(f.dataType, T.StringType) and f.name not in FREE_TEXT]
            return table.withColumns({column: one_spelling(column) for column in texts})

        return Marketplace(load)

    def replace(self, **tables: DataFrame) -> Marketplace:
        """Same marketplace with some tables swapped, e.g. after an upsert."""
        return Marketplace(lambda n: tables[n] if n in tables else getattr(self, n), self._unique)

    @classmethod
    def from_frames(cls, frames: dict[str, DataFrame], unique: Iterable[str] = ()) -> Marketplace:
        """Given DataFrames; columns are taken by name and in their declared types."""
        return cls(lambda n: conform(frames[n], n), unique)

    @classmethod
    def from_folder(
        cls,
        spark: SparkSession,
        folder: str,
        file_format: str = "parquet",
        unique: Iterable[str] = (),
        versions: Mapping[str, int] | None = None,
        **read_options: bool,
    ) -> Marketplace:
        """Tables stored as ``<folder>/<table>`` (parquet) or ``<folder>/<table>.csv``.

        ``versions`` names reference tables of which a stored version is to be read.
        """
        versions = versions or {}

        def load(name: str) -> DataFrame:
            if name in versions:
                stored = read_reference_version(spark, versions_folder(folder, name), versions[name])
                return conform(stored, name)
            return read_table(spark, folder, name, file_format, **read_options)

        return cls(load, unique)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None, unique: Iterable[str] = ()) -> Marketplace:
        """Tables registered in the session catalog, brought to their declared types.

        Order-keyed tables bucketed by ``order_id`` join without an exchange.
        """
        prefix = f"{database}." if database else ""
        return cls(lambda n: conform(spark.table(f"{prefix}{n}"), n), unique)

    def register_views(self) -> None:
        """Expose every table as a temp view for users who write SQL."""
        for name in SCHEMAS:
            getattr(self, name).createOrReplaceTempView(name)
