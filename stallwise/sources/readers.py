"""Readers for parquet and CSV with declared schemas.

Whatever a table comes from, its columns are found by name and brought to the
declared types. A missing column, and a value that its type cannot hold, is an
error; only blanks and zero dates may become NULL, on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwise.sources.schemas import SCHEMAS

TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
ZERO_DATE_PATTERN = r"^0000-00-00( 00:00:00)?$"
_WIDE = T.DecimalType(38, 18)


def read_table(
    spark: SparkSession,
    folder: str,
    table: str,
    file_format: str = "parquet",
    blank_as_null: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """One marketplace table from ``folder``.

    Columns are taken by name; further ones are left out. CSV is read strictly: a
    value that does not fit its type, or a row that does not fit the header, fails the
    job. With ``blank_as_null`` blanks and zero dates (``0000-00-00 00:00:00``) become
    NULL, as loads from a lenient database leave them behind. ``multi_line`` accepts line
    breaks inside quoted comments, at the price of one task per file, so such a table
    should come as many files.
    """
    if file_format == "parquet":
        df = conform(spark.read.parquet(f"{folder}/{table}"), table)
        return _blank_strings_to_null(df) if blank_as_null else df
    if file_format != "csv":
        raise ValueError(f"unsupported format: {file_format}")
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    path = f"{folder}/{table}.csv"
    # The header says where the columns are; an empty field is NULL, a quoted one an empty string.
    names = reader.option("inferSchema", False).csv(path).columns
    text = T.StructType([T.StructField(name, T.StringType(), True) for name in names])
    raw = reader.option("mode", "FAILFAST").schema(text).csv(path)
    if blank_as_null:
        raw = raw.select(*[_not_blank(name).alias(name) for name in names])
    return conform(raw, table)


def conform(df: DataFrame, table: str) -> DataFrame:
    """The declared columns of a table, by name and in their declared types."""
    missing = [f.name for f in SCHEMAS[table] if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return df.select(*[_typed(df.schema[f.name], f.dataType).alias(f.name) for f in SCHEMAS[table]])


def _typed(found: T.StructField, wanted: T.DataType) -> Column:
    """A column in the wanted type. A value that would be lost or changed fails the job."""
    value, refused = _checked(found, wanted)
    if refused is None:
        return value
    reason = F.concat(F.lit(f"{_not_a(found, wanted)}: "), F.col(found.name).cast("string"))
    return F.when(refused, F.raise_error(reason).cast(wanted)).otherwise(value)


def _not_a(found: T.StructField, wanted: T.DataType) -> str:
    return f"not a {wanted.simpleString()} in {found.name}"


def _checked(found: T.StructField, wanted: T.DataType) -> tuple[Column, Column | None]:
    """A column in the wanted type, and whether a value would be lost or changed by it (None: never).

    Doubles are rounded to the places of a decimal, half up, as they cannot hold them exactly.
    """
    column, kind = F.col(found.name), found.dataType
    if kind == wanted:
        return column, None
    if isinstance(wanted, T.StringType):
        return column.cast(wanted), None
    value = column.try_cast(wanted)
    if isinstance(kind, T.StringType) and isinstance(wanted, T.TimestampNTZType):
        value = F.when(column.rlike(TIMESTAMP_PATTERN), value)
    kept = value.isNotNull()
    if isinstance(wanted, T.DecimalType) and not isinstance(kind, (T.DoubleType, T.FloatType)):
        kept = kept & (column.try_cast(_WIDE) == value.cast(_WIDE))
    elif isinstance(wanted, T.IntegerType) and not isinstance(kind, T.StringType):
        kept = kept & (column.cast("double") == value.cast("double"))
    return value, column.isNotNull() & ~F.coalesce(kept, F.lit(False))


def _not_blank(name: str) -> Column:
    blank = F.col(name).rlike(r"^\s*$") | F.col(name).rlike(ZERO_DATE_PATTERN)
    return F.when(~blank, F.col(name))


def _blank_strings_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            _not_blank(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema
        ]
    )
