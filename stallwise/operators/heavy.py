"""Keys that hold a share of all rows, found without exchanging the others.

Candidates come from a summary of bounded size that tasks build and merge (frequent items by counters that are
lowered together, as by Misra and Gries): every key above the share is among them, whatever the partitioning. A second
pass counts the candidates alone, exactly, and drops those that fall short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions.measures import count_rows


def heavy_keys(df: DataFrame, key: str, one_in: int) -> DataFrame:
    """(key, rows) of the non-NULL keys that more than one in ``one_in`` of the rows have; fewer than ``one_in`` of them.

    Two scans; the driver sees at most twice ``one_in`` candidates, and only these reach an exchange.
    """
    counted = df.select(F.col(key).alias("key"))
    # the summary keeps 1 / support counters, so it errs by less than half of the share
    summary = counted.freqItems(["key"], 1 / (2 * one_in)).first()
    candidates = [value for value in (summary[0] or []) if value is not None]
    found = counted.sparkSession.createDataFrame([(value,) for value in candidates], counted.schema)
    rows = counted.agg(count_rows()).scalar()
    few = counted.join(F.broadcast(found), "key").groupBy("key").agg(count_rows().alias("rows"))
    return few.filter(F.col("rows") * one_in > rows).select(F.col("key").alias(key), "rows")
