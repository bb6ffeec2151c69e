"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans count on. Sums of cents and counts are 64-bit
# integers: with ANSI mode an overflow fails instead of wrapping. A raw join side that carries a hot
# key is split at run time by the adaptive skew rule; "force" lets it do so even
# where the split costs the following aggregate one more exchange.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session and return it."""
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by the executors: ``spark.checkpoint.dir``, or the warehouse of a cluster where that is not set.

    A local session without the setting (tests) gets a fresh folder of its own. On a cluster a path of the ``file``
    scheme may be a mounted share or a machine's own disk, so it is tried, and refused if tasks do not share it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        if not folder:
            folder = tempfile.mkdtemp(prefix="stallwise-")
            spark.conf.set("spark.checkpoint.dir", folder)
        return folder.rstrip("/")
    folder = (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    if _scheme(spark, folder) == "file":
        _require_shared(spark, folder)
    return folder


# (application, folder) of those found shared
_shared: set[tuple[str, str]] = set()


def _require_shared(spark: SparkSession, folder: str) -> None:
    """Refuse a folder unless the driver and other tasks see what tasks write there.

    A task per core writes a row, and all are read back, once per application and folder.
    """
    path = f"{folder}/stallwise-probe-{uuid.uuid4().hex}"
    refused = f"{folder} is a folder which executors do not share: set spark.checkpoint.dir to one that they share"
    try:
        tried = spark.sparkContext.applicationId, folder
        if tried in _shared:
            return
        tasks = max(spark.sparkContext.defaultParallelism, 1)
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        found = spark.read.schema("id bigint").parquet(path).count()
    except Exception as error:  # whatever keeps tasks from writing or reading there
        raise ValueError(refused) from error
    finally:
        _file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    if found != tasks:
        raise ValueError(refused)
    _shared.add(tried)


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _scheme(spark: SparkSession, path: str) -> str:
    """Scheme of the file system that a path is on, its own or the default one."""
    return _file_system(spark, path).getUri().getScheme()


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch tables written inside the block when it ends.

    DataFrames that read them must have been written or collected by then.
    """
    written: list[str] = []
    _scopes.append(written)
    try:
        yield
    finally:
        _scopes.pop()
        for path in written:
            _file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def keep_until_end(path: str) -> None:
    """Inside :func:`scratch`, have a folder removed at the end of the block."""
    if _scopes:
        _scopes[-1].append(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a scratch table and return a DataFrame that reads it.

    The table is columnar and lives in the shared folder, so several narrow
    passes over it cost a column scan each and a lost executor costs nothing.
    Inside :func:`scratch` it is removed at the end of the block.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/stallwise-{uuid.uuid4().hex}"
    keep_until_end(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
