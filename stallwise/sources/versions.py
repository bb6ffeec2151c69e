"""Numbered versions of a table behind a commit log.

A version is data in a folder of its own plus a log entry that names it. The data is written first, and the
entry is put last and only if no entry has that number, so a version is there in whole or not at
all: a writer that dies before leaves files that nothing names, and of two writers that started from one
version only one gets the next number. The other starts again from what the first has written.

The entry is put by a rename that does not overwrite (HDFS and file systems like it), on a local disk by a
hard link. An object store needs a file system that renames so.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_DIGITS = 20


class VersionConflict(RuntimeError):
    """Another writer has committed a version since the one that this change started from."""


class VersionLog:
    """The versions of one table below ``root``; the first one has number 1."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self._spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of all committed versions."""
        folder = self._path("log")
        if not self._files().exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files().listStatus(folder)]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and name[0] != ".")

    def latest(self) -> int:
        """Number of the newest version, 0 before the first."""
        return max(self.versions(), default=0)

    def entry(self, version: int) -> dict:
        stream = self._files().open(self._path("log", _name(version)))
        try:
            return json.loads(self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or a given one."""
        version = self.latest() if version is None else version
        if version not in self.versions():
            raise ValueError(f"no version {version} in {self.root}")
        return self._spark.read.parquet(f"{self.root}/{self.entry(version)['data']}")

    def write_data(self, df: DataFrame) -> str:
        """Store data that no version names yet; gives its folder below the root."""
        data = f"data/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.root}/{data}")
        return data

    def put_entry(self, version: int, data: str, **facts) -> None:
        """Make stored data the given version, unless there is one of that number."""
        files, unfinished, entry = self._files(), self._path("log", f".{uuid.uuid4().hex}"), self._path("log", _name(version))
        stream = files.create(unfinished, False)
        stream.write(bytearray(json.dumps({"version": version, "data": data, **facts}), "utf-8"))
        stream.close()
        try:
            if files.getUri().getScheme() == "file":
                os.link(unfinished.toUri().getPath(), entry.toUri().getPath())
            else:
                context = self._spark._jvm.org.apache.hadoop.fs.FileContext
                none = self._spark._sc._gateway.new_array(self._spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.getFileContext(entry.toUri(), self._spark._jsc.hadoopConfiguration()).rename(unfinished, entry, none)
        except Exception as error:
            if version in self.versions():
                raise VersionConflict(f"{self.root} already has version {version}") from error
            raise
        finally:
            files.delete(unfinished, False)

    def commit(self, df: DataFrame, base: int, **facts) -> int:
        """Store the version that follows ``base``; :class:`VersionConflict` if another has followed it."""
        data = self.write_data(df)
        try:
            self.put_entry(base + 1, data, base=base, **facts)
        except VersionConflict:
            self._files().delete(self._path(data), True)
            raise
        return base + 1

    def update(self, change: Callable[[DataFrame | None], DataFrame | None], attempts: int = 20, **facts) -> int:
        """Commit ``change`` of the newest version (None before the first), anew where another writer was faster.

        A change that gives None leaves the table as it is. Gives the number of the version that holds the change.
        """
        for _ in range(attempts):
            base = self.latest()
            changed = change(self.read(base) if base else None)
            if changed is None:
                return base
            try:
                return self.commit(changed, base, **facts)
            except VersionConflict:
                continue
        raise VersionConflict(f"{self.root}: another writer was faster {attempts} times")


def _name(version: int) -> str:
    return f"{version:0{_DIGITS}}.json"
