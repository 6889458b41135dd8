"""A log table that is appended to under a precondition.

Each version of the log is a folder of Parquet files and a manifest that names
it. A writer reads the newest version, merges, prunes, writes its folder, and
creates the next manifest only if nobody has: creating a file that must not be
there is one step for file systems that Spark's Hadoop layer knows to be atomic
at it (local disks, HDFS). Who loses the race reads the log again and retries
once; a folder without manifest is never seen by readers. A manifest that its
writer has not filled yet, or never will, holds other writers off, as its rows
may still come; readers keep to the version before it, and repair() takes it
away once its writer is known to be gone.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attempts of an append, and seconds that one waits for a manifest to be filled.
ATTEMPTS, PATIENCE = 2, 5.0


class LostRace(RuntimeError):
    """Another writer committed first, at every attempt."""


class VersionedLog:
    """A log at a path, as versions 1, 2, ...; readers see whole versions only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int):
        return self._path(f"{self.path}/_versions/{version:020d}.json")

    def version(self) -> int:
        """The newest version, 0 before the first."""
        folder = self._path(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=0)

    def _entry(self, version: int) -> dict | None:
        """What a manifest says; None while it is not filled."""
        line = self.spark.read.option("wholetext", True).text(self._manifest(version).toString()).first()
        try:
            return json.loads(line["value"]) if line else None
        except ValueError:
            return None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The log's rows at a version, by default the newest whole one; None before the first."""
        at = self.version() if version is None else version
        entry = self._entry(at) if at else None
        if entry is None and version is None and at > 1:
            entry = self._entry(at - 1)
        return None if entry is None else self.spark.read.schema(entry["schema"]).parquet(f"{self.path}/{entry['folder']}")

    def repair(self) -> bool:
        """Take away a newest manifest without content, whose writer is gone; whether there was one."""
        at = self.version()
        return bool(at and self._entry(at) is None and self._fs.delete(self._manifest(at), False))

    def commit(self, rows: DataFrame, onto: int) -> bool:
        """rows as version onto + 1; False if another writer was first."""
        folder = f"rows-{onto + 1:020d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        entry = json.dumps({"version": onto + 1, "folder": folder, "schema": _ddl(rows)})
        try:
            out = self._fs.create(self._manifest(onto + 1), False)
        except Py4JJavaError as error:
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()) or self._fs.exists(self._manifest(onto + 1)):
                return False
            raise
        out.write(bytearray(entry.encode()))
        out.close()
        return True

    def append(self, rows: DataFrame, prune: Callable[[DataFrame], DataFrame] | None = None, newest_first: str | None = None, before_commit: Callable[[], None] | None = None) -> int:
        """The log with rows behind what is there, columns of either filled with
        nulls, then pruned and sorted; the version written. Rows that are there
        already stay as they are. Raises LostRace after ATTEMPTS lost races."""
        for _ in range(ATTEMPTS):
            at, waited = self.version(), 0.0
            while at and self._entry(at) is None and waited < PATIENCE:
                time.sleep(0.1)
                waited += 0.1
            there = self.read(at)
            if at and there is None:
                raise LostRace(f"{self.path}: version {at} was begun and not filled")
            merged = rows if there is None else there.unionByName(rows, allowMissingColumns=True)
            merged = merged if prune is None else prune(merged)
            if newest_first in merged.columns:
                merged = merged.orderBy(F.desc_nulls_last(newest_first))
            if before_commit:
                before_commit()
            if self.commit(merged, at):
                return at + 1
        raise LostRace(f"{self.path}: another writer was first {ATTEMPTS} times")

    def forget(self, keep: int = 2) -> None:
        """Delete the rows of versions before the newest `keep`, and folders that no manifest names and that are older than the newest version."""
        newest = self.version()
        live = {entry["folder"] for v in range(max(1, newest - keep + 1), newest + 1) if (entry := self._entry(v))}
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith("rows-") and name not in live and int(name[5:25]) <= newest:
                self._fs.delete(status.getPath(), True)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def drop_expired(ids: str, expired: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """For append(prune=...): without the rows of jobs that have wholly expired."""
    return lambda log: log.where(F.col(ids).isNull() | ~F.col(ids).isin(list(expired))) if expired else log


def drop_older(ts: str, cutoff: str) -> Callable[[DataFrame], DataFrame]:
    """For append(prune=...): without rows before the cutoff; a time that cannot be read stays."""
    from .writers import retained

    return lambda log: retained(log, ts, F.lit(cutoff).cast("timestamp"))
