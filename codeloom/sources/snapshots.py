"""Snapshots of tables that become visible at once.

Each attempt writes the tables of a snapshot below a folder of its own; one manifest file for each snapshot, written last and
created only if it does not exist, names the attempt that is published. So of two writers one publishes, whatever they
wrote before, and an attempt that was lost halfway is never seen.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file, or False if there is one: the file system lets one writer do it."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = files.create(name, False)
    except Py4JJavaError:
        if files.exists(name):
            return False
        raise
    out.write(text.encode())
    out.close()
    return True


class Store:
    """A folder of snapshots, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def stage(self, snapshot: str, tables: dict[str, DataFrame]) -> str:
        """Write tables without publishing them; the name of the attempt's folder."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9=-]*", snapshot):
            raise ValueError("a snapshot's name is letters, digits, = and -")
        folder = f"{snapshot}/{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.write.parquet(f"{self.path}/{folder}/{name}")
        return folder

    def _folders(self) -> dict[str, str]:
        """Published snapshots and their folders: a row each, of names only."""
        try:
            rows = self.spark.read.schema("snapshot string, folder string").json(f"{self.path}/_manifest")
            return {r["snapshot"]: r["folder"] for r in rows.collect()}
        except AnalysisException:  # nothing was published so far
            return {}

    def published(self) -> list[str]:
        return sorted(self._folders())

    def claim(self, snapshot: str, folder: str) -> bool:
        """Publish a staged attempt, unless the snapshot is published."""
        return create_file(self.spark, f"{self.path}/_manifest/{snapshot}.json", json.dumps({"snapshot": snapshot, "folder": folder}) + "\n")

    def publish(self, snapshot: str, tables: dict[str, DataFrame]) -> bool:
        """Write and publish; a published snapshot is never changed, and False is returned."""
        if snapshot in self._folders():
            return False
        return self.claim(snapshot, self.stage(snapshot, tables))

    def publish_checked(self, snapshot: str, tables: dict[str, DataFrame], problems) -> DataFrame | None:
        """Write all tables, then publish them if ``problems`` (of the tables as they were written) has no row. None if they are
        published; else the problems, and nothing of the attempt is seen. The first writer of a snapshot keeps it: for a
        later one the only problem is ``AlreadyPublished``."""
        if snapshot not in self._folders():
            folder = self.stage(snapshot, tables)
            found = problems({name: self.spark.read.parquet(f"{self.path}/{folder}/{name}") for name in tables})
            if not found.isEmpty():
                return found
            if self.claim(snapshot, folder):
                return None
        return self.spark.createDataFrame([("AlreadyPublished", None, snapshot)], "problem string, table_name string, row_id string")

    def unpublished(self) -> list[str]:
        """Folders of attempts that no snapshot names: names only."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        named, out = set(self._folders().values()), []
        for snapshot in files.listStatus(root):
            name = snapshot.getPath().getName()
            if snapshot.isDirectory() and not name.startswith("_"):
                out += [f"{name}/{a.getPath().getName()}" for a in files.listStatus(snapshot.getPath())]
        return sorted(f for f in out if f not in named)

    def sweep(self, older_than_ms: int) -> list[str]:
        """Remove attempts that are not published and were last written before a time (in milliseconds); a published one is
        never touched, nor one that may still be written."""
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = []
        for folder in self.unpublished():
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
            times = [files.getFileStatus(path).getModificationTime(), *(f.getModificationTime() for f in files.listStatus(path))]
            if max(times) < older_than_ms and folder not in self._folders().values():
                files.delete(path, True)
                gone.append(folder)
        return gone

    def read(self, table: str, snapshot: str | None = None) -> DataFrame:
        """A table of one published snapshot, or of all of them."""
        folders = [f for s, f in sorted(self._folders().items()) if snapshot in (None, s)]
        if not folders:
            raise ValueError("no such snapshot has been published")
        return self.spark.read.parquet(*(f"{self.path}/{f}/{table}" for f in folders))
