"""A log of changes in versions.

Each version is a folder of rows that one writer adds; it counts once a file with the version's number exists, which the file
system lets one writer create. So of two writers that started from the same version one wins, and the other sees
what was written and decides again. The current state is the latest row of each key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.snapshots import create_file


def replay(rows: DataFrame, keys: list[str], version: str = "_version") -> DataFrame:
    """The latest row of each key, without those that are deleted (``_deleted``). A version has one row a key at most; rows
    combine before they are shuffled, so a key with many versions is no load."""
    rest = [c for c in rows.columns if c not in keys and c != "_deleted"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(F.coalesce("_deleted", F.lit(False)).alias("_deleted"), *rest), version).alias("s"))
    return last.where("NOT s._deleted").select(*keys, *(F.col(f"s.{c}") for c in rest if c != version))


class VersionedLog:
    """A folder of versions, on any file system that Spark can reach. Rows carry what they were given, and ``_version``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """The latest version, 0 for none: names of files only. A version whose writer was lost before it wrote the folder's
        name counts, without rows."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return 0
        names = (f.getPath().getName() for f in files.listStatus(folder))
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def commit(self, rows: DataFrame, version: int, whole: bool = False) -> bool:
        """Add rows as that version; False, and nothing is seen of them, if another writer has made it. ``whole`` rows are all
        of the state, so readers need nothing before them."""
        folder = f"data/{version:020d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return create_file(self.spark, f"{self.path}/_versions/{version:020d}.json", json.dumps({"version": version, "folder": folder, "whole": whole}) + "\n")

    def rows(self, until: int | None = None) -> DataFrame | None:
        """All rows up to a version, from the latest whole one on; None without any."""
        if not self.version():
            return None
        found = self.spark.read.schema("version long, folder string, whole boolean").json(f"{self.path}/_versions").collect()  # a row a version
        found = sorted((r for r in found if r["folder"] and (until is None or r["version"] <= until)), key=lambda r: r["version"])
        start = max((i for i, r in enumerate(found) if r["whole"]), default=0)
        out = None
        for r in found[start:]:
            one = self.spark.read.parquet(f"{self.path}/{r['folder']}").withColumn("_version", F.lit(r["version"]))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def state(self, keys: list[str], until: int | None = None) -> DataFrame | None:
        rows = self.rows(until)
        if rows is None:
            return None
        return replay(rows if "_deleted" in rows.columns else rows.withColumn("_deleted", F.lit(False)), keys)

    def compact(self, keys: list[str]) -> bool:
        """Write the whole state as the next version."""
        now = self.version()
        state = self.state(keys, now)
        return state is not None and self.commit(state, now + 1, whole=True)

    def change(self, keys: list[str], decide: Callable[[DataFrame | None], DataFrame], changed: Callable[[DataFrame], DataFrame], tries: int = 3) -> DataFrame | None:
        """Decide requests against the current state and write what they change. ``decide`` gives a row for each request, and
        ``changed`` the rows of those that hold. If another writer was first, all are decided again; None if it
        was so each time."""
        for _ in range(tries):
            now = self.version()
            folder = f"{self.path}/decided/{uuid.uuid4().hex}"
            decide(self.state(keys, now) if now else None).write.parquet(folder)  # decided once, whatever becomes of executors
            decided = self.spark.read.parquet(folder)
            if self.commit(changed(decided), now + 1):
                return decided
        return None
