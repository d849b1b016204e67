"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_M = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Only a session in one process may lack it,
    as in tests: it gets a temporary folder; elsewhere other machines would not see that, so it is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables of one job, as Parquet in the shared folder. Each write ends its lineage: Spark then removes
    the shuffle files of the write, and a lost executor costs nothing that was written.

    With ``measured``, a side of a join that is not tiny is broadcast for its size once it is there, not for an estimate: Spark
    takes the size of compressed files for what they hold, and the rows of an explode for as many as go in."""

    def __init__(self, spark: SparkSession, measured: bool = False):
        self.spark, self.folder, self.measured = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", measured
        self.written = 0

    def put(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path, self.written = f"{self.folder}/{name}-{self.written}", self.written + 1
        own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(_WRITE_BATCH)}
        if self.measured:
            limit = self.spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
            own["spark.sql.adaptive.autoBroadcastJoinThreshold"] = self.spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or limit
            if _bytes(limit) > _TINY:
                own["spark.sql.autoBroadcastJoinThreshold"] = str(_TINY)
        before = {key: self.spark.conf.get(key, None) for key in own}
        try:
            for key, value in own.items():
                self.spark.conf.set(key, value)
            df.write.option("compression", compression).parquet(path)
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that no later read needs."""
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _bytes(size: str) -> int:
    """Bytes of a size as Spark writes it, such as 10485760b, 256k or 10MB."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder as Parquet and read it again."""
    return Scratch(df.sparkSession).put(df, name, compression)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo: the fold that a row belongs to. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def quantile(values: DataFrame, column: str, share: float) -> float | None:
    """The value of ``column`` (numbers, none null or NaN) with ``share`` of the rows below it, exactly: the one at place
    floor(share * (rows - 1)), from 0, of all in order. None without rows.

    Rows are counted in bins between the least and the greatest value, then again within the bin that has the place, until
    it holds one value only. So the counts of bins alone reach the driver."""
    ends = values.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    place, low, high = math.floor(share * (ends["n"] - 1)), ends["low"], ends["high"]
    while ends["n"] and low < high:
        of_bin = F.floor((F.col(column) - F.lit(low)) / F.lit(high - low) * _BINS).alias("bin")
        bins = values.where(F.col(column).between(low, high)).groupBy(of_bin).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(bins.collect(), key=lambda r: r["bin"]):
            if place < r["n"]:
                low, high = r["low"], r["high"]
                break
            place -= r["n"]
    return low


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D, with A-Z in lower case; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of multiples spread over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))  # a random 64-bit code for each byte value
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BINS = 1024  # of a round of a quantile
_TINY = 256 << 10  # estimated bytes of a side that is broadcast without being measured
_CHUNK = 500_000  # bytes of text that are hashed at once
_WRITE_BATCH = 1000  # rows of an Arrow batch in writes of intermediate tables, whose rows hold whole texts or sets


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some lower-case texts, and where each text's words begin (one more entry at the
    end). Hashes are differences of prefix sums of byte codes times powers, so no word is touched by Python."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    begin, end = edges[0::2], edges[1::2]
    begin = begin[: len(end)]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw))[:-1], out=sums[1:])
    hashes = mix64((sums[end] - sums[begin]) * _powers(_INVERSE, len(raw))[begin] + (end - begin).astype(np.uint64))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(begin, starts)


def chunks(texts: Iterable[str | None], every_letter: bool = False):
    """(place of the first text, lower-case UTF-8 of some texts): about ``_CHUNK`` bytes at a time, whole texts each. A-Z
    become lower case, or every letter."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text.lower() if text and every_letter else text
        held.append(text.encode("utf-8", "surrogatepass").lower() if text else b"")
        size += len(held[-1])
        if size >= _CHUNK:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held
