"""Integrity of stored extractions: an inventory of their files against manifests, rows and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import path_is_safe

BUCKET_DIGITS = 3  # hexadecimal digits of a path's hash: files of an extraction are hashed in so many parts


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """extraction_id (the folder below ``root``), path (below that), content of all files.

    Spark reads no file without bytes, so those come from its list of names, which it holds on the driver for any read of files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    names = spark.createDataFrame([(name,) for name in files.inputFiles()], "name string")
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*(?=/)", "")
    listed = names.select(plain(F.url_decode(F.regexp_replace("name", r"\+", "%2B"))).alias("path"))
    empty = listed.join(files.select(plain(F.col("path")).alias("path")), "path", "left_anti").select("path", F.lit(b"").alias("content"))
    every = files.select(plain(F.col("path")).alias("path"), "content").unionByName(empty)
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = plain(F.lit(top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString()))
    below = F.substr("path", F.length(top) + 2)
    return every.select(F.substring_index(below, "/", 1).alias("extraction_id"), F.regexp_replace(below, "^[^/]*/", "").alias("path"), "content")


def inventory(files: DataFrame) -> DataFrame:
    """extraction_id, path, size, sha256 of files (extraction_id, path, content); contents stay where they are read."""
    return files.select("extraction_id", "path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """extraction_id, path, change (Added, Removed, Changed) between two inventories: what a capture finds when it looks again."""
    rows = lambda t, s: t.select("extraction_id", "path", F.struct("size", "sha256").alias(s))
    both = rows(before, "a").join(rows(after, "b"), ["extraction_id", "path"], "full_outer")
    change = F.when(F.col("a").isNull(), "Added").when(F.col("b").isNull(), "Removed").when(F.col("a") != F.col("b"), "Changed")
    return both.select("extraction_id", "path", change.alias("change")).where("change IS NOT NULL")


def line(path: Column, size: Column, sha256: Column) -> Column:
    return F.concat_ws("\t", path, size.cast("string"), sha256)


def summed(files: DataFrame) -> DataFrame:
    """extraction_id, files, bytes, digest. The digest is in the order of paths within parts by the path's hash, and of the parts:
    no list holds more than one part of an extraction."""
    parts = files.groupBy("extraction_id", F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, BUCKET_DIGITS).alias("part")).agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.array_sort(F.collect_list(F.struct("path", line(F.col("path"), F.col("size"), F.col("sha256")).alias("line")))).alias("lines")
    )
    hashed = parts.select("extraction_id", "part", "n", "bytes", F.sha2(F.array_join("lines.line", "\n"), 256).alias("hash"))
    return hashed.groupBy("extraction_id").agg(
        F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("part", "hash")))["hash"], "\n"), 256).alias("digest")
    )


def verify(records: DataFrame, manifest: DataFrame, artifacts: DataFrame, actual: DataFrame) -> DataFrame:
    """extraction_id, reason, files, bytes, digest for each of ``records`` (extraction_id, digest, files, bytes).

    Manifests, artifact rows and actual files (extraction_id, path, size, sha256) meet by path in one shuffle; flags of each kind
    of difference combine per extraction, and the first step that fails gives the reason. Repeated paths count as differences
    of the rows.
    """
    empty = F.lit(None).cast("struct<size:bigint,sha256:string>")
    sides = [("m", manifest), ("a", artifacts), ("f", actual)]
    rows = None
    for own, side in sides:
        one = side.select("extraction_id", "path", *((F.struct("size", "sha256") if own == s else empty).alias(s) for s, _ in sides))
        rows = one if rows is None else rows.unionByName(one)
    per_path = rows.groupBy("extraction_id", "path").agg(*(F.max(s).alias(s) for s, _ in sides), *(F.count(s).alias(f"n_{s}") for s, _ in sides))
    in_manifest, on_disk = F.col("m").isNotNull(), F.col("f").isNotNull()
    steps = [
        ("UnsafePath", in_manifest & ~path_is_safe(F.col("path"))), ("ManifestRowsDiffer", ~F.col("m").eqNullSafe(F.col("a")) | (F.col("n_m") > 1) | (F.col("n_a") > 1)), ("MissingFile", in_manifest & ~on_disk),
        ("ExtraFile", on_disk & ~in_manifest), ("SizeDiffers", F.col("m.size") != F.col("f.size")), ("HashDiffers", F.col("m.sha256") != F.col("f.sha256")),
    ]
    flags = per_path.groupBy("extraction_id").agg(*(F.max(F.coalesce(rule, F.lit(False)).cast("int")).alias(name) for name, rule in steps))
    sums = summed(manifest).select("extraction_id", F.col("files").alias("_files"), F.col("bytes").alias("_bytes"), F.col("digest").alias("_digest"))
    met = records.join(flags, "extraction_id", "left").join(sums, "extraction_id", "left")
    bad = lambda name: F.coalesce(F.col(name), F.lit(0)) == 1
    reason = F.when(F.col("_digest").isNull(), "NoManifest").when(bad("UnsafePath"), "UnsafePath").when(F.col("_digest") != F.col("digest"), "DigestDiffers")
    for name, _ in steps[1:]:
        reason = reason.when(bad(name), name)
    reason = reason.when((F.col("_files") != F.col("files")) | (F.col("_bytes") != F.col("bytes")), "StatisticsDiffer").otherwise("Verified")
    return met.select("extraction_id", reason.alias("reason"), F.col("_files").alias("files"), F.col("_bytes").alias("bytes"), F.col("_digest").alias("digest"))
