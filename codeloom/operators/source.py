"""Source text: spans and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import body_status, path_is_safe


def lines_of(text: Column) -> Column:
    """Lines of a text, whatever ends them."""
    return F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n")


def snippet(text: Column, start: Column, end: Column, context: int) -> Column:
    """Lines start to end (from 1) with some more on both sides, clipped to the text; null if they are not all there."""
    lines = lines_of(text)
    low = F.greatest(F.lit(1), start - context)
    high = F.least(F.size(lines), end + context)
    return F.when((start >= 1) & (end >= start) & (end <= F.size(lines)), F.array_join(F.slice(lines, low, high - low + 1), "\n"))


def selected(symbols: DataFrame, locations: DataFrame, records: DataFrame, files: DataFrame, context: int, provenance: str) -> DataFrame:
    """symbol_id, state, relative_path, sha256, byte_count, start_line, end_line, context_before, context_after, snippet, body_status,
    provenance: the checked source of each symbol, or why there is none.

    ``locations`` (symbol_id, source_file_id, start_line, end_line) name a file of ``records`` (source_file_id, relative_path,
    sha256, byte_count), whose content in ``files`` (relative_path, text) must have the recorded hash. A symbol with several
    locations, a location without a record and a path that leaves the root are faults of the index. Hashes are taken where
    files are read, and only files that are asked for are moved.
    """
    one = locations.groupBy("symbol_id").agg(F.count("*").alias("n"), F.min(F.struct("start_line", "end_line", "source_file_id")).alias("l"))
    placed = symbols.select("symbol_id", "kind", "body_recovery_status").join(one, "symbol_id", "left").select("symbol_id", "kind", "body_recovery_status", "n", "l.*")
    met = placed.join(records.select("source_file_id", "relative_path", "sha256", "byte_count"), "source_file_id", "left")
    safe = path_is_safe(F.col("relative_path"))
    asked = met.where(safe).select("relative_path").distinct()
    read = files.join(asked, "relative_path", "left_semi").select("relative_path", "text", F.sha2(F.col("text").cast("binary"), 256).alias("actual"))
    met = met.join(read, "relative_path", "left")
    there = F.col("end_line") <= F.size(lines_of(F.col("text")))
    state = (
        F.when(F.col("n").isNull(), "NoIndexedLocation").when(F.col("n") > 1, "SeveralLocations").when(F.col("relative_path").isNull(), "NoFileRecord").when(~safe, "UnsafePath").when(F.col("actual").isNull(), "FileMissing")
        .when(F.lower("sha256") != F.col("actual"), "HashMismatch").when(~F.coalesce(there & (F.col("start_line") >= 1), F.lit(False)), "SpanOutside").otherwise("Available")
    )
    met = met.withColumn("state", state)
    shown = lambda c, name: F.when(F.col("state") == "Available", c).alias(name)
    before, after = F.least(F.col("start_line") - 1, F.lit(context)), F.least(F.size(lines_of(F.col("text"))) - F.col("end_line"), F.lit(context))
    return met.select(
        "symbol_id", "state", *(shown(F.col(c), c) for c in ("relative_path", "sha256", "byte_count", "start_line", "end_line")), shown(before, "context_before"), shown(after, "context_after"),
        shown(snippet(F.col("text"), F.col("start_line"), F.col("end_line"), context), "snippet"), shown(body_status(F.col("kind"), F.col("body_recovery_status")), "body_status"), shown(F.lit(provenance), "provenance"),
    )


def verified(files: DataFrame) -> DataFrame:
    """Files whose content has the hash that is recorded."""
    return files.where(F.sha2(F.col("text").cast("binary"), 256) == F.col("sha256"))
