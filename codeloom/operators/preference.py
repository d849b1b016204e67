"""Preferred extractions as events: set and clear with guards, an audit row each, the current marker, and what held when."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.asof import at_times, carried

BUCKET = "day"


def audit(events: DataFrame, extractions: DataFrame) -> DataFrame:
    """``events`` (event_id, build_id, action, extraction_id, reason, moment) in their order, with outcome, previous and current.

    A set counts if the extraction exists and is of that build. A clear counts if the build prefers the very extraction that it
    names. ``previous`` and ``current`` are the build's extraction before and after an event that counts.
    """
    owner = extractions.select("extraction_id", F.col("build_id").alias("_owner"))
    rows = events.join(owner, "extraction_id", "left")
    valid = (F.col("action") == "Set") & F.coalesce(F.col("_owner") == F.col("build_id"), F.lit(False))
    bucket = F.date_trunc(BUCKET, "moment")
    order = ["moment", "event_id"]
    rows = carried(rows, "build_id", order, F.when(valid, F.struct("event_id", "extraction_id")), bucket, "_set")
    # between two sets the first clear of what was set counts, and no other can
    clears = rows.where((F.col("action") == "Clear") & (F.col("_set.extraction_id") == F.col("extraction_id")))
    counts = clears.groupBy(F.col("_set.event_id").alias("_of")).agg(F.min(F.struct("moment", "event_id")).alias("f")).select("f.event_id", F.lit(True).alias("_cleared"))
    rows = rows.join(counts, "event_id", "left")
    outcome = (
        F.when(valid, "Set").when(F.col("_cleared"), "Cleared").when(F.col("action") == "Clear", "NotPreferred").when(F.col("_owner").isNull(), "UnknownExtraction").otherwise("OtherBuild")
    )
    rows = rows.withColumn("outcome", outcome)
    current = F.when(F.col("outcome") == "Set", F.col("extraction_id"))
    effective = F.col("outcome").isin("Set", "Cleared")
    rows = carried(rows, "build_id", order, F.when(effective, F.struct(current.alias("x"))), bucket, "_before", before_only=True)
    return rows.select("event_id", "build_id", "action", "extraction_id", "reason", "moment", "outcome", F.when(effective, F.col("_before.x")).alias("previous"), current.alias("current"))


def current(audited: DataFrame) -> DataFrame:
    """build_id, extraction_id, reason, selected_at: what each build prefers after all events."""
    last = audited.where("outcome IN ('Set', 'Cleared')").groupBy("build_id").agg(F.max(F.struct("moment", "event_id", "current", "reason")).alias("e"))
    return last.where("e.current IS NOT NULL").select("build_id", F.col("e.current").alias("extraction_id"), "e.reason", F.col("e.moment").alias("selected_at"))


def marked(extractions: DataFrame, preferred: DataFrame) -> DataFrame:
    """``extractions`` with ``is_preferred``."""
    mark = preferred.select("build_id", F.col("extraction_id").alias("_preferred"))
    return extractions.join(mark, "build_id", "left").withColumn("is_preferred", F.coalesce(F.col("_preferred") == F.col("extraction_id"), F.lit(False))).drop("_preferred")


def preferred_at(requests: DataFrame, audited: DataFrame) -> DataFrame:
    """``requests`` (request_id, build_id, moment) with ``preferred``, null if none was at that time."""
    facts = audited.where("outcome IN ('Set', 'Cleared')").select(F.col("event_id").alias("fact_id"), "moment", "build_id", "current")
    return at_times(requests, facts, "build_id", F.col("current"), BUCKET, "preferred")
