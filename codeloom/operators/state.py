"""Guarded changes of states: each request is decided against the state that it expects.

A batch of requests sees the state before it. Of the requests of one key that hold, the first by time and id is taken and the
others have lost, as the state is no longer what they expected. A decision is a row with ``outcome``; rows of the
changed state go to a ``VersionedLog``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.lineage import CLEANABLE, FOLLOWING, LEGAL

STALE = "INTERVAL '60' MINUTE"  # fixed: a run that runs for longer may be started again
TERMINAL = tuple(sorted({after for afters in FOLLOWING.values() for after in afters} - set(FOLLOWING)))


def _decide(current: DataFrame, requests: DataFrame, key: str, outcome: Column, wins: tuple[str, ...]) -> DataFrame:
    """Requests (request_id, key, moment, ...) with the current row as ``now`` and their outcome."""
    now = current.select(key, F.struct("*").alias("now"))
    met = requests.join(now, key, "left").withColumn("outcome", outcome)
    first = met.where(F.col("outcome").isin(*wins)).groupBy(key).agg(F.min(F.struct("moment", "request_id")).alias("first"))  # combines before the shuffle
    held = F.col("first.request_id") == F.col("request_id")
    return met.join(first, key, "left").withColumn("outcome", F.when(F.col("outcome").isin(*wins) & ~held, "Lost").otherwise(F.col("outcome"))).drop("first")


def start_runs(current: DataFrame, requests: DataFrame) -> DataFrame:
    """Starts of runs: of one that is not there, has failed, or has been running for more than an hour."""
    status = F.col("now.status")
    stale = F.col("now.started_at") < F.col("moment") - F.expr(STALE)
    outcome = F.when(status.isNull(), "Started").when((status == "Failed") | ((status == "Running") & stale), "Restarted").when(status == "Running", "Running").otherwise("Completed")
    return _decide(current, requests, "index_id", outcome, ("Started", "Restarted"))


def started(decided: DataFrame) -> DataFrame:
    rows = decided.where("outcome IN ('Started', 'Restarted')")
    return rows.select("index_id", "snapshot_id", F.lit("Running").alias("status"), F.col("moment").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit(None).cast("string").alias("failure"))


def end_runs(current: DataFrame, requests: DataFrame) -> DataFrame:
    """Completions and failures (``failure`` not null) of runs that are running."""
    status = F.col("now.status")
    outcome = F.when(status.isNull(), "Missing").when(status != "Running", "NotRunning").when(F.col("failure").isNull(), "Completed").otherwise("Failed")
    return _decide(current, requests, "index_id", outcome, ("Completed", "Failed"))


def ended(decided: DataFrame) -> DataFrame:
    rows = decided.where("outcome IN ('Completed', 'Failed')")
    return rows.select("index_id", "now.snapshot_id", F.col("outcome").alias("status"), "now.started_at", F.col("moment").alias("completed_at"), "failure")


def transition(current: DataFrame, requests: DataFrame) -> DataFrame:
    """Changes of an attempt's status: legal from where it is, and only if status and time are the expected ones."""
    legal = F.lit(False)
    for before in FOLLOWING:
        legal = legal | ((F.col("now.status") == before) & F.col("next_status").isin(*(b for a, b in LEGAL if a == before)))
    outcome = (
        F.when(F.col("now.attempt_id").isNull(), "Missing").when(~F.coalesce(legal, F.lit(False)), "Illegal").when(F.col("now.status") != F.col("expected_status"), "StatusChanged")
        .when(~F.col("now.changed_at").eqNullSafe(F.col("expected_at")), "TimeChanged").otherwise("Moved")
    )
    return _decide(current, requests, "attempt_id", outcome, ("Moved",))


def moved(decided: DataFrame) -> DataFrame:
    end = F.when(F.col("next_status").isin(*TERMINAL), F.col("moment")).otherwise(F.col("now.completed_at"))
    return decided.where("outcome = 'Moved'").select("attempt_id", F.col("next_status").alias("status"), F.col("moment").alias("changed_at"), end.alias("completed_at"), "now.result_id", F.lit(False).alias("_deleted"))


def delete(current: DataFrame, requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Deletions of attempts that ended without a result, unchanged, and that are not the source of an extraction
    (``sources``: attempt_id)."""
    referenced = sources.select("attempt_id", F.lit(True).alias("is_source")).distinct()
    now = current.join(referenced, "attempt_id", "left")
    status = F.col("now.status")
    outcome = (
        F.when(F.col("now.attempt_id").isNull(), "Missing").when(~status.isin(*CLEANABLE), "NotTerminal").when(status != F.col("expected_status"), "StatusChanged")
        .when(~F.col("now.completed_at").eqNullSafe(F.col("expected_at")), "TimeChanged").when(F.col("now.result_id").isNotNull(), "HasResult").when(F.col("now.is_source"), "IsSource").otherwise("Deleted")
    )
    return _decide(now, requests, "attempt_id", outcome, ("Deleted",))


def deleted(decided: DataFrame) -> DataFrame:
    rows = decided.where("outcome = 'Deleted'")
    return rows.select("attempt_id", "now.status", "now.changed_at", "now.completed_at", "now.result_id", F.lit(True).alias("_deleted"))


def certify(inputs: DataFrame, marks: DataFrame) -> DataFrame:
    """``inputs`` (input_id, build_id, manifest_digest, verified_at) after marks (input_id, build_id, manifest_digest, moment): the
    first time is kept, and marks of another build or digest do not count."""
    first = marks.groupBy("input_id", "build_id", "manifest_digest").agg(F.min("moment").alias("marked_at"))
    return inputs.join(first, ["input_id", "build_id", "manifest_digest"], "left").withColumn("verified_at", F.coalesce("verified_at", "marked_at")).drop("marked_at")
