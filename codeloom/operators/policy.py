"""Decisions over validation results: outcome, preference, recovery of interrupted attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERRUPTIBLE = ("Created", "Preparing", "Running", "ProcessCompleted", "Validating")  # fixed: states that are not final


def outcomes(validations: DataFrame, issues: DataFrame) -> DataFrame:
    """``validations`` with outcome and preference_eligible.

    Output that left its folder is invalid whatever else holds. Then the worst severity decides; preference needs
    input and process integrity and no blocking issue. Issues are counted by flags, so none is gathered.
    """
    flags = issues.groupBy("attempt_id").agg(F.max((F.col("severity") == "Error").cast("int")).alias("error"), F.max((F.col("severity") == "Warning").cast("int")).alias("warning"), F.max(F.col("preference_blocking").cast("int")).alias("blocked"))
    out = validations.join(flags, "attempt_id", "left").na.fill(0, ["error", "warning", "blocked"])
    contained = F.coalesce("containment_passed", F.lit(False))
    outcome = F.when(~contained | (F.col("error") == 1), "Invalid").when(F.col("warning") == 1, "ValidWithWarnings").otherwise("Valid")
    sound = F.coalesce(F.col("input_integrity_passed") & F.col("process_integrity_passed"), F.lit(False))
    return out.withColumn("outcome", outcome).withColumn("preference_eligible", (F.col("outcome") != "Invalid") & sound & (F.col("blocked") == 0)).drop("error", "warning", "blocked")


def preference(results: DataFrame) -> Column:
    """Why a result becomes the preferred one by itself, or null: the first always, later only for another tool, never
    over a choice made by hand."""
    r = lambda c: results[c]
    eligible = (r("trust") == "ManagedPinned") & (r("outcome") != "Invalid") & r("preference_eligible")
    same = F.coalesce(r("preferred_id") == r("candidate_id"), F.lit(False))
    other_tool = F.coalesce(r("preferred_tool_id") != r("tool_id"), F.lit(False))
    return F.when(eligible, F.when(r("preferred_id").isNull(), "ManagedAutomatic").when(~same & (r("preferred_reason") != "ManualPromotion") & other_tool, "ReplacementAfterToolUpgrade"))


def recover(attempts: DataFrame, keep_artifacts: bool) -> DataFrame:
    """attempt_id, action, status, discarded of interrupted attempts (with owner_alive, child_alive, files): refused while a
    process lives, else abandoned, and its files discarded unless they are kept."""
    alive = F.coalesce(F.col("owner_alive"), F.lit(False)) | F.coalesce(F.col("child_alive"), F.lit(False))
    open_ = attempts.where(F.col("status").isin(*INTERRUPTIBLE))
    discarded = F.lit(0).cast("long") if keep_artifacts else F.when(alive, 0).otherwise(F.coalesce("files", F.lit(0))).cast("long")
    return open_.select("attempt_id", F.when(alive, "Refused").otherwise("Recovered").alias("action"), F.when(alive, F.col("status")).otherwise("Abandoned").alias("status"), discarded.alias("discarded"))
