"""Lineage: latest runs, authority of builds, history, presence, and lifecycle rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLEANABLE = ("Failed", "Canceled", "Abandoned")
#: The statuses of an attempt and those that may follow each. What is not named here is terminal.
FOLLOWING = {
    "Created": ("Preparing", "Validating", *CLEANABLE),
    "Preparing": ("Running", *CLEANABLE),
    "Running": ("ProcessCompleted", *CLEANABLE),
    "ProcessCompleted": ("Validating",),
    "Validating": ("Succeeded", *CLEANABLE),
}
LEGAL = tuple((before, after) for before, afters in FOLLOWING.items() for after in afters)


def latest_completed(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The latest completed run of each lineage, ties to the larger id; runs combine before the shuffle."""
    rest = [c for c in runs.columns if c not in (*keys, "completed_at", "index_id")]
    last = runs.where("status = 'Completed'").groupBy(*keys).agg(F.max(F.struct("completed_at", "index_id", *rest)).alias("r"))
    return last.select(*keys, "r.*")


def adjacent(builds: DataFrame, bucket: str = "month") -> DataFrame:
    """Each build with the next one by first sight: within spans of time, and from the last of a span to the first of the
    next that has any."""
    rows = builds.select("build_id", "first_seen", F.date_trunc(bucket, "first_seen").alias("span"))
    inside = rows.withColumn("next", F.lead("build_id").over(Window.partitionBy("span").orderBy("first_seen", "build_id")))
    firsts = rows.groupBy("span").agg(F.min(F.struct("first_seen", "build_id")).alias("f"))
    firsts = firsts.select("span", F.lead("f.build_id").over(Window.orderBy("span")).alias("after"))  # a row a span
    return inside.join(firsts, "span").select("build_id", F.coalesce("next", "after").alias("next_build_id")).where("next_build_id IS NOT NULL")


def presence(symbols: DataFrame, builds: DataFrame) -> DataFrame:
    """Per key and build whether the key is there: one aggregate of the keys, opened by the few builds."""
    seen = symbols.groupBy("canonical_key").agg(F.collect_set("k").alias("ks"))
    all_builds = builds.agg(F.sort_array(F.collect_set("k")).alias("all"))
    opened = seen.crossJoin(F.broadcast(all_builds)).select("canonical_key", "ks", F.explode("all").alias("k"))
    return opened.select("canonical_key", "k", F.array_contains("ks", F.col("k")).alias("present"))


def violations(attempts: DataFrame) -> DataFrame:
    """Changes of status of one user's attempts, in their order, that are not legal."""
    w = Window.partitionBy("user_id").orderBy("changed_at", "attempt_id")
    moves = attempts.withColumn("before", F.lag("status").over(w)).where("before IS NOT NULL AND before <> status")
    legal = attempts.sparkSession.createDataFrame(LEGAL, "before string, status string")
    return moves.join(F.broadcast(legal), ["before", "status"], "left_anti")


def cleanup_plan(attempts: DataFrame, cutoff: Column) -> DataFrame:
    """Attempts that may go, completed strictly before the cutoff, and why others stay: one without a time of completion, or
    that has a result, is kept."""
    reason = (
        F.when(~F.col("status").isin(*CLEANABLE), "NotCleanable").when(F.col("completed_at").isNull(), "NotCompleted").when(F.col("completed_at") >= cutoff, "TooRecent")
        .when(F.col("result_id").isNotNull(), "HasResult").otherwise("Eligible")
    )
    return attempts.select("attempt_id", "status", reason.alias("reason"))


def cleanup_decisions(attempts: DataFrame, cutoff: Column) -> DataFrame:
    """kind, id, decision: ended attempts from before the cutoff that may go (Eligible) or why they stay, and what lies in the
    staging folder.

    ``attempts`` has attempt_id, build_id, status, completed_at, result_id, candidate_output, journal, blocked (the tree could not
    be looked at), evidence (it holds files of a completion), staged (what lies in staging under the attempt's name).
    The first reason that holds is given.
    """
    ended = attempts.where(F.col("status").isin(*CLEANABLE) & (F.col("completed_at") < cutoff))
    safe = (F.col("build_id") != "") & ~F.col("build_id").rlike(r"[:/\\\x00-\x1f\x7f]") & ~F.col("build_id").isin(".", "..") & F.col("attempt_id").rlike("^[0-9a-f]{32}$")
    decision = (
        F.when(~F.coalesce(safe, F.lit(False)), "CleanupUnsafeIdentity").when(F.col("result_id").isNotNull(), "CleanupHasResultExtraction").when(F.col("candidate_output").isNotNull(), "CleanupCandidateOutput")
        .when(F.col("journal"), "CleanupPromotionJournal").when(F.col("blocked"), "CleanupTreeBlocked").when(F.col("evidence"), "CleanupCompletionEvidence").otherwise("Eligible")
    )
    return ended.select(F.lit("TerminalAttempt").alias("kind"), F.col("attempt_id").alias("id"), decision.alias("decision"))


def staging_decisions(entries: DataFrame, attempts: DataFrame, cutoff: Column) -> DataFrame:
    """kind, id, decision of what lies in staging folders (``entries``: name, is_folder). A journal, an unknown name, a folder with
    a journal, one of no attempt, and one of an attempt that has not ended before the cutoff stay; others may go."""
    ending = ".promotion.json"
    stem = F.when(F.col("name").endswith(ending), F.regexp_replace("name", r"\.promotion\.json$", ""))
    journals = entries.where(stem.isNotNull()).select(stem.alias("name"), F.lit(True).alias("journalled")).distinct()
    known = attempts.select(F.col("attempt_id").alias("name"), "status", "completed_at")
    met = entries.join(journals, "name", "left").join(known, "name", "left")
    named = F.col("is_folder") & F.col("name").rlike("^[0-9a-f]{32}$")
    decision = (
        F.when(stem.isNotNull(), "CleanupPromotionJournal").when(~named, "CleanupUnknownEntry").when(F.col("journalled"), "CleanupPromotionJournal").when(F.col("status").isNull(), "CleanupOrphanStaging")
        .when(~F.col("status").isin(*CLEANABLE), "CleanupActiveAttempt").when(F.col("completed_at").isNull() | (F.col("completed_at") >= cutoff), "CleanupTooRecent").otherwise("Eligible")
    )
    return met.select(F.lit("BuildStaging").alias("kind"), F.col("name").alias("id"), decision.alias("decision"))


def history(extractions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Extractions and failed attempts in one list, the newest first."""
    a = extractions.select(F.lit("Extraction").alias("entry"), F.col("extraction_id").alias("id"), F.lit(None).cast("string").alias("status"), F.col("created_at").alias("moment"))
    b = attempts.where(F.col("status").isin("Failed", "Canceled")).select(F.lit("Attempt").alias("entry"), F.col("attempt_id").cast("string").alias("id"), "status", F.col("changed_at").alias("moment"))
    return a.unionByName(b).orderBy(F.desc("moment"), F.desc("id"))


def append_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose keys are not there yet: what an insert that ignores repeats would add. Of repeats the least row
    is taken."""
    rest = [c for c in incoming.columns if c not in keys]
    once = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else incoming.distinct()
    return once.join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest version of each key of both; rows combine before the shuffle."""
    both = existing.unionByName(incoming)
    rest = [c for c in both.columns if c not in (*keys, version)]
    return both.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("r")).select(*keys, "r.*")
