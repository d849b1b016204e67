"""Choosing the input of an extraction by precedence, and reading tables of several schema versions as one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import fold

#: Kinds of candidates without an explicit choice, the first kind first.
PRECEDENCE = ("observation", "default", "archive")


def implicit(candidates: DataFrame) -> DataFrame:
    """build_id, chosen, source, archive_failed: for each build its best valid candidate.

    ``candidates`` has candidate_id, build_id, kind, root, newness (larger is tried first), valid, replay_verified. Kinds come in
    order, then the newest, then the larger id. A root that was tried, whatever its case, is not tried again. Archives that
    were not replayed are no candidates. Both steps combine before their shuffle, so a build may have any number.
    """
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("kind"))
    tried = candidates.where((rank > 0) & ((F.col("kind") != "archive") | F.col("replay_verified")))
    first = tried.groupBy("build_id", fold(F.regexp_replace(F.regexp_replace("root", r"\\", "/"), "/+$", "")).alias("root")).agg(F.max(F.struct((-rank).alias("rank"), "newness", "candidate_id", "kind", "valid")).alias("c"))
    best = F.max(F.when(F.col("c.valid"), F.struct("c.rank", "c.newness", "c.candidate_id", "c.kind")))
    failed = F.coalesce(F.max((F.col("c.kind") == "archive") & ~F.col("c.valid")), F.lit(False))
    return first.groupBy("build_id").agg(best.alias("b"), failed.alias("archive_failed")).select("build_id", F.col("b.candidate_id").alias("chosen"), F.col("b.kind").alias("source"), "archive_failed")


def choose(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """request_id, outcome, candidate_id of requests (request_id, build_id, snapshot, path).

    A snapshot and a path exclude each other. A named snapshot must be a valid archive of the build, replayed or not, and a
    named path is taken as it is. Otherwise the implicit choice holds; without one, an archive that failed is told apart from
    finding nothing.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    asked = requests.select("request_id", "build_id", blank("snapshot").alias("snapshot"), blank("path").alias("path"))
    stored = candidates.where("kind = 'archive'").select(F.col("candidate_id").alias("snapshot"), F.col("build_id").alias("_build"), F.col("valid").alias("_valid"))
    met = asked.join(stored, "snapshot", "left").join(implicit(candidates), "build_id", "left")
    sound = F.coalesce(F.col("_valid") & (F.col("_build") == F.col("build_id")), F.lit(False))
    both = F.col("snapshot").isNotNull() & F.col("path").isNotNull()
    outcome = (
        F.when(both, "Exclusive").when(F.col("snapshot").isNotNull(), F.when(sound, "ExplicitSnapshot").otherwise("ArchivedInputInvalid")).when(F.col("path").isNotNull(), "ExplicitPath").when(F.col("chosen").isNotNull(), F.col("source"))
        .when(F.col("archive_failed"), "ArchivedInputInvalid").otherwise("LiveInputNotFound")
    )
    chosen = F.when(outcome == "ExplicitSnapshot", F.col("snapshot")).when(outcome.isin(*PRECEDENCE), F.col("chosen"))
    return met.select("request_id", outcome.alias("outcome"), chosen.alias("candidate_id"))


#: Columns that the second version of the schema adds to environments, with what older rows get.
ADDED = {"identity_version": "1", "executable_version": None, "steam_app_id": None, "steam_build_id": None, "installation_root": None}


def upgraded_builds(builds: DataFrame) -> DataFrame:
    """Builds of any version in the shape of the second: a renamed time, and without what moved to environments."""
    out = builds.withColumnRenamed("scanned_at", "first_seen") if "first_seen" not in builds.columns else builds
    return out.drop("game_version", "steam_build_id")


def upgraded_environments(environments: DataFrame, builds: DataFrame) -> DataFrame:
    """Environments of any version in the shape of the second, filled from the builds as they were. Rows that are of the second
    version already are unchanged, so doing it again changes nothing."""
    if "identity_version" in environments.columns:
        return environments
    types = {"identity_version": "int"}
    out = environments.withColumns({c: F.lit(v).cast(types.get(c, "string")) for c, v in ADDED.items()})
    if "game_version" not in builds.columns:
        return out
    old = builds.select("build_id", F.col("game_version").alias("_version"), F.col("steam_build_id").alias("_steam"))
    out = out.join(old, "build_id", "left").withColumns({"executable_version": F.col("_version"), "steam_build_id": F.col("_steam")})
    return out.select(*environments.columns, *ADDED)


def as_one(versions: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Environments of several (environments, builds), each of its own version, the oldest first; of one id the latest holds."""
    rows = None
    for n, (environments, builds) in enumerate(versions):
        one = upgraded_environments(environments, builds).withColumn("_n", F.lit(n))
        rows = one if rows is None else rows.unionByName(one)
    rest = [c for c in rows.columns if c not in ("snapshot_id", "_n")]
    return rows.groupBy("snapshot_id").agg(F.max_by(F.struct(*rest), "_n").alias("r")).select("snapshot_id", "r.*")
