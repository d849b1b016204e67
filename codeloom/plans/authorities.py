"""Queries of builds: preferences as events, authority now and at a time, lineage, lists, scenes that rest on them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import authority, checks, lineage, preference
from codeloom.plans.registry import query

_AUDIT = """(WITH v AS (SELECT p.*, x.build_id AS owner, p.action = 'Set' AND coalesce(x.build_id = p.build_id, false) AS valid FROM preference_log p LEFT JOIN build_extractions x ON x.extraction_id = p.extraction_id),
 s AS (SELECT *, last_value(CASE WHEN valid THEN event_id END IGNORE NULLS) OVER w AS set_id, last_value(CASE WHEN valid THEN extraction_id END IGNORE NULLS) OVER w AS set_x FROM v WINDOW w AS (PARTITION BY build_id ORDER BY moment, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 c AS (SELECT *, action = 'Clear' AND coalesce(set_x = extraction_id, false) AS fits FROM s),
 o AS (SELECT *, CASE WHEN valid THEN 'Set' WHEN fits AND row_number() OVER (PARTITION BY build_id, set_id, fits ORDER BY moment, event_id) = 1 THEN 'Cleared' WHEN action = 'Clear' THEN 'NotPreferred' WHEN owner IS NULL THEN 'UnknownExtraction' ELSE 'OtherBuild' END AS outcome FROM c),
 e AS (SELECT event_id, lag(CASE WHEN outcome = 'Set' THEN extraction_id END) OVER (PARTITION BY build_id ORDER BY moment, event_id) AS previous FROM o WHERE outcome IN ('Set', 'Cleared'))
 SELECT o.event_id, build_id, action, extraction_id, reason, moment, outcome, previous, CASE WHEN outcome = 'Set' THEN extraction_id END AS current FROM o LEFT JOIN e ON e.event_id = o.event_id)"""
_LOG = "preference_log build_extractions"


def _audit(g):
    return preference.audit(g.preference_log, g.build_extractions)


@query(f"SELECT event_id, build_id, outcome, previous, current FROM {_AUDIT}", _LOG)
def preference_audit(g):
    return _audit(g).select("event_id", "build_id", "outcome", "previous", "current")


_CURRENT = f"(SELECT build_id, current AS extraction_id, reason, moment AS selected_at FROM (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY moment DESC, event_id DESC) AS n FROM {_AUDIT} WHERE outcome IN ('Set', 'Cleared')) WHERE n = 1 AND current IS NOT NULL)"


@query(f"SELECT * FROM {_CURRENT}", _LOG)
def preferred_extractions(g):
    return preference.current(_audit(g))


@query(f"SELECT x.extraction_id, x.build_id, coalesce(p.extraction_id = x.extraction_id, false) AS is_preferred FROM build_extractions x LEFT JOIN {_CURRENT} p ON p.build_id = x.build_id ORDER BY x.created_at DESC, x.extraction_id DESC", _LOG)
def extraction_list(g):
    return preference.marked(g.build_extractions, preference.current(_audit(g))).orderBy(F.desc("created_at"), F.desc("extraction_id")).select("extraction_id", "build_id", "is_preferred")


_RUNS = "(SELECT *, row_number() OVER (PARTITION BY {} ORDER BY completed_at DESC, index_id DESC) AS n FROM code_runs WHERE status = 'Completed' AND {})"
_BY_SOURCE = _RUNS.format("source_identity", "codebase = 'game' AND channel = 'installed'")
_STATUS = """CASE WHEN r.build_id IS NULL THEN 'NoCurrentBuild' WHEN r.explicit AND b.build_id IS NULL THEN 'BuildNotFound' WHEN r.preferred IS NULL THEN 'NoPreferredVerifiedExtraction' WHEN NOT coalesce(x.verified, false) THEN 'ExtractionIntegrityFailure'
 WHEN x.build_id <> r.build_id THEN 'IndexBuildMismatch' WHEN i.index_id IS NULL THEN 'NoCompletedIndex' WHEN i.build_id <> r.build_id THEN 'IndexBuildMismatch' ELSE 'Resolved' END"""
_JOINED = f"LEFT JOIN game_builds b ON b.build_id = r.build_id LEFT JOIN build_extractions x ON x.extraction_id = r.preferred LEFT JOIN {_BY_SOURCE} i ON i.source_identity = r.preferred AND i.n = 1"
_KNOWN = "game_builds code_runs " + _LOG


@query(f"""SELECT request_id, r.build_id, {_STATUS} AS status, CASE WHEN {_STATUS} = 'Resolved' THEN r.preferred END AS extraction_id, CASE WHEN {_STATUS} = 'Resolved' THEN i.index_id END AS index_id
 FROM (SELECT q.*, e.current AS preferred FROM (SELECT a.request_id, a.moment, coalesce(a.wanted, o.build_id) AS build_id, a.wanted IS NOT NULL AS explicit FROM (SELECT *, CASE WHEN trim(build_id) <> '' THEN build_id END AS wanted FROM authority_requests) a
  ASOF LEFT JOIN observations o ON a.moment >= o.moment) q ASOF LEFT JOIN (SELECT * FROM {_AUDIT} WHERE outcome IN ('Set', 'Cleared')) e ON q.build_id = e.build_id AND q.moment >= e.moment) r {_JOINED}""", "authority_requests observations " + _KNOWN)  # fmt: skip
def authority_at_time(g):
    found = authority.at_request(g.authority_requests, g.observations, g.game_builds, _audit(g), g.build_extractions, g.code_runs)
    return found.select("request_id", "build_id", "status", "extraction_id", "index_id")


_NOW = f"""(SELECT r.build_id, {_STATUS} AS status, CASE WHEN {_STATUS} = 'Resolved' THEN r.preferred END AS extraction_id, CASE WHEN {_STATUS} = 'Resolved' THEN i.index_id END AS index_id
 FROM (SELECT g.build_id, p.extraction_id AS preferred, true AS explicit FROM game_builds g LEFT JOIN {_CURRENT} p ON p.build_id = g.build_id) r {_JOINED})"""


def _now(g):
    return authority.now(g.game_builds, preference.current(_audit(g)), g.build_extractions, g.code_runs)


@query(f"SELECT build_id, status, index_id FROM {_NOW}", _KNOWN)
def authority_status(g):
    return _now(g).select("build_id", "status", "index_id")


_SCENE = "(SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY completed_at DESC, scene_snapshot_id DESC) AS place FROM scene_states WHERE status = 'Completed' AND published_at IS NOT NULL)"


@query(f"SELECT build_id, scene_snapshot_id, extraction_id FROM {_SCENE} WHERE place = 1", "scene_states")
def latest_scene_per_build(g):
    return authority.latest_scenes(g.scene_states).select("build_id", "scene_snapshot_id", "extraction_id")


@query(f"""SELECT a.build_id, s.scene_snapshot_id, CASE WHEN a.status <> 'Resolved' THEN a.status WHEN s.scene_snapshot_id IS NULL THEN 'NoPublishedScene' WHEN s.extraction_id = a.extraction_id AND s.code_index_id = a.index_id THEN 'Match' ELSE 'SceneAuthorityMismatch' END AS outcome
 FROM {_NOW} a LEFT JOIN {_SCENE} s ON s.build_id = a.build_id AND s.place = 1""", "scene_states " + _KNOWN)  # fmt: skip
def scene_authority(g):
    return authority.scene_authority(g.scene_states, _now(g))


@query(f"SELECT codebase, channel, index_id FROM {_RUNS.format('codebase, channel', 'true')} WHERE n = 1", "code_runs")
def latest_index_per_channel(g):
    return lineage.latest_completed(g.code_runs, ["codebase", "channel"]).select("codebase", "channel", "index_id")


@query("""SELECT build_id, index_id, completed_at FROM (SELECT e.build_id, r.index_id, r.completed_at, row_number() OVER (PARTITION BY e.build_id ORDER BY r.completed_at DESC, r.index_id DESC) AS n
 FROM code_runs r JOIN code_states c ON c.snapshot_id = r.snapshot_id JOIN environments e ON e.environment_id = c.environment_id WHERE r.status = 'Completed') WHERE n = 1""", "code_runs code_states environments")  # fmt: skip
def build_lineage(g):
    places = g.code_states.join(g.environments, "environment_id").select("snapshot_id", "build_id")
    runs = g.code_runs.drop("build_id").join(places, "snapshot_id")
    return lineage.latest_completed(runs, ["build_id"]).select("build_id", "index_id", "completed_at")


@query("SELECT build_id, next_build_id FROM (SELECT build_id, lead(build_id) OVER (ORDER BY first_seen, build_id) AS next_build_id FROM game_builds) WHERE next_build_id IS NOT NULL", "game_builds")
def adjacent_builds(g):
    return lineage.adjacent(g.game_builds)


@query("SELECT recipe_id, count(*) AS runs, count(DISTINCT manifest_digest) AS digests, CASE WHEN count(*) < 2 THEN 'NotTested' WHEN count(DISTINCT manifest_digest) = 1 THEN 'Reproducible' ELSE 'Divergent' END AS outcome FROM build_extractions GROUP BY recipe_id", "build_extractions")
def reproducibility(g):
    return checks.reproducibility(g.build_extractions)


@query(f"""SELECT b.build_id, b.first_seen, b.build_id = (SELECT build_id FROM observations ORDER BY moment DESC, fact_id DESC LIMIT 1) AS is_current, p.extraction_id IS NOT NULL AS has_preferred, a.status = 'Resolved' AS is_indexed
 FROM game_builds b LEFT JOIN {_CURRENT} p ON p.build_id = b.build_id LEFT JOIN {_NOW} a ON a.build_id = b.build_id ORDER BY b.first_seen DESC, b.build_id DESC""", "observations " + _KNOWN)  # fmt: skip
def build_list(g):
    preferred = preference.current(_audit(g))
    state = authority.now(g.game_builds, preferred, g.build_extractions, g.code_runs).select("build_id", (F.col("status") == "Resolved").alias("is_indexed"))
    last = g.observations.agg(F.max(F.struct("moment", "fact_id", "build_id")).alias("o")).select(F.col("o.build_id").alias("now"))  # one row
    rows = g.game_builds.join(state, "build_id").join(preferred.select("build_id", F.lit(True).alias("has_preferred")), "build_id", "left").crossJoin(F.broadcast(last))
    return rows.select("build_id", "first_seen", F.coalesce(F.col("build_id") == F.col("now"), F.lit(False)).alias("is_current"), F.coalesce("has_preferred", F.lit(False)).alias("has_preferred"), "is_indexed").orderBy(F.desc("first_seen"), F.desc("build_id"))


_SEEN = "(SELECT concat('e-', o_orderkey % 900) AS snapshot_id, concat('b-', o_custkey) AS build_id, o_orderdate AS seen FROM orders)"
_KEPT = f"(SELECT snapshot_id, build_id, seen FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY build_id, seen) AS n FROM {_SEEN} WHERE snapshot_id NOT IN (SELECT snapshot_id FROM new_environments)) WHERE n = 1)"


@query(f"SELECT * FROM {_KEPT}", "new_environments")
def new_snapshots(g):
    """What an insert that ignores known snapshots adds."""
    seen = g.base("orders").selectExpr("concat('e-', o_orderkey % 900) AS snapshot_id", "concat('b-', o_custkey) AS build_id", "o_orderdate AS seen")
    return lineage.append_new(g.new_environments, seen, ["snapshot_id"])


@query("""SELECT build_id, seen, n FROM (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY seen DESC, n DESC) AS place FROM (SELECT build_id, first_seen AS seen, CAST(-1 AS BIGINT) AS n FROM game_builds UNION ALL SELECT build_id, created_at, n FROM build_extractions)) WHERE place = 1""", "game_builds build_extractions")
def upserted_builds(g):
    """Builds as they are after each extraction has brought its own time."""
    known = g.game_builds.select("build_id", F.col("first_seen").alias("seen"), F.lit(-1).cast("long").alias("n"))
    return lineage.upsert(known, g.build_extractions.select("build_id", F.col("created_at").alias("seen"), "n"), ["build_id"], "seen")
