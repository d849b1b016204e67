"""Queries of guarded changes, checked write-sets, reconciling and integrity, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.operators import integrity, lineage, state, writeset
from codeloom.plans.registry import query
from codeloom.sources.cuts import shared_folder
from codeloom.sources.versions import VersionedLog

_FIRST = "SELECT * EXCLUDE (o, f), CASE WHEN o IN ({wins}) AND f <> request_id THEN 'Lost' ELSE o END AS outcome FROM (SELECT *, first(request_id) OVER (PARTITION BY {key}, o IN ({wins}) ORDER BY moment, request_id) AS f FROM ({rows}))"

_STARTS = _FIRST.format(key="index_id", wins="'Started', 'Restarted'", rows="""SELECT r.*, CASE WHEN s.status IS NULL THEN 'Started' WHEN s.status = 'Failed' OR (s.status = 'Running' AND s.started_at < r.moment - INTERVAL '60' MINUTE) THEN 'Restarted'
 WHEN s.status = 'Running' THEN 'Running' ELSE 'Completed' END AS o FROM start_requests r LEFT JOIN run_states s ON s.index_id = r.index_id""")  # fmt: skip


@query(f"SELECT request_id, index_id, outcome FROM ({_STARTS})", "run_states start_requests")
def run_starts(g):
    return state.start_runs(g.run_states, g.start_requests).select("request_id", "index_id", "outcome")


_ENDS = _FIRST.format(key="index_id", wins="'Completed', 'Failed'", rows="""SELECT r.*, CASE WHEN s.status IS NULL THEN 'Missing' WHEN s.status <> 'Running' THEN 'NotRunning' WHEN r.failure IS NULL THEN 'Completed' ELSE 'Failed' END AS o
 FROM end_requests r LEFT JOIN run_states s ON s.index_id = r.index_id""")  # fmt: skip


@query(f"SELECT request_id, index_id, outcome FROM ({_ENDS})", "run_states end_requests")
def run_ends(g):
    return state.end_runs(g.run_states, g.end_requests).select("request_id", "index_id", "outcome")


_LEGAL = ", ".join(f"('{a}', '{b}')" for a, b in lineage.LEGAL)
_MOVES = _FIRST.format(key="attempt_id", wins="'Moved'", rows=f"""SELECT r.*, CASE WHEN s.attempt_id IS NULL THEN 'Missing' WHEN (s.status, r.next_status) NOT IN ({_LEGAL}) THEN 'Illegal' WHEN s.status <> r.expected_status THEN 'StatusChanged'
 WHEN s.changed_at IS DISTINCT FROM r.expected_at THEN 'TimeChanged' ELSE 'Moved' END AS o FROM transition_requests r LEFT JOIN attempts s ON s.attempt_id = r.attempt_id""")  # fmt: skip


@query(f"SELECT request_id, attempt_id, outcome FROM ({_MOVES})", "attempts transition_requests")
def attempt_transitions(g):
    return state.transition(g.attempts, g.transition_requests).select("request_id", "attempt_id", "outcome")


_DELETES = _FIRST.format(key="attempt_id", wins="'Deleted'", rows="""SELECT r.*, CASE WHEN s.attempt_id IS NULL THEN 'Missing' WHEN s.status NOT IN ('Failed', 'Canceled', 'Abandoned') THEN 'NotTerminal' WHEN s.status <> r.expected_status THEN 'StatusChanged'
 WHEN s.completed_at IS DISTINCT FROM r.expected_at THEN 'TimeChanged' WHEN s.result_id IS NOT NULL THEN 'HasResult' WHEN s.attempt_id IN (SELECT attempt_id FROM attempt_sources) THEN 'IsSource' ELSE 'Deleted' END AS o
 FROM delete_requests r LEFT JOIN {} s ON s.attempt_id = r.attempt_id""")  # fmt: skip


@query(f"SELECT request_id, attempt_id, outcome FROM ({_DELETES.format('attempts')})", "attempts delete_requests attempt_sources")
def attempt_deletes(g):
    return state.delete(g.attempts, g.delete_requests, g.attempt_sources).select("request_id", "attempt_id", "outcome")


_MOVED = f"""(SELECT a.attempt_id, coalesce(m.next_status, a.status) AS status, coalesce(m.moment, a.changed_at) AS changed_at, CASE WHEN m.next_status IN ('Succeeded', 'Failed', 'Canceled', 'Abandoned') THEN m.moment ELSE a.completed_at END AS completed_at, result_id
 FROM attempts a LEFT JOIN (SELECT * FROM ({_MOVES}) WHERE outcome = 'Moved') m ON m.attempt_id = a.attempt_id)"""


@query(f"SELECT attempt_id, status, changed_at, completed_at FROM {_MOVED} WHERE attempt_id NOT IN (SELECT attempt_id FROM ({_DELETES.format(_MOVED)}) WHERE outcome = 'Deleted')", "attempts transition_requests delete_requests attempt_sources")
def attempt_state(g):
    """Three versions of a log: what was there, the transitions that hold, the deletions that hold after them."""
    log = VersionedLog(g.spark, f"{shared_folder(g.spark)}/attempts-{uuid.uuid4().hex}")
    log.commit(g.attempts.select("attempt_id", "status", "changed_at", "completed_at", "result_id", F.lit(False).alias("_deleted")), 1, whole=True)
    log.change(["attempt_id"], lambda now: state.transition(now, g.transition_requests), state.moved)
    log.change(["attempt_id"], lambda now: state.delete(now, g.delete_requests, g.attempt_sources), state.deleted)
    return log.state(["attempt_id"]).select("attempt_id", "status", "changed_at", "completed_at")


_SET = {name: f"set_{name}" for name in writeset.ROW_IDS}
_NO_OWNER = " UNION ALL ".join(
    f"SELECT 'NoOwner:{c}', '{t}', {writeset.ROW_IDS[t]} FROM set_{t} x WHERE {f'x.{c} IS NOT NULL AND ' if c in writeset.OPTIONAL else ''}NOT EXISTS (SELECT 1 FROM set_{o} o WHERE o.{writeset.ROW_IDS[o]} = x.{c})" for t, c, o in writeset.OWNERS
)
_OTHER = " UNION ALL ".join(f"SELECT 'OtherSnapshot' AS problem, '{t}' AS table_name, {writeset.ROW_IDS[t]} AS row_id FROM set_{t} WHERE scene_snapshot_id IS DISTINCT FROM 'snap'" for t in ("containers", "documents", "references"))
_TYPES = "(SELECT symbol_id FROM symbols WHERE k = 0 AND kind = 'Type' AND starts_with(canonical_key, 'game:installed:Type:'))"
_FOREIGN = f"""SELECT 'ForeignSymbol', 'components', component_id FROM set_components WHERE resolved_symbol_id IS NOT NULL AND resolved_symbol_id NOT IN {_TYPES}
 UNION ALL SELECT 'ForeignSymbol', 'references', reference_id FROM set_references WHERE target_symbol_id IS NOT NULL AND target_symbol_id NOT IN {_TYPES}"""


@query(f"SELECT DISTINCT * FROM ({_OTHER} UNION ALL {_NO_OWNER} UNION ALL {_FOREIGN})", " ".join(_SET.values()) + " symbols")
def writeset_problems(g):
    tables = {name: getattr(g, table) for name, table in _SET.items()}
    types = g.symbols.where("k = 0 AND kind = 'Type'").where(F.col("canonical_key").startswith("game:installed:Type:"))
    return writeset.problems(tables, "snap", types)


@query("""SELECT scene_snapshot_id, CASE WHEN x.build_id IS NULL OR a.input_id IS NULL OR i.build_id IS NULL OR c.codebase IS NULL OR e.build_id IS NULL OR r.status IS NULL THEN 'Missing' WHEN x.build_id <> s.build_id THEN 'ExtractionBuild'
 WHEN i.build_id <> s.build_id THEN 'InputBuild' WHEN e.build_id <> s.build_id THEN 'EnvironmentBuild' WHEN NOT replay_verified THEN 'NotReplayed' WHEN a.input_id <> s.input_id THEN 'OtherInput' WHEN c.codebase <> 'game' OR c.channel <> 'installed' THEN 'OtherCode'
 WHEN r.snapshot_id <> s.code_snapshot_id THEN 'OtherIndex' WHEN r.status <> 'Completed' THEN 'IndexNotCompleted' END AS problem FROM scene_states s LEFT JOIN build_extractions x ON x.extraction_id = s.extraction_id
 LEFT JOIN source_attempts a ON a.extraction_id = s.extraction_id LEFT JOIN scene_inputs i ON i.input_id = s.input_id LEFT JOIN code_states c ON c.snapshot_id = s.code_snapshot_id LEFT JOIN environments e ON e.environment_id = c.environment_id
 LEFT JOIN code_runs r ON r.index_id = s.code_index_id""", "scene_states build_extractions source_attempts scene_inputs code_states environments code_runs")  # fmt: skip
def scene_lineage(g):
    return writeset.same_build(g.scene_states, g.build_extractions, g.source_attempts, g.scene_inputs, g.code_states, g.environments, g.code_runs)


_WANTED = "(SELECT concat('sc-', o_orderkey) AS scene_snapshot_id FROM orders)"
_MADE = f"(SELECT w.scene_snapshot_id, CASE WHEN s.status IS NULL THEN 'Created' WHEN s.published_at IS NOT NULL THEN 'Published' WHEN s.status = 'Running' THEN 'Running' ELSE 'Recreated' END AS outcome FROM {_WANTED} w LEFT JOIN scene_states s ON s.scene_snapshot_id = w.scene_snapshot_id)"


def _snapshot_starts(g):
    return writeset.starts(g.scene_states, g.base("orders").selectExpr("concat('sc-', o_orderkey) AS scene_snapshot_id"))


@query(f"SELECT * FROM {_MADE}", "scene_states")
def scene_snapshot_starts(g):
    return _snapshot_starts(g)


_GONE = f"(SELECT scene_snapshot_id FROM {_MADE} WHERE outcome = 'Recreated')"


@query(f"""SELECT 'snapshots' AS table_name, scene_snapshot_id AS row_id FROM {_GONE} UNION ALL SELECT 'objects', object_id FROM snapshot_objects WHERE scene_snapshot_id IN {_GONE}
 UNION ALL SELECT 'parts', part_id FROM snapshot_parts WHERE object_id IN (SELECT object_id FROM snapshot_objects WHERE scene_snapshot_id IN {_GONE})""", "scene_states snapshot_objects snapshot_parts")  # fmt: skip
def reconcile_plan(g):
    return writeset.removed(_snapshot_starts(g), [("objects", g.snapshot_objects, "object_id", "scene_snapshot_id", None), ("parts", g.snapshot_parts, "part_id", "object_id", "objects")])


_LINE = "concat(path, chr(9), size, chr(9), sha256)"
_SUMS = f"""(SELECT extraction_id, CAST(sum(n) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, sha256(string_agg(hash, chr(10) ORDER BY part)) AS digest FROM (SELECT extraction_id, substr(sha256(path), 1, 3) AS part, count(*) AS n, sum(size) AS bytes,
 sha256(string_agg({_LINE}, chr(10) ORDER BY path)) AS hash FROM file_manifest GROUP BY 1, 2) GROUP BY 1)"""
_UNSAFE = "len([x for x in string_split(path, '/') if x IN ('', '.', '..')]) > 0"


@query(f"""SELECT r.extraction_id, files, bytes, digest, CASE WHEN EXISTS (SELECT 1 FROM file_manifest m WHERE m.extraction_id = r.extraction_id AND {_UNSAFE}) THEN 'UnsafePath' WHEN e % 11 = 7 THEN 'DigestDiffers'
 WHEN EXISTS (SELECT extraction_id, path, size, sha256 FROM file_manifest m WHERE m.extraction_id = r.extraction_id EXCEPT SELECT extraction_id, path, size, sha256 FROM file_rows) THEN 'ManifestRowsDiffer'
 WHEN EXISTS (SELECT 1 FROM file_manifest m WHERE m.extraction_id = r.extraction_id AND path NOT IN (SELECT path FROM doc_files)) THEN 'MissingFile'
 WHEN EXISTS (SELECT 1 FROM doc_files m WHERE m.extraction_id = r.extraction_id AND path NOT IN (SELECT path FROM file_manifest)) THEN 'ExtraFile'
 WHEN EXISTS (SELECT 1 FROM file_manifest m JOIN doc_files f USING (extraction_id, path) WHERE m.extraction_id = r.extraction_id AND m.size <> f.size) THEN 'SizeDiffers'
 WHEN EXISTS (SELECT 1 FROM file_manifest m JOIN doc_files f USING (extraction_id, path) WHERE m.extraction_id = r.extraction_id AND m.sha256 <> f.sha256) THEN 'HashDiffers' WHEN e % 11 = 8 THEN 'StatisticsDiffer' ELSE 'Verified' END AS reason
 FROM (SELECT DISTINCT e, extraction_id FROM doc_files) r LEFT JOIN {_SUMS} s ON s.extraction_id = r.extraction_id""", "doc_files file_manifest file_rows")  # fmt: skip
def extraction_integrity(g):
    files = g.base("documents").where("doc_id IS NOT NULL").selectExpr("concat('e', CAST(floor(doc_id / 20) AS BIGINT)) AS extraction_id", "concat('files/', doc_id, '.txt') AS path", "CAST(coalesce(text, '') AS BINARY) AS content")
    number = F.substring("extraction_id", 2, 20).cast("long") % 11
    records = integrity.summed(g.file_manifest)
    records = records.select("extraction_id", F.when(number == 7, "altered").otherwise(F.col("digest")).alias("digest"), "files", (F.col("bytes") + (number == 8).cast("long")).alias("bytes"))
    return integrity.verify(records, g.file_manifest, g.file_rows, integrity.inventory(files))
