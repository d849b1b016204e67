"""Records of runs, attempts, builds, extractions, scenes and files over the driver's tables: many builds and histories with
failures, ties and faults of each kind. Part of the model of ``tables``."""

from __future__ import annotations

RECORDS = {
    # states and requests that would change them
    "run_states": """
        SELECT concat('run-', o_orderkey) AS index_id, concat('snap-', o_orderkey) AS snapshot_id, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Failed' ELSE 'Running' END AS status, o_orderdate AS started_at,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS completed_at, CASE WHEN o_orderstatus = 'O' THEN 'lost' END AS failure FROM orders""",
    "start_requests": """
        SELECT DISTINCT concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS request_id, concat(CASE WHEN l_partkey % 10 = 0 THEN 'new-' ELSE 'run-' END, l_orderkey) AS index_id, concat('snap-', l_partkey) AS snapshot_id,
               o_orderdate + CASE l_linenumber WHEN 1 THEN INTERVAL '30' MINUTE WHEN 2 THEN INTERVAL '60' MINUTE WHEN 3 THEN INTERVAL '61' MINUTE ELSE INTERVAL '90' MINUTE END AS moment FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "end_requests": """
        SELECT concat('end-', o_orderkey) AS request_id, concat('run-', CASE WHEN o_orderkey % 12 = 0 THEN -1 - o_orderkey ELSE o_orderkey END) AS index_id, CASE WHEN o_orderkey % 3 = 0 THEN 'stopped' END AS failure, o_orderdate + INTERVAL '2' DAY AS moment FROM orders
        UNION ALL SELECT concat('late-', o_orderkey), concat('run-', o_orderkey), NULL, o_orderdate + INTERVAL '3' DAY FROM orders WHERE o_orderkey % 4 = 0""",
    "transition_requests": """
        SELECT attempt_id * 2 AS request_id, CASE WHEN attempt_id % 50 = 0 THEN -1 - attempt_id ELSE attempt_id END AS attempt_id, CASE WHEN attempt_id % 10 = 0 THEN 'Created' ELSE status END AS expected_status,
               CASE WHEN attempt_id % 15 = 0 THEN changed_at - INTERVAL '1' SECOND ELSE changed_at END AS expected_at, CASE WHEN attempt_id % 7 = 0 THEN 'Failed' WHEN status = 'Created' THEN 'Preparing' WHEN status = 'Preparing' THEN 'Running'
               WHEN status = 'Running' THEN 'ProcessCompleted' WHEN status = 'ProcessCompleted' THEN 'Validating' WHEN status = 'Validating' THEN 'Succeeded' ELSE 'Running' END AS next_status, changed_at + INTERVAL '5' MINUTE AS moment FROM attempts
        UNION ALL SELECT attempt_id * 2 + 1, attempt_id, status, changed_at, 'Abandoned', changed_at + INTERVAL '4' MINUTE FROM attempts WHERE attempt_id % 3 = 0""",
    "delete_requests": """
        SELECT attempt_id AS request_id, CASE WHEN attempt_id % 40 = 0 THEN -1 - attempt_id ELSE attempt_id END AS attempt_id, CASE WHEN attempt_id % 8 = 0 THEN 'Failed' ELSE status END AS expected_status,
               CASE WHEN attempt_id % 12 = 0 THEN changed_at - INTERVAL '1' SECOND ELSE completed_at END AS expected_at, changed_at + INTERVAL '1' DAY AS moment FROM attempts""",
    "attempt_sources": """
        SELECT attempt_id FROM attempts WHERE attempt_id % 23 = 0""",
    # builds, their extractions, runs and preferences
    "game_builds": """
        SELECT o_custkey AS custkey, concat('b-', o_custkey) AS build_id, min(o_orderdate) AS first_seen FROM orders GROUP BY o_custkey""",
    "build_extractions": """
        SELECT o_orderkey AS n, concat('x-', o_orderkey) AS extraction_id, concat('b-', CASE WHEN o_orderkey % 41 = 0 THEN o_custkey + 1 ELSE o_custkey END) AS build_id, concat('recipe-', o_custkey, '-', o_orderpriority) AS recipe_id,
               concat('d-', CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey ELSE 0 END) AS manifest_digest, o_orderkey % 7 <> 0 AS verified, o_orderdate AS created_at FROM orders WHERE o_orderkey % 6 <> 5""",
    "code_runs": """
        SELECT concat('i-', n) AS index_id, concat('s-', n) AS snapshot_id, 'game' AS codebase, CASE WHEN n % 29 = 0 THEN 'upstream' ELSE 'installed' END AS channel, extraction_id AS source_identity,
               CASE WHEN n % 17 = 0 THEN 'b-x' WHEN n % 19 <> 0 THEN build_id END AS build_id, CASE WHEN n % 13 = 0 THEN 'Failed' WHEN n % 11 = 0 THEN 'Running' ELSE 'Completed' END AS status, created_at + INTERVAL '1' DAY AS completed_at FROM build_extractions
        UNION ALL SELECT concat('j-', n), concat('s-', n), 'game', 'installed', extraction_id, build_id, 'Completed', created_at + CASE WHEN n % 8 = 0 THEN INTERVAL '1' DAY ELSE INTERVAL '2' DAY END FROM build_extractions WHERE n % 4 = 0""",
    "preference_log": """
        SELECT event_id, concat('b-', o_custkey) AS build_id, CASE WHEN event_type IN ('error', 'click') THEN 'Clear' ELSE 'Set' END AS action,
               CASE WHEN event_type NOT IN ('error', 'click') OR event_id % 3 = 0 THEN concat('x-', o_orderkey) ELSE coalesce(lag(concat('x-', o_orderkey)) OVER (PARTITION BY o_custkey ORDER BY ts, event_id), 'x-none') END AS extraction_id,
               CASE WHEN event_id % 2 = 0 THEN 'ManualPromotion' ELSE 'ManagedAutomatic' END AS reason, ts AS moment FROM events JOIN orders ON o_orderkey = event_id""",
    "observations": """
        SELECT event_id AS fact_id, ts AS moment, concat('b-', o_custkey) AS build_id FROM events JOIN orders ON o_orderkey = event_id WHERE event_type = 'signup' AND event_id >= 50""",
    "authority_requests": """
        SELECT event_id AS request_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN concat('b-none-', event_id) ELSE concat('b-', o_custkey) END AS build_id, ts AS moment FROM events JOIN orders ON o_orderkey = event_id + 1""",
    # scenes and what they rest on
    "scene_states": """
        SELECT n, concat('sc-', n) AS scene_snapshot_id, CASE WHEN n % 47 = 0 THEN 'b-z' ELSE build_id END AS build_id, extraction_id, concat('in-', CASE WHEN n % 37 = 0 THEN n + 1 ELSE n END) AS input_id, concat('s-', CASE WHEN n % 21 = 0 THEN n + 1 ELSE n END) AS code_snapshot_id,
               concat(CASE WHEN n % 9 = 0 THEN 'j-' ELSE 'i-' END, CASE WHEN n % 25 = 1 THEN n + 1 ELSE n END) AS code_index_id, CASE n % 10 WHEN 0 THEN 'Running' WHEN 1 THEN 'Failed' ELSE 'Completed' END AS status, CASE WHEN n % 10 > 3 THEN created_at + INTERVAL '3' DAY END AS published_at,
               created_at + INTERVAL '3' DAY AS completed_at FROM build_extractions""",
    "scene_inputs": """
        SELECT concat('in-', n) AS input_id, CASE WHEN n % 23 = 0 THEN 'b-x' ELSE build_id END AS build_id, n % 8 <> 0 AS replay_verified FROM build_extractions""",
    "source_attempts": """
        SELECT extraction_id, concat('in-', CASE WHEN n % 31 = 0 THEN n + 6 ELSE n END) AS input_id FROM build_extractions""",
    "code_states": """
        SELECT concat('s-', n) AS snapshot_id, 'game' AS codebase, CASE WHEN n % 29 = 0 THEN 'upstream' ELSE 'installed' END AS channel, concat('env-', n) AS environment_id FROM build_extractions""",
    "environments": """
        SELECT concat('env-', n) AS environment_id, CASE WHEN n % 43 = 0 THEN 'b-y' ELSE build_id END AS build_id FROM build_extractions""",
    "snapshot_objects": """
        SELECT DISTINCT concat('so-', l_orderkey, '-', l_linenumber, '-', l_partkey) AS object_id, concat('sc-', l_orderkey) AS scene_snapshot_id FROM lineitem""",
    "snapshot_parts": """
        SELECT concat(object_id, '-t') AS part_id, object_id FROM snapshot_objects UNION ALL SELECT concat(object_id, '-k'), object_id FROM snapshot_objects WHERE length(object_id) % 2 = 0""",
    # one set of tables to be published, with faults
    "set_containers": """
        SELECT concat('c', r_regionkey) AS container_id, CASE WHEN r_regionkey = 4 THEN 'other' ELSE 'snap' END AS scene_snapshot_id FROM region""",
    "set_documents": """
        SELECT concat('d', n_nationkey) AS scene_id, concat('c', n_regionkey) AS container_id, CASE WHEN n_nationkey <> 7 THEN 'snap' END AS scene_snapshot_id FROM nation""",
    "set_objects": """
        SELECT concat('g', c_custkey) AS game_object_id, CASE WHEN c_custkey % 71 = 0 THEN 'd-none' ELSE concat('d', c_nationkey) END AS scene_id, CASE WHEN c_custkey % 73 <> 0 THEN concat('c', c_custkey % 5) END AS container_id FROM customer""",
    "set_transforms": """
        SELECT concat('g', CASE WHEN c_custkey % 83 = 0 THEN -1 - c_custkey ELSE c_custkey END) AS game_object_id, CASE WHEN c_custkey % 53 = 0 THEN 'g-none' WHEN c_custkey % 2 = 1 THEN concat('g', c_custkey - 1) END AS parent_id FROM customer""",
    "set_components": """
        SELECT concat('k', o_orderkey) AS component_id, CASE WHEN o_orderkey % 67 = 0 THEN 'g-none' ELSE concat('g', o_custkey) END AS game_object_id, concat('c', CASE WHEN o_orderkey % 61 = 0 THEN 9 ELSE o_orderkey % 5 END) AS container_id, symbol_id AS resolved_symbol_id
        FROM orders LEFT JOIN part_of ON p_partkey = o_orderkey AND k = CASE WHEN o_orderkey % 59 = 0 THEN 1 ELSE 0 END""",
    "set_references": """
        SELECT DISTINCT concat('r', l_orderkey, '-', l_linenumber, '-', l_partkey) AS reference_id, 'snap' AS scene_snapshot_id, concat('c', l_linenumber % 5) AS source_container_id, CASE WHEN l_linenumber > 1 THEN concat('k', l_orderkey) END AS source_component_id,
               CASE WHEN l_linenumber = 2 THEN concat('c', l_partkey % 6) END AS target_container_id, CASE WHEN l_linenumber = 3 THEN concat('g', l_partkey % 2000) END AS target_object_id, CASE WHEN l_linenumber = 4 THEN concat('k', l_orderkey + l_partkey) END AS target_component_id,
               CASE WHEN l_linenumber = 5 THEN symbol_id END AS target_symbol_id FROM lineitem LEFT JOIN part_of ON p_partkey = l_partkey AND k = CASE WHEN l_partkey % 47 = 0 THEN 1 ELSE 0 END""",
    # artifacts of many candidates, each with a baseline (side 0)
    "candidates": """
        SELECT DISTINCT p_partkey % 45 AS candidate_id FROM part""",
    "candidate_artifacts": """
        SELECT p_partkey % 40 AS candidate_id, side, concat('managed/', p_partkey, '.dll') AS relative_path, CASE WHEN p_partkey % 40 = 3 OR p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'assembly-csharp' WHEN p_partkey % 3 = 1 THEN 'Assembly-CSharp' ELSE concat('Lib', p_size % 9) END AS assembly_name,
               p_partkey % 31 = 0 AS invalid, CASE WHEN p_partkey % 33 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) * 10000 * (1 + side * (p_partkey % 2)) END AS size, {sha}(concat('c', CASE WHEN p_partkey % 40 < 20 THEN 0 ELSE p_partkey END)) AS sha256,
               CASE WHEN p_partkey % 40 = 9 THEN 0 ELSE CAST(p_size AS BIGINT) END * (1 + side * (p_partkey % 3)) AS type_count, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 3 END AS method_count
        FROM part CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1) WHERE NOT (side = 1 AND (p_partkey % 13 = 0 OR p_partkey % 40 = 11 AND p_partkey > 60))""",
    "cleanup_attempts": """
        SELECT attempt_id AS n, CASE WHEN attempt_id % 19 = 0 THEN concat('At', attempt_id) ELSE substring({sha}(concat('at-', attempt_id)), 1, 32) END AS attempt_id, CASE WHEN attempt_id % 17 = 0 THEN 'b:1' ELSE concat('b', user_id) END AS build_id, status, completed_at, result_id,
               CASE WHEN attempt_id % 14 = 0 THEN 'out' END AS candidate_output, attempt_id % 16 = 0 AS journal, attempt_id % 21 = 0 AS blocked, attempt_id % 22 = 1 AS evidence FROM attempts""",
    "staging_entries": """
        SELECT attempt_id AS name, n % 10 <> 3 AS is_folder FROM cleanup_attempts WHERE n % 2 = 0 UNION ALL SELECT concat(attempt_id, '.promotion.json'), false FROM cleanup_attempts WHERE n % 8 = 0
        UNION ALL SELECT substring({sha}(concat('orphan-', n)), 1, 32), true FROM cleanup_attempts WHERE n % 30 = 0""",
    # source files of an index, and where its symbols stand in them
    "source_records": """
        SELECT concat('f-', doc_id) AS source_file_id, concat(CASE WHEN doc_id % 19 = 0 THEN '../' ELSE 'src/' END, doc_id, '.txt') AS relative_path, CASE WHEN doc_id % 13 = 0 THEN {sha}(concat('x', text)) ELSE {sha}(text) END AS sha256, CAST(bit_length(text) / 8 AS BIGINT) AS byte_count
        FROM documents WHERE text IS NOT NULL AND doc_id % 17 <> 0""",
    "source_places": """
        SELECT symbol_id, concat('f-', doc_id) AS source_file_id, CAST(1 + p_partkey % n AS INT) AS start_line, CAST(CASE WHEN p_partkey % 11 = 0 THEN n + 1 WHEN 3 + p_partkey % n < n THEN 3 + p_partkey % n ELSE n END AS INT) AS end_line
        FROM part_of JOIN (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents WHERE text IS NOT NULL) d ON doc_id = p_partkey WHERE k = 0 AND p_partkey % 5 <> 0
        UNION ALL SELECT symbol_id, concat('f-', p_partkey), 1, 1 FROM part_of WHERE k = 0 AND p_partkey % 23 = 0""",
    # symbols with fields, whose pages are their types'
    "portal_symbols": """
        SELECT symbol_id, canonical_key, kind, qualified_name, signature, body_recovery_status FROM symbols WHERE k = 0
        UNION ALL SELECT {sha}(concat('field-', o_orderkey)), concat('game:installed:Field:', CASE WHEN o_orderkey % 7 = 0 THEN 'Gone' ELSE qualified_name END, '::System.Int32 f', o_orderkey), 'Field', concat(qualified_name, '::System.Int32 f', o_orderkey), concat('System.Int32 f', o_orderkey), CAST(NULL AS STRING)
        FROM orders JOIN type_names ON o_custkey = type_key AND source = 'C' WHERE o_orderkey % 5 = 0""",
    # inputs that an extraction may be made from
    "input_candidates": """
        SELECT concat('in-', o_orderkey) AS candidate_id, concat('b-', o_custkey) AS build_id, CASE o_orderkey % 3 WHEN 0 THEN 'observation' WHEN 1 THEN 'default' ELSE 'archive' END AS kind,
               concat(CASE WHEN o_orderkey % 2 = 0 THEN 'C:/Games/' ELSE 'c:/GAMES/' END, o_orderkey % 5, CASE WHEN o_orderkey % 4 = 0 THEN '/' ELSE '' END) AS root, CASE WHEN o_orderkey % 3 = 1 THEN -o_orderkey ELSE CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) END AS newness,
               o_orderkey % 4 = 1 OR o_orderkey % 11 = 0 AS valid, o_orderkey % 9 <> 2 AS replay_verified FROM orders""",
    "input_requests": """
        SELECT c_custkey AS request_id, concat('b-', c_custkey) AS build_id, CASE WHEN c_custkey % 6 = 0 THEN concat('in-', c_custkey) WHEN c_custkey % 6 = 1 THEN ' ' END AS snapshot, CASE WHEN c_custkey % 10 = 0 THEN 'D:/x' END AS path FROM customer
        UNION ALL SELECT -1 - o_orderkey, concat('b-', o_custkey), concat('in-', o_orderkey), NULL FROM orders WHERE o_orderkey % 4 = 1""",
    # environments of two schema versions
    "old_builds": """
        SELECT concat('b-', o_custkey) AS build_id, min(o_orderdate) AS scanned_at, concat('v', max(o_orderkey)) AS game_version, concat('s', min(o_orderkey)) AS steam_build_id FROM orders WHERE o_custkey % 4 <> 3 GROUP BY o_custkey""",
    "old_environments": """
        SELECT concat('e-', o_orderkey) AS snapshot_id, concat('b-', o_custkey) AS build_id, o_orderdate AS captured_at FROM orders WHERE o_orderkey % 3 <> 0""",
    "new_environments": """
        SELECT concat('e-', o_orderkey) AS snapshot_id, concat('b-', o_custkey) AS build_id, o_orderdate AS captured_at, 2 AS identity_version, concat('x', o_orderkey) AS executable_version, 'app' AS steam_app_id, CAST(NULL AS STRING) AS steam_build_id, 'C:/x' AS installation_root FROM orders WHERE o_orderkey % 2 = 0""",
    # files of extractions, of twenty documents each
    "doc_files": """
        SELECT CAST(floor(doc_id / 20) AS BIGINT) AS e, concat('e', CAST(floor(doc_id / 20) AS BIGINT)) AS extraction_id, doc_id % 20 AS place, concat('files/', doc_id, '.txt') AS path, CAST(bit_length(coalesce(text, '')) / 8 AS BIGINT) AS size, {sha}(coalesce(text, '')) AS sha256
        FROM documents WHERE doc_id IS NOT NULL""",
    "file_manifest": """
        SELECT e, extraction_id, place, CASE WHEN e % 11 = 6 AND place = 5 THEN concat('../', path) WHEN e % 11 = 3 AND place = 4 THEN concat(path, '.gone') ELSE path END AS path, CASE WHEN e % 11 = 2 AND place = 2 THEN size + 1 ELSE size END AS size,
               CASE WHEN e % 11 = 1 AND place = 3 THEN {sha}(sha256) ELSE sha256 END AS sha256 FROM doc_files WHERE NOT (e % 11 = 4 AND place = 7)""",
    "file_rows": """
        SELECT extraction_id, path, CASE WHEN e % 11 = 5 AND place = 1 THEN size + 2 ELSE size END AS size, sha256 FROM file_manifest""",
}
