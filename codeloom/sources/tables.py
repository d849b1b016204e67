"""Sources: the driver's tables, and the graph model over them.

The model's tables are written once as SQL that Spark and other engines read alike ({sha} is the only difference), so
queries and their checks start from the same rows. Catalyst drops what a query does not use.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.cuts import shared_folder
from codeloom.sources.records import RECORDS

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

#: Table by table, each over the base tables and those before it.
MODEL = {
    "builds": """
        SELECT k, {sha}(concat('asm-', k, ':', 'meta-', k)) AS build_id, concat('2024-0', k + 1, '-01T00:00:00.0000000Z') AS first_seen
        FROM (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)""",
    "extractions": """
        SELECT k, build_id, {sha}(concat('ext-', k)) AS extraction_id, {sha}(concat('recipe-', k % 2)) AS recipe_id, {sha}(concat('manifest-', k % 2)) AS manifest_digest,
               k <> 2 AS verified, k < 3 AS preferred FROM builds""",
    "code_snapshots": """
        SELECT k, build_id, {sha}(concat('snap-', k)) AS snapshot_id, 'game' AS codebase, 'installed' AS channel, {sha}(concat('ext-', k)) AS source_identity FROM builds""",
    "index_runs": """
        SELECT {sha}(concat('idx-', k)) AS index_id, snapshot_id, CASE WHEN k < 3 THEN 'Completed' ELSE 'Running' END AS status,
               CASE WHEN k < 3 THEN concat('2024-0', k + 1, '-02T00:00:00.0000000Z') END AS completed_at FROM code_snapshots
        UNION ALL SELECT {sha}(concat('old-', k)), snapshot_id, CASE WHEN k = 1 THEN 'Failed' ELSE 'Completed' END, concat('2024-0', k + 1, '-01T12:00:00.0000000Z') FROM code_snapshots WHERE k < 2""",
    "type_names": """
        SELECT c_custkey AS type_key, 'C' AS source, replace(concat(r_name, '.', n_name, '.', c_name), ' ', '') AS qualified_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT p_partkey, 'P', concat('Catalog.', replace(p_brand, '#', ''), '.Part', p_partkey) FROM part""",
    "symbols": """
        SELECT {sha}(concat(snapshot_id, chr(10), codebase, ':', channel, ':', kind, ':', qualified_name)) AS symbol_id, snapshot_id, k,
               concat(codebase, ':', channel, ':', kind, ':', qualified_name) AS canonical_key, kind, qualified_name, qualified_name AS signature, body_recovery_status
        FROM (SELECT k AS build, 'Type' AS kind, qualified_name, CAST(NULL AS STRING) AS body_recovery_status FROM type_names CROSS JOIN builds WHERE k < 2
              UNION ALL
              SELECT k, CASE WHEN o_orderkey % 4 = 0 THEN 'Constructor' ELSE 'Method' END, concat(qualified_name, '::Order', o_orderkey),
                     CASE o_orderkey % 4 WHEN 0 THEN 'Recovered' WHEN 1 THEN 'StubOrUnavailable' WHEN 2 THEN 'Unknown' END
              FROM orders JOIN type_names ON o_custkey = type_key AND source = 'C' CROSS JOIN builds WHERE k < 2 AND o_orderkey % 10 <> k)
        JOIN code_snapshots ON build = k""",
    "method_of": """
        SELECT CAST(substring(qualified_name, strpos(qualified_name, '::Order') + 7) AS BIGINT) AS o_orderkey, symbol_id, k, snapshot_id, canonical_key FROM symbols WHERE kind IN ('Method', 'Constructor')""",
    "part_of": """
        SELECT p_partkey, symbol_id, k FROM part JOIN symbols ON qualified_name = concat('Catalog.', replace(p_brand, '#', ''), '.Part', p_partkey)""",
    "edge_facts": """
        SELECT DISTINCT m.k, m.snapshot_id, m.symbol_id AS source_symbol_id, m.canonical_key AS source_key, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE p.symbol_id END AS target_symbol_id,
               concat('Part', l_partkey) AS target_text, CASE l_returnflag WHEN 'N' THEN 'Calls' WHEN 'A' THEN 'Constructs' ELSE 'ReadsField' END AS relationship_kind
        FROM lineitem JOIN method_of m ON l_orderkey = m.o_orderkey JOIN part_of p ON l_partkey = p.p_partkey AND p.k = m.k
        WHERE NOT (m.k = 1 AND l_orderkey % 5 = 0 AND l_linenumber = 1)""",
    "relationships": """
        SELECT {sha}(concat(snapshot_id, chr(10), source_key, chr(10), relationship_kind, chr(10), target_text)) AS relationship_id, k, snapshot_id, source_symbol_id, target_symbol_id, target_text, relationship_kind FROM edge_facts""",
    "fingerprints": """
        SELECT symbol_id, k, 'declaration' AS fingerprint_kind, {sha}(concat(canonical_key, chr(10), 'declaration')) AS fingerprint FROM symbols
        UNION ALL SELECT m.symbol_id, m.k, 'method-body', {sha}(CAST(sum(CAST(l_quantity AS BIGINT) + CASE WHEN m.k = 1 AND l_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS STRING))
        FROM lineitem JOIN method_of m ON l_orderkey = m.o_orderkey GROUP BY m.symbol_id, m.k""",
    "artifacts": """
        SELECT k, concat('managed/', p_partkey, '.dll') AS relative_path, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS assembly_name,
               CAST(p_size AS BIGINT) * 100 + CASE WHEN k = 1 AND p_partkey % 2 = 0 THEN 900 ELSE 0 END AS size, {sha}(concat(p_name, k % 2)) AS sha256, CAST(p_size AS BIGINT) AS type_count,
               CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 3 END AS method_count
        FROM part CROSS JOIN builds WHERE k < 2 AND NOT (k = 1 AND p_partkey % 6 = 0)""",
    "attempts": """
        SELECT event_id AS attempt_id, user_id, CASE event_id % 9 WHEN 0 THEN 'Created' WHEN 1 THEN 'Preparing' WHEN 2 THEN 'Running' WHEN 3 THEN 'ProcessCompleted' WHEN 4 THEN 'Validating'
               WHEN 5 THEN 'Succeeded' WHEN 6 THEN 'Failed' WHEN 7 THEN 'Canceled' ELSE 'Abandoned' END AS status,
               ts AS changed_at, CASE WHEN event_id % 11 <> 0 THEN ts END AS completed_at, CASE WHEN event_id % 13 = 0 THEN concat('ext-', event_id) END AS result_id FROM events""",
    "scenes": """
        SELECT concat('region-', r_regionkey) AS scene_id, 'Scene' AS kind, r_name AS name FROM region
        UNION ALL SELECT concat('supplier-', s_suppkey), 'Prefab', s_name FROM supplier""",
    "game_objects": """
        SELECT concat('n', n_nationkey) AS game_object_id, CAST(NULL AS STRING) AS parent_id, concat('region-', n_regionkey) AS scene_id, 'c0' AS container_id, CAST(n_nationkey + 1 AS BIGINT) AS local_file_id, n_name AS name, 'FullyRecovered' AS recovery_status FROM nation
        UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), concat('region-', n_regionkey), 'c1', c_custkey, c_name, CASE WHEN c_custkey % 50 = 0 THEN 'PartiallyRecovered' ELSE 'FullyRecovered' END FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT concat('o', o_orderkey), concat('c', o_custkey), concat('region-', n_regionkey), 'c2', o_orderkey, concat('Order', o_orderkey), CASE WHEN o_orderkey % 97 = 0 THEN 'GraphOnly' ELSE 'FullyRecovered' END
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT concat('s', s_suppkey), CAST(NULL AS STRING), concat('supplier-', s_suppkey), 'c3', s_suppkey, s_name, 'StubOrUnavailable' FROM supplier""",
    "components": """
        SELECT DISTINCT concat('k', l_orderkey, '-', l_linenumber, '-', l_partkey) AS component_id, concat('o', l_orderkey) AS game_object_id, CASE WHEN l_returnflag = 'R' THEN 'MonoBehaviour' ELSE concat('UnityClass:', l_linenumber) END AS kind,
               CASE WHEN l_returnflag = 'R' THEN 'Catalog' END AS script_namespace, CASE WHEN l_returnflag = 'R' THEN concat('Part', l_partkey) END AS script_class FROM lineitem""",
    "serialized_refs": """
        SELECT concat('r', component_id) AS reference_id, component_id AS source_component_id, 'c2' AS source_container_id, CAST(NULL AS BIGINT) AS source_local_file_id, kind AS field_path,
               CASE WHEN length(component_id) % 3 = 0 THEN 'UnresolvedText' ELSE 'Resolved' END AS resolution_status FROM components
        UNION ALL SELECT concat('rc', c_custkey), NULL, 'c1', c_custkey, NULL, CASE WHEN c_custkey % 4 = 0 THEN 'UnresolvedText' ELSE 'Resolved' END FROM customer""",
    "channel_symbols": """
        SELECT symbol_id, 'installed' AS channel, canonical_key, kind, qualified_name, signature FROM symbols WHERE k = 0
        UNION ALL SELECT {sha}(concat('up-', symbol_id)), 'upstream', replace(canonical_key, ':installed:', ':upstream:'), kind, qualified_name, signature FROM symbols WHERE k = 1 AND kind = 'Type'
        UNION ALL SELECT {sha}(concat('night-', symbol_id)), 'nightly', replace(canonical_key, ':installed:', ':nightly:'), kind, qualified_name, signature FROM symbols WHERE k = 1 AND kind = 'Type'""",
    "channel_runs": """
        SELECT 'installed' AS channel, 'Completed' AS status UNION ALL SELECT 'upstream', 'Completed' UNION ALL SELECT 'nightly', 'Running'""",
    "declared_spans": """
        SELECT l_orderkey AS o_orderkey, CASE WHEN l_orderkey % 4 = 0 THEN 'Constructor' ELSE 'Method' END AS kind, concat(replace(concat(r_name, '.', n_name, '.', c_name), ' ', ''), '::Order', l_orderkey) AS qualified_name,
               concat('src/', o_custkey, '.txt') AS relative_path, CAST(l_partkey AS BIGINT) AS start_line, CAST(l_partkey AS BIGINT) + l_linenumber AS end_line
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "text_locations": """
        SELECT symbol_id, CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 1 END AS start_line, CASE WHEN p_partkey % 5 = 0 THEN 4 ELSE 1 END AS end_line
        FROM part JOIN symbols ON k = 0 AND qualified_name = concat('Catalog.', replace(p_brand, '#', ''), '.Part', p_partkey) WHERE p_partkey % 3 <> 0""",
    "transforms": """
        SELECT concat('tn', n_nationkey) AS transform_id, CAST(NULL AS STRING) AS parent_id, CAST(n_regionkey AS BIGINT) AS root_order, 22 AS file_version, '2022.3.62f1' AS unity_version, CAST(0 AS BIGINT) AS byte_offset, CAST(100 AS BIGINT) AS byte_count, CAST(1000 AS BIGINT) AS container_size FROM nation
        UNION ALL SELECT concat('tc', c_custkey), CASE WHEN c_custkey % 40 = 0 THEN 'missing' ELSE concat('tn', c_nationkey) END, 0, CASE WHEN c_custkey % 30 = 0 THEN 21 ELSE 22 END,
               CASE WHEN c_custkey % 70 = 0 THEN '2021.1' ELSE '2022.3.62f2' END, c_custkey, 100, CASE WHEN c_custkey % 50 = 0 THEN c_custkey + 99 ELSE c_custkey + 100 END FROM customer
        UNION ALL SELECT concat('to', o_orderkey), concat('tc', o_custkey), 0, 22, '2022.3.62f2', 0, 10, 10 FROM orders""",
    "child_lists": """
        SELECT concat('tc', o_custkey) AS parent_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS place, concat('to', o_orderkey) AS child_id FROM orders WHERE o_orderkey % 17 <> 0
        UNION ALL SELECT concat('tn', c_nationkey), CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT), CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE concat('tc', c_custkey) END FROM customer WHERE c_custkey % 23 <> 0
        UNION ALL SELECT concat('tn', o_orderkey % 25), 9999, concat('to', o_orderkey) FROM orders WHERE o_orderkey % 101 = 0""",
    "prefab_evidence": """
        SELECT concat('e', s_suppkey) AS evidence_id, CASE s_suppkey % 3 WHEN 0 THEN 1001 WHEN 1 THEN 1001480554 ELSE 114 END AS class_id, CASE WHEN s_suppkey % 5 = 0 THEN 'm_Other' ELSE 'm_rootGameObject' END AS field_path,
               'PPtr<GameObject>' AS declared_type, CASE WHEN s_suppkey % 6 = 1 THEN concat('n', s_suppkey % 25) ELSE concat('c', s_suppkey) END AS target_id FROM supplier
        UNION ALL SELECT concat('e', s_suppkey), 1001, 'm_RootGameObject', 'PPtr<GameObject>', concat('c', s_suppkey + 1) FROM supplier WHERE s_suppkey % 9 = 0""",
    "placed_objects": """
        SELECT game_object_id, parent_id, CASE WHEN container_id = 'c0' AND local_file_id % 2 = 0 THEN concat('level', local_file_id % 5) ELSE concat('assets/', container_id, '.assets') END AS container_path FROM game_objects""",
    "containers": """
        SELECT concat('level', r_regionkey) AS container_path FROM region UNION SELECT concat('dir', s_suppkey % 4, '/shared', s_suppkey % 9, '.assets') FROM supplier""",
    "container_objects": """
        SELECT container_path, CAST(r_regionkey + 1 AS BIGINT) AS local_file_id FROM containers CROSS JOIN region""",
    "externals": """
        SELECT concat('level', n_regionkey) AS source_path, CAST(n_nationkey + 1 AS BIGINT) AS file_id,
               CASE n_nationkey % 6 WHEN 0 THEN 'archive:/x/CAB/dir1/shared1.assets' WHEN 1 THEN ' ' WHEN 2 THEN concat('/dir2', chr(92), 'shared2.assets') WHEN 3 THEN concat('else/level', n_regionkey) WHEN 4 THEN 'none/gone.assets' ELSE 'else/shared1.assets' END AS path_name,
               CASE WHEN n_nationkey % 6 = 1 THEN concat('level', n_regionkey) END AS original_path_name FROM nation""",
    "pointers": """
        SELECT o_orderkey AS pointer_id, concat('level', o_orderkey % 5) AS source_path, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 26 END AS BIGINT) AS file_id, CAST(o_custkey % 8 - 1 AS BIGINT) AS local_file_id FROM orders""",
    "scripts": """
        SELECT p_partkey AS script_id, CASE WHEN p_partkey % 6 = 0 THEN 'Other' ELSE 'Game' END AS assembly_name, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE concat('Catalog.', replace(p_brand, '#', '')) END AS script_namespace,
               concat(CASE WHEN p_partkey % 8 = 0 THEN 'Gone' ELSE ' Part' END, p_partkey) AS script_class, {sha}(concat('idx-', p_partkey % 4)) AS index_id,
               {sha}(concat('ext-', CASE WHEN p_partkey % 10 = 0 THEN 9 ELSE p_partkey % 4 END)) AS extraction_id FROM part""",
    "issues": """
        SELECT user_id AS attempt_id, event_id, CASE WHEN event_id % 90 = 0 THEN 'Error' WHEN event_id % 20 = 0 THEN 'Warning' ELSE 'Info' END AS severity, event_id % 25 = 0 AS preference_blocking FROM events""",
    "validations": """
        SELECT user_id AS attempt_id, user_id % 7 <> 0 AS containment_passed, user_id % 5 <> 0 AS input_integrity_passed, user_id % 4 <> 0 AS process_integrity_passed, CASE WHEN user_id % 3 = 0 THEN 'Explicit' ELSE 'ManagedPinned' END AS trust,
               concat('tool', user_id % 2) AS tool_id, concat('x', user_id) AS candidate_id, CASE user_id % 8 WHEN 1 THEN concat('x', user_id) WHEN 2 THEN 'other' WHEN 3 THEN 'manual' WHEN 5 THEN 'other' END AS preferred_id,
               CASE WHEN user_id % 8 = 3 THEN 'ManualPromotion' ELSE 'ManagedAutomatic' END AS preferred_reason, 'tool1' AS preferred_tool_id
        FROM (SELECT DISTINCT user_id FROM events)""",
} | RECORDS


def with_clause(sha: str, names: list[str] | None = None, held: dict | None = None) -> str:
    """The model's tables as a WITH clause: of the named ones, and of what they use; ``held`` ones are there already."""
    wanted, todo = set(), list(names or MODEL)
    while todo:
        name = todo.pop()
        if name not in wanted and name not in (held or ()):
            wanted.add(name)
            todo += [m for m in MODEL if m != name and re.search(rf"\b(FROM|JOIN) {m}\b", MODEL[name])]
    return "WITH " + ", ".join(f"{n} AS ({MODEL[n].replace('{sha}', sha)})" for n in MODEL if n in wanted)


class Graph:
    """The model over a folder of tables; ``graph.symbols`` and so on are lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.held = spark, sf_dir, {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def hold(self, *names: str) -> None:
        """Write tables of the model to the shared folder; what is derived from now on reads them there. For tables that a query
        uses several times: each is derived once, and plans stay small."""
        for name in names:
            if name not in self.held:
                path = f"{shared_folder(self.spark)}/model-{uuid.uuid4().hex}/{name}"
                rows = getattr(self, name)
                rows.write.parquet(path)
                self.held[name] = self.spark.read.schema(rows.schema).parquet(path)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in MODEL:
            raise AttributeError(name)
        if name in self.held:
            return self.held[name]
        text = with_clause("sha2x", [name], self.held) + f" SELECT * FROM {name}"
        text = re.sub(r"sha2x\(", "model_sha(", text)
        self.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION model_sha(x STRING) RETURNS STRING RETURN sha2(x, 256)")
        used = {b: rows for b, rows in [*((b, None) for b in BASE), *self.held.items()] if re.search(rf"\b(FROM|JOIN) {b}\b", text)}
        for b in used:
            text = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}} AS {b}", text)
        used = {b: self.base(b) if rows is None else rows for b, rows in used.items()}
        return self.spark.sql(text.replace("strpos(qualified_name, '::Order')", "locate('::Order', qualified_name)"), **used)
