"""Queries of scene normalisation, scene pages and selectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import graph, lookup, normalise, scene
from codeloom.plans.registry import query
from codeloom.sources.cuts import cut

_VALID = "(file_version = 22 AND starts_with(unity_version, '2022.3.62') AND byte_offset >= 0 AND byte_count > 0 AND byte_offset + byte_count <= container_size)"


@query(f"SELECT transform_id, {_VALID} AS schema_valid FROM transforms", "transforms")
def schema_bounds_gate(g):
    columns = ("file_version", "unity_version", "byte_offset", "byte_count", "container_size")
    return g.transforms.select("transform_id", normalise.schema_and_bounds(*(F.col(c) for c in columns)).alias("schema_valid"))


_T = f"(SELECT *, {_VALID} AS ok FROM transforms)"
_ENTRY = f"(SELECT * FROM child_lists WHERE parent_id IN (SELECT transform_id FROM {_T} WHERE ok))"
_HIER = f"""(SELECT t.*, p.transform_id IS NOT NULL AS parent_there, coalesce(p.ok, false) AS parent_ok, (SELECT max(place) FROM {_ENTRY} e WHERE e.parent_id = t.parent_id AND e.child_id = t.transform_id) AS place
 FROM {_T} t LEFT JOIN {_T} p ON p.transform_id = t.parent_id)"""
_FORGOT = "(ok AND parent_ok AND place IS NULL)"


@query(f"""SELECT transform_id, CASE WHEN ok AND parent_there THEN parent_id END AS parent_id, CASE WHEN ok THEN CASE WHEN parent_id IS NULL THEN root_order ELSE place END END AS sibling_index, ok AS schema_valid,
 ok AND (parent_id IS NULL OR parent_there) AND NOT {_FORGOT} AND transform_id NOT IN (SELECT parent_id FROM {_ENTRY} WHERE child_id IS NULL)
 AND transform_id NOT IN (SELECT parent_id FROM {_HIER} WHERE {_FORGOT}) AS hierarchy_complete FROM {_HIER}""", "transforms child_lists")  # fmt: skip
def sibling_index(g):
    return normalise.reconcile(g.transforms, g.child_lists)


@query(f"SELECT e.parent_id, e.child_id, t.parent_id AS named_parent FROM {_ENTRY} e LEFT JOIN {_T} t ON t.transform_id = e.child_id AND t.ok WHERE e.child_id IS NOT NULL AND t.parent_id IS DISTINCT FROM e.parent_id", "transforms child_lists")
def hierarchy_violations(g):
    return normalise.list_violations(g.transforms, g.child_lists)


_PATH = "ltrim(regexp_replace(regexp_replace(replace({0}, chr(92), '/'), '^.*archive:/', '', 'i'), '^.*/CAB/', '', 'i'), '/')"
_ASK = f"(SELECT source_path, file_id, {_PATH.format('path_name')} AS path FROM externals WHERE trim(path_name) <> '' UNION SELECT source_path, file_id, {_PATH.format('original_path_name')} FROM externals WHERE trim(original_path_name) <> '')"
_EXT = f"""(SELECT x.source_path, x.file_id, (SELECT list(DISTINCT container_path) FROM containers c JOIN {_ASK} a ON a.path = c.container_path WHERE a.source_path = x.source_path AND a.file_id = x.file_id) AS exact,
 (SELECT list(DISTINCT container_path) FROM containers c JOIN {_ASK} a ON split_part(a.path, '/', -1) = split_part(c.container_path, '/', -1) WHERE a.source_path = x.source_path AND a.file_id = x.file_id) AS near FROM externals x)"""
_PTR = f"""(SELECT p.*, CASE WHEN p.local_file_id > 0 THEN CASE WHEN p.file_id = 0 THEN p.source_path WHEN len(e.exact) = 1 THEN e.exact[1] WHEN coalesce(len(e.exact), 0) = 0 AND len(e.near) = 1 THEN e.near[1] END END AS path
 FROM pointers p LEFT JOIN {_EXT} e ON e.source_path = p.source_path AND e.file_id = p.file_id)"""


@query(f"""SELECT pointer_id, CASE WHEN p.local_file_id = 0 THEN 'Unavailable' WHEN p.local_file_id > 0 AND path IS NULL THEN 'UnresolvedText' WHEN o.container_path IS NOT NULL THEN 'Resolved' END AS status, o.container_path AS target_path, o.local_file_id AS target_local_id,
 CASE WHEN p.local_file_id < 0 THEN 'NegativeLocalId' WHEN path IS NOT NULL AND o.container_path IS NULL THEN 'MissingTarget' END AS violation FROM {_PTR} p LEFT JOIN container_objects o ON o.container_path = path AND o.local_file_id = p.local_file_id""", "pointers externals containers container_objects")  # fmt: skip
def pointer_resolution(g):
    return normalise.resolve_pointers(g.pointers, g.externals, g.containers, g.container_objects)


_ROOTS = """(SELECT evidence_id, CASE WHEN n = 1 THEN root END AS root_id, n AS roots FROM (SELECT evidence_id, count(DISTINCT game_object_id) AS n, min(game_object_id) AS root FROM prefab_evidence
 LEFT JOIN game_objects ON game_object_id = target_id AND contains(declared_type, 'GameObject') AND contains(lower(field_path), 'root') WHERE class_id IN (1001, 1001480554) GROUP BY evidence_id))"""
_PREFAB = "prefab_evidence game_objects"


@query(f"SELECT * FROM {_ROOTS}", _PREFAB)
def prefab_roots(g):
    return normalise.prefab_roots(g.prefab_evidence, g.game_objects)


_DOWN = f"""(WITH RECURSIVE d AS (SELECT evidence_id, root_id AS game_object_id, 0 AS depth FROM {_ROOTS} WHERE root_id IS NOT NULL
 UNION SELECT d.evidence_id, o.game_object_id, d.depth + 1 FROM d JOIN game_objects o ON o.parent_id = d.game_object_id) SELECT * FROM d)"""


@query(f"SELECT evidence_id, game_object_id, depth FROM {_DOWN}", _PREFAB)
def prefab_descendants(g):
    roots = cut(normalise.prefab_roots(g.prefab_evidence, g.game_objects))
    return normalise.descendants(g.game_objects, roots, cut)


_PLACED = "(SELECT *, CASE WHEN regexp_matches(split_part(container_path, '/', -1), '^level[0-9]+$') THEN container_path END AS level FROM placed_objects)"


@query(f"""SELECT o.game_object_id, CASE WHEN level IS NOT NULL THEN 'Scene' WHEN prefab IS NOT NULL THEN 'Prefab' ELSE 'AssetGraph' END AS kind, coalesce(level, prefab, container_path) AS document, coalesce(n, 0) + CASE WHEN level IS NULL THEN 0 ELSE 1 END AS claims
 FROM {_PLACED} o LEFT JOIN (SELECT game_object_id, min(evidence_id) AS prefab, count(*) AS n FROM {_DOWN} WHERE evidence_id IN (SELECT r.evidence_id FROM {_ROOTS} r JOIN {_PLACED} l ON l.game_object_id = r.root_id AND l.level IS NULL) GROUP BY 1) c
 ON c.game_object_id = o.game_object_id""", _PREFAB + " placed_objects")  # fmt: skip
def document_assignment(g):
    roots = cut(normalise.prefab_roots(g.prefab_evidence, g.game_objects))
    return normalise.assign_documents(g.placed_objects, roots, normalise.reached(g.game_objects, roots, cut))


@query("""SELECT script_id, status, CASE WHEN status = 'Resolved' THEN symbol_id END AS symbol_id FROM (SELECT script_id, s.symbol_id, CASE WHEN assembly_name <> 'Game' OR trim(script_namespace) = '' THEN 'UnresolvedText' WHEN i.index_id IS NULL THEN 'NotIndexed'
 WHEN i.source_identity <> c.extraction_id THEN 'Unavailable' WHEN s.symbol_id IS NULL THEN 'NotIndexed' ELSE 'Resolved' END AS status
 FROM scripts c LEFT JOIN (SELECT index_id, snapshot_id, source_identity FROM index_runs JOIN code_snapshots USING (snapshot_id) WHERE status = 'Completed') i ON i.index_id = c.index_id
 LEFT JOIN symbols s ON s.snapshot_id = i.snapshot_id AND s.kind = 'Type' AND s.qualified_name = concat(script_namespace, '.', trim(script_class)))""", "scripts index_runs code_snapshots symbols")  # fmt: skip
def component_code_symbol(g):
    indexes = g.index_runs.where("status = 'Completed'").join(g.code_snapshots.drop("build_id", "k"), "snapshot_id").select("index_id", "snapshot_id", "source_identity", F.lit(True).alias("build_ok"))
    return normalise.code_symbols(g.scripts, indexes, g.symbols, ["Game"], "game:installed:Type:")


@query("SELECT component_id, kind, count(*) OVER () AS total, count(*) OVER () > 70 AS has_more FROM components ORDER BY kind, component_id LIMIT 20 OFFSET 50", "components")
def component_page(g):
    return graph.page(g.components.select("component_id", "kind"), [F.col("kind"), F.col("component_id")], 50, 20)


@query("SELECT count(*) AS total, count(CASE WHEN resolution_status <> 'Resolved' THEN 1 END) AS unresolved FROM serialized_refs", "serialized_refs components")
def reference_counts(g):
    return g.serialized_refs.agg(F.count("*").alias("total"), F.count(F.when(F.col("resolution_status") != "Resolved", 1)).alias("unresolved"))


_SEL = "(SELECT s_name AS selector FROM supplier UNION ALL SELECT r_name FROM region UNION ALL SELECT concat('supplier-', s_suppkey) FROM supplier UNION ALL SELECT concat(s_name, '?') FROM supplier)"


@query(f"SELECT selector, CASE WHEN scene_id IS NULL THEN 'NotFound' ELSE 'Resolved' END AS status, scene_id AS id FROM {_SEL} LEFT JOIN scenes ON selector = scene_id OR selector = name", "scenes")
def scene_selectors(g):
    s = g.base("supplier").selectExpr("explode(array(s_name, concat('supplier-', s_suppkey), concat(s_name, '?'))) AS selector")
    return lookup.select_rows(g.scenes, s.union(g.base("region").select("r_name")), "scene_id", [F.col("name")])


@query("""SELECT selector, CASE count(component_id) WHEN 0 THEN 'NotFound' WHEN 1 THEN 'Resolved' ELSE 'Ambiguous' END AS status, CASE WHEN count(component_id) = 1 THEN min(component_id) END AS id
 FROM (SELECT concat('Catalog.Part', p_partkey) AS selector FROM part UNION ALL SELECT DISTINCT kind FROM components WHERE kind <> 'MonoBehaviour') LEFT JOIN components ON kind = selector OR concat(script_namespace, '.', script_class) = selector GROUP BY selector""", "components")  # fmt: skip
def component_selectors(g):
    s = g.base("part").selectExpr("concat('Catalog.Part', p_partkey) AS selector").union(g.components.where("kind <> 'MonoBehaviour'").select("kind").distinct())
    full = F.when(F.col("script_class").isNotNull(), F.concat("script_namespace", F.lit("."), "script_class"))
    return lookup.select_rows(g.components, s, "component_id", [F.col("kind"), full])


@query("SELECT selector, CASE WHEN game_object_id IS NULL THEN 'NotFound' ELSE 'Resolved' END AS status, game_object_id AS id FROM (SELECT concat('region-', c_nationkey % 5, '/', c_name) AS selector FROM customer) LEFT JOIN game_objects ON selector = concat(scene_id, '/', name)", "game_objects")
def object_selectors(g):
    s = g.base("customer").selectExpr("concat('region-', c_nationkey % 5, '/', c_name) AS selector")
    return lookup.select_rows(g.game_objects, s, "game_object_id", [F.concat_ws("/", "scene_id", "name")])


@query("SELECT game_object_id, name FROM game_objects WHERE parent_id IS NULL ORDER BY name, game_object_id LIMIT 100", "game_objects")
def root_objects(g):
    return g.game_objects.where("parent_id IS NULL").orderBy("name", "game_object_id").limit(100).select("game_object_id", "name")


@query("SELECT recovery_status, count(*) AS n FROM (SELECT recovery_status FROM game_objects UNION ALL SELECT CASE WHEN hierarchy THEN 'FullyRecovered' ELSE 'PartiallyRecovered' END FROM (SELECT " + _VALID + " AS hierarchy FROM transforms)) GROUP BY 1", "game_objects transforms")
def recovery_histogram_tables(g):
    columns = ("file_version", "unity_version", "byte_offset", "byte_count", "container_size")
    status = F.when(normalise.schema_and_bounds(*(F.col(c) for c in columns)), "FullyRecovered").otherwise("PartiallyRecovered")
    return scene.recovery_histogram(g.game_objects, g.transforms.select(status.alias("recovery_status")))


@query("SELECT container_path, side FROM (SELECT container_path, 'parsed' AS side FROM (SELECT DISTINCT container_path FROM placed_objects) WHERE container_path NOT IN (SELECT container_path FROM containers) UNION ALL SELECT container_path, 'verified' FROM containers WHERE container_path NOT IN (SELECT container_path FROM placed_objects))", "placed_objects game_objects containers")
def container_set_difference(g):
    parsed, verified = g.placed_objects.select("container_path").distinct(), g.containers.select("container_path")
    return parsed.exceptAll(verified).withColumn("side", F.lit("parsed")).unionByName(verified.exceptAll(parsed).withColumn("side", F.lit("verified")))
