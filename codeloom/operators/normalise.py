"""From parsed scene containers to facts: pointers, transform hierarchies, prefabs and the documents of objects.

What cannot be right in a parsed container is no row of a result but one of a violations frame, which a caller checks
before it publishes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the supported serialized files, and the classes that prove a prefab
FILE_VERSION, UNITY = 22, "2022.3.62"
PREFAB_CLASSES = (1001, 1001480554)


def schema_and_bounds(version: Column, unity: Column, offset: Column, count: Column, size: Column) -> Column:
    """Whether a file has the known layout and an object lies inside it; the sum of offset and count is never formed."""
    return F.coalesce((version == FILE_VERSION) & unity.startswith(UNITY) & (offset >= 0) & (count > 0) & (size >= count) & (offset <= size - count), F.lit(False))


def external_path(path: Column) -> Column:
    """A path of an external table: forward slashes, what follows an archive's or cabinet's mark, no leading slashes."""
    out = F.translate(path, "\\", "/")
    for mark in ("archive:/", "/CAB/"):
        out = F.regexp_replace(out, f"(?is)^.*{mark}", "")
    return F.regexp_replace(out, "^/+", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def resolve_pointers(pointers: DataFrame, externals: DataFrame, containers: DataFrame, objects: DataFrame) -> DataFrame:
    """pointer_id, status, target_path, target_local_id, violation of each pointer.

    Local id 0 is a null pointer. File id 0 stays in the pointer's own file; others go through the file's external table,
    to the one container with that path, or else, if no container has it, to the one with that base name; none or several
    leave the pointer as text. A negative local id, or a target that its container does not hold, is a violation. The
    external tables are resolved once, apart from the pointers, which then meet them in one join.
    """
    blank = lambda c: F.when(F.trim(c) != "", c)
    wanted = F.array_compact(F.array(*(external_path(blank(F.col(c))) for c in ("path_name", "original_path_name"))))
    asked = externals.select("source_path", "file_id", F.explode(F.array_distinct(wanted)).alias("path"))
    own = ("source_path", "file_id")
    exact = asked.join(containers.select(F.col("container_path").alias("path")), "path").select(*own, F.lit(0).alias("tier"), "path")
    names = asked.select(*own, base_name(F.col("path")).alias("name")).where("name <> ''").distinct()
    named = containers.select(base_name(F.col("container_path")).alias("name"), F.col("container_path").alias("path"))
    # of equal base names the number is needed, and the path only where it is the one
    few = named.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    near = names.join(few, "name").select(*own, F.lit(1).alias("tier"), "path", "n")
    best = exact.withColumn("n", F.lit(1)).unionByName(near).groupBy(*own, "tier").agg(F.sum("n").alias("n"), F.min("path").alias("path"))
    best = best.groupBy(*own).agg(F.min(F.struct("tier", "n", "path")).alias("b"))
    found = externals.select(*own).distinct().join(best, list(own), "left").select(*own, F.when(F.col("b.n") == 1, F.col("b.path")).alias("external"))
    met = pointers.join(found, list(own), "left")
    path = F.when(F.col("file_id") == 0, F.col("source_path")).otherwise(F.col("external"))
    met = met.withColumn("path", F.when(F.col("local_file_id") > 0, path))
    held = objects.select(F.col("container_path").alias("path"), "local_file_id", F.lit(True).alias("held")).distinct()
    met = met.join(held, ["path", "local_file_id"], "left")
    violation = F.when(F.col("local_file_id") < 0, "NegativeLocalId").when(F.col("path").isNotNull() & F.col("held").isNull(), "MissingTarget")
    status = F.when(F.col("local_file_id") == 0, "Unavailable").when(F.col("local_file_id") < 0, None).when(F.col("path").isNull(), "UnresolvedText").when(F.col("held"), "Resolved")
    return met.select("pointer_id", status.alias("status"), F.when(F.col("held"), F.col("path")).alias("target_path"), F.when(F.col("held"), F.col("local_file_id")).alias("target_local_id"), violation.alias("violation"))


def reconcile(transforms: DataFrame, lists: DataFrame) -> DataFrame:
    """transform_id, parent_id, sibling_index, schema_valid, hierarchy_complete.

    A root's place is its own; a child's is its last position in its parent's list. A parent that is missing, an entry
    that leads nowhere, and a child that its parent does not list leave the hierarchy incomplete, the last at both ends.
    Lists of one parent are never gathered: all is counted by key.
    """
    valid = schema_and_bounds(*(F.col(c) for c in ("file_version", "unity_version", "byte_offset", "byte_count", "container_size")))
    facts = transforms.select("transform_id", "parent_id", "root_order", valid.alias("schema_valid"))
    readable = facts.where("schema_valid").select(F.col("transform_id").alias("parent_id"))
    entries = lists.join(readable, "parent_id", "left_semi")
    known = facts.select(F.col("transform_id").alias("parent_id"), F.col("schema_valid").alias("parent_valid"))
    facts = facts.join(known, "parent_id", "left")
    listed = entries.where("child_id IS NOT NULL").groupBy("parent_id", F.col("child_id").alias("transform_id")).agg(F.max("place").alias("place"))
    facts = facts.join(listed, ["parent_id", "transform_id"], "left")
    forgotten = F.col("schema_valid") & F.coalesce("parent_valid", F.lit(False)) & F.col("place").isNull()
    facts = facts.withColumn("forgotten", forgotten)
    bad = facts.where("forgotten").select("parent_id").union(entries.where("child_id IS NULL").select("parent_id")).distinct()
    facts = facts.join(bad.select(F.col("parent_id").alias("transform_id"), F.lit(True).alias("bad")), "transform_id", "left")
    lost = F.col("parent_id").isNotNull() & F.col("parent_valid").isNull()
    complete = F.col("schema_valid") & ~lost & ~F.col("forgotten") & F.col("bad").isNull()
    place = F.when(F.col("schema_valid"), F.when(F.col("parent_id").isNull(), F.col("root_order")).otherwise(F.col("place")))
    return facts.select("transform_id", F.when(F.col("schema_valid") & F.col("parent_valid").isNotNull(), F.col("parent_id")).alias("parent_id"), place.alias("sibling_index"), "schema_valid", complete.alias("hierarchy_complete"))


def list_violations(transforms: DataFrame, lists: DataFrame) -> DataFrame:
    """Entries of readable child lists whose child is unknown, cannot be read, or names another parent."""
    valid = schema_and_bounds(*(F.col(c) for c in ("file_version", "unity_version", "byte_offset", "byte_count", "container_size")))
    readable = transforms.where(valid)
    entries = lists.where("child_id IS NOT NULL").join(readable.select(F.col("transform_id").alias("parent_id")), "parent_id", "left_semi")
    own = readable.select(F.col("transform_id").alias("child_id"), F.col("parent_id").alias("named_parent"))
    return entries.join(own, "child_id", "left").where("NOT named_parent <=> parent_id").select("parent_id", "child_id", "named_parent")


def prefab_roots(evidence: DataFrame, objects: DataFrame) -> DataFrame:
    """evidence_id, root_id, roots of each object that proves a prefab; several roots are a violation and none is taken."""
    proofs = evidence.where(F.col("class_id").isin(*PREFAB_CLASSES))
    named = F.col("declared_type").contains("GameObject") & F.lower("field_path").contains("root")
    hit = proofs.where(named).join(objects.select(F.col("game_object_id").alias("target_id")), "target_id", "left_semi")
    roots = hit.groupBy("evidence_id").agg(F.countDistinct("target_id").alias("roots"), F.min("target_id").alias("target_id"))
    out = proofs.select("evidence_id").distinct().join(roots, "evidence_id", "left").na.fill(0, ["roots"])
    return out.select("evidence_id", F.when(F.col("roots") == 1, F.col("target_id")).alias("root_id"), "roots")


def reached(objects: DataFrame, roots: DataFrame, put, max_rounds: int = 1000) -> DataFrame:
    """root_id, game_object_id, depth of all that is reached from each distinct root, itself included.

    One level a round; ``put`` writes a frame and reads it back, so plans stay short and a lost executor costs one round.
    An object reached again from the same root ends there, so cycles end too.
    """
    down = objects.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("above"), "game_object_id")
    edge = put(roots.where("root_id IS NOT NULL").select("root_id", F.col("root_id").alias("game_object_id"), F.lit(0).alias("depth")).distinct())
    seen = edge
    for depth in range(1, max_rounds + 1):
        step = edge.select("root_id", F.col("game_object_id").alias("above")).join(down, "above").select("root_id", "game_object_id").distinct()
        edge = put(step.join(seen, ["root_id", "game_object_id"], "left_anti").withColumn("depth", F.lit(depth)))
        if edge.isEmpty():
            return seen
        seen = seen.unionByName(edge)
    raise ValueError(f"deeper than {max_rounds} levels")


def descendants(objects: DataFrame, roots: DataFrame, put, max_rounds: int = 1000) -> DataFrame:
    """evidence_id, game_object_id, depth of all that is reached from each root, itself included. Proofs of one root share what
    it reaches, which is found once and opened for them at the end."""
    proofs = roots.where("root_id IS NOT NULL").select("evidence_id", "root_id").distinct()
    return reached(objects, roots, put, max_rounds).join(proofs, "root_id").select("evidence_id", "game_object_id", "depth")


def assign_documents(objects: DataFrame, roots: DataFrame, members: DataFrame) -> DataFrame:
    """game_object_id, kind, document, claims: a level file takes its objects first, then a proven prefab what it reaches,
    and the rest stays with its asset file. A prefab whose root a level holds claims nothing; more than one claim on an
    object is a violation, and the first in order is shown. ``members`` is what ``descendants`` or ``reached`` gives; of the
    latter claims are counted by root, so no row is made for an object and each of its proofs."""
    level = F.when(base_name(F.col("container_path")).rlike("^level[0-9]+$"), F.col("container_path"))
    held = objects.select("game_object_id", "container_path", level.alias("level"))
    taken = held.where("level IS NOT NULL").select(F.col("game_object_id").alias("root_id"))
    by = "root_id" if "root_id" in members.columns else "evidence_id"
    open_ = roots.where("root_id IS NOT NULL").select("evidence_id", "root_id").distinct().join(taken, "root_id", "left_anti")
    open_ = open_.select(F.col(by).alias("by"), "evidence_id").groupBy("by").agg(F.min("evidence_id").alias("prefab"), F.count("*").alias("n"))
    claims = members.withColumnRenamed(by, "by").join(open_, "by").groupBy("game_object_id").agg(F.min("prefab").alias("prefab"), F.sum("n").alias("n"))
    out = held.join(claims, "game_object_id", "left")
    kind = F.when(F.col("level").isNotNull(), "Scene").when(F.col("prefab").isNotNull(), "Prefab").otherwise("AssetGraph")
    n = F.coalesce("n", F.lit(0)) + F.col("level").isNotNull().cast("int")
    return out.select("game_object_id", kind.alias("kind"), F.coalesce("level", "prefab", "container_path").alias("document"), n.alias("claims"))


def code_symbols(scripts: DataFrame, indexes: DataFrame, symbols: DataFrame, assemblies: list[str], prefix: str) -> DataFrame:
    """script_id, status, symbol_id: the one type symbol of a script in the very index and extraction it belongs to.

    Other assemblies, and scripts without namespace or class, stay text; ``indexes`` (index_id, snapshot_id,
    source_identity, build_ok) holds completed ones only.
    """
    mine = F.col("assembly_name").isin(*assemblies) & (F.trim("script_namespace") != "") & (F.trim("script_class") != "")
    key = F.concat(F.lit(prefix), F.trim("script_namespace"), F.lit("."), F.trim("script_class"))
    s = scripts.withColumn("mine", F.coalesce(mine, F.lit(False))).withColumn("canonical_key", key)
    s = s.join(indexes, "index_id", "left")
    hits = symbols.where("kind = 'Type'").groupBy("snapshot_id", "canonical_key").agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id"))
    s = s.join(hits, ["snapshot_id", "canonical_key"], "left")
    right = F.coalesce(F.col("build_ok") & (F.col("source_identity") == F.col("extraction_id")), F.lit(False))
    status = F.when(~F.col("mine"), "UnresolvedText").when(F.col("snapshot_id").isNull(), "NotIndexed").when(~right, "Unavailable")
    status = status.when(F.col("n").isNull(), "NotIndexed").when(F.col("n") == 1, "Resolved").otherwise("Ambiguous")
    return s.select("script_id", status.alias("status"), F.when(status == "Resolved", F.col("symbol_id")).alias("symbol_id"))
