"""Checks of a set of tables before they are published as one: snapshot, owners, and the authorities that they name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tables of a scene snapshot with their row ids, and what each row must find among the others.
ROW_IDS = {"containers": "container_id", "documents": "scene_id", "objects": "game_object_id", "transforms": "game_object_id", "components": "component_id", "references": "reference_id"}
OWNERS = (
    ("documents", "container_id", "containers"), ("objects", "scene_id", "documents"), ("objects", "container_id", "containers"), ("transforms", "game_object_id", "objects"),
    ("transforms", "parent_id", "objects"), ("components", "game_object_id", "objects"), ("components", "container_id", "containers"), ("references", "source_container_id", "containers"),
    ("references", "source_component_id", "components"), ("references", "target_container_id", "containers"), ("references", "target_object_id", "objects"), ("references", "target_component_id", "components"),
)
OPTIONAL = ("parent_id", "source_component_id", "target_container_id", "target_object_id", "target_component_id")


def _problem(rows: DataFrame, table: str, problem: str) -> DataFrame:
    return rows.select(F.lit(problem).alias("problem"), F.lit(table).alias("table_name"), F.col(ROW_IDS[table]).alias("row_id"))


def ownership(tables: dict[str, DataFrame], snapshot: str) -> list[DataFrame]:
    """Rows of another snapshot, and rows whose owner is not among the tables. A column that may be empty is checked where it
    is not."""
    out = [_problem(rows.where(~F.col("scene_snapshot_id").eqNullSafe(F.lit(snapshot))), name, "OtherSnapshot") for name, rows in tables.items() if "scene_snapshot_id" in rows.columns]
    for name, column, owner in OWNERS:
        there = tables[owner].select(F.col(ROW_IDS[owner]).alias("_owner"))
        asked = tables[name].where(F.col(column).isNotNull()) if column in OPTIONAL else tables[name]
        out.append(_problem(asked.join(there, F.col(column) == F.col("_owner"), "left_anti"), name, f"NoOwner:{column}"))
    return out


def type_authority(rows: DataFrame, table: str, column: str, types: DataFrame) -> DataFrame:
    """Rows that name a symbol which is not a type of the snapshot's own index (``types``: symbol_id)."""
    named = rows.where(F.col(column).isNotNull())
    return _problem(named.join(types.select(F.col("symbol_id").alias("_type")), F.col(column) == F.col("_type"), "left_anti"), table, "ForeignSymbol")


def problems(tables: dict[str, DataFrame], snapshot: str, types: DataFrame) -> DataFrame:
    """problem, table_name, row_id: all that speaks against publishing; without a row the tables hold together."""
    found = [*ownership(tables, snapshot), type_authority(tables["components"], "components", "resolved_symbol_id", types), type_authority(tables["references"], "references", "target_symbol_id", types)]
    return reduce(DataFrame.unionByName, found).distinct()


def same_build(scenes: DataFrame, extractions: DataFrame, attempts: DataFrame, inputs: DataFrame, code: DataFrame, environments: DataFrame, runs: DataFrame) -> DataFrame:
    """scene_snapshot_id, problem (null if none): whether extraction, input, environment and index of each scene belong to one
    build, the input has been replayed, and the index is a completed one of the very code snapshot."""
    x = extractions.select("extraction_id", F.col("build_id").alias("x_build"))
    a = attempts.select("extraction_id", F.col("input_id").alias("a_input"))
    i = inputs.select("input_id", F.col("build_id").alias("i_build"), "replay_verified")
    c = code.select(F.col("snapshot_id").alias("code_snapshot_id"), "codebase", "channel", "environment_id")
    e = environments.select("environment_id", F.col("build_id").alias("e_build"))
    r = runs.select(F.col("index_id").alias("code_index_id"), F.col("snapshot_id").alias("r_snapshot"), F.col("status").alias("r_status"))
    met = scenes.select("scene_snapshot_id", "build_id", "extraction_id", "input_id", "code_snapshot_id", "code_index_id")
    for side, key in ((x, "extraction_id"), (a, "extraction_id"), (i, "input_id"), (c, "code_snapshot_id"), (e, "environment_id"), (r, "code_index_id")):
        met = met.join(side, key, "left")
    absent = F.col("x_build").isNull() | F.col("a_input").isNull() | F.col("i_build").isNull() | F.col("codebase").isNull() | F.col("e_build").isNull() | F.col("r_status").isNull()
    other = lambda c: F.col(c) != F.col("build_id")
    problem = (
        F.when(absent, "Missing").when(other("x_build"), "ExtractionBuild").when(other("i_build"), "InputBuild").when(other("e_build"), "EnvironmentBuild").when(~F.col("replay_verified"), "NotReplayed")
        .when(F.col("a_input") != F.col("input_id"), "OtherInput").when((F.col("codebase") != "game") | (F.col("channel") != "installed"), "OtherCode").when(F.col("r_snapshot") != F.col("code_snapshot_id"), "OtherIndex")
        .when(F.col("r_status") != "Completed", "IndexNotCompleted")
    )
    return met.select("scene_snapshot_id", problem.alias("problem"))


def starts(snapshots: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (scene_snapshot_id) with outcome: a published snapshot is never touched, a running one has its writer, one that
    ended unpublished is made anew, and others are made."""
    now = snapshots.select("scene_snapshot_id", "status", "published_at")
    outcome = F.when(F.col("status").isNull(), "Created").when(F.col("published_at").isNotNull(), "Published").when(F.col("status") == "Running", "Running").otherwise("Recreated")
    return requests.join(now, "scene_snapshot_id", "left").select("scene_snapshot_id", outcome.alias("outcome"))


def removed(started: DataFrame, tables: list[tuple[str, DataFrame, str, str, str | None]]) -> DataFrame:
    """table_name, row_id of all that making snapshots anew removes. ``tables`` (name, rows, row id, key, parent) go down from the
    snapshots: a table's key is the snapshot's, or the row id of the parent table before it."""
    marked = {None: started.where("outcome = 'Recreated'").select(F.col("scene_snapshot_id").alias("_key"))}
    out = [marked[None].select(F.lit("snapshots").alias("table_name"), F.col("_key").alias("row_id"))]
    for name, rows, row_id, key, parent in tables:
        marked[name] = rows.join(marked[parent], F.col(key) == F.col("_key"), "left_semi").select(F.col(row_id).alias("_key"))
        out.append(marked[name].select(F.lit(name).alias("table_name"), F.col("_key").alias("row_id")))
    return reduce(DataFrame.unionByName, out)
