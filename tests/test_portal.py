"""Bounded pages, portal rows, chosen inputs, versions of a schema, cleanup reasons and small rules on small frames."""

import datetime
import json
import random

from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import inputs, lineage, portal
from codeloom.operators.pages import Level, nested, nested_pages, numbered, sub_pages

# ---- pages ----


def levels(spark, objects, parts):
    o = spark.createDataFrame(objects, "oid string, scene string, name string")
    p = spark.createDataFrame(parts, "pid string, owner string")
    return [Level("objects", o, "oid", "scene", [F.col("name"), F.col("oid")], 3), Level("parts", p, "pid", "owner", [F.col("pid")], 2)]


def test_pages_with_a_hot_parent_equal_brute_force(spark):
    rng = random.Random(1)
    objects = [(f"o{i}", "hot" if i % 2 else f"s{i % 20}", rng.choice("abc")) for i in range(400)]  # 200 rows in one scene, 20 in others
    parts = [(f"p{i}", f"o{rng.randint(0, 399)}") for i in range(900)]
    parents = spark.createDataFrame([("hot",), ("s0",), ("s2",), ("empty",)], "parent_id string")
    got = {(r.level, r.parent_id, r.place): (r.row_id, r.total, r.has_more) for r in nested_pages(parents, levels(spark, objects, parts)).collect()}
    want = {}

    def put(level, parent, rows, limit):
        for place, row in enumerate(rows[:limit], 1):
            want[level, parent, place] = (row, len(rows), len(rows) > limit)
        if not rows:
            want[level, parent, None] = (None, 0, False)
        return rows[:limit]

    for s in ("hot", "s0", "s2", "empty"):
        for o in put("objects", s, [o for o, sc, n in sorted(objects, key=lambda r: (r[2], r[0])) if sc == s], 3):
            put("parts", o, [p for p, owner in sorted(parts) if owner == o], 2)
    assert got == want
    pages = {r.parent_id: r.page for r in nested(parents, levels(spark, objects, parts)).collect()}
    assert pages["hot"].total == 200 and pages["hot"].has_more and pages["empty"].rows is None and pages["empty"].total == 0
    first = pages["hot"].rows[0]
    assert (first.place, first.id) == (1, want["objects", "hot", 1][0]) and [x.id for x in first.page.rows or []] == [want["parts", first.id, n][0] for n in (1, 2) if ("parts", first.id, n) in want]


def test_numbers_within_hot_keys(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", (i * 37) % 100, i) for i in range(600)]
    frame = spark.createDataFrame(rows, "k string, a long, b long").repartition(7)
    want = {b: sorted((x, y) for q, x, y in rows if q == k).index((a, b)) + 1 for k, a, b in rows}
    assert {r.b: r.n for r in numbered(frame, "k", ["a", "b"], "n").collect()} == want and numbered(frame.limit(0), "k", ["a", "b"], "n").collect() == []


def test_pages_of_null_parents_and_empty_tables(spark):
    side = levels(spark, [("a", None, "x")], [])
    parents = spark.createDataFrame([("s",), (None,)], "parent_id string")
    assert {(r.level, r.parent_id, r.row_id, r.total) for r in sub_pages(parents, side[:1]).collect()} == {("objects", "s", None, 0), ("objects", None, None, 0)}
    assert sub_pages(parents.limit(0), side).collect() == []


# ---- portal ----

SYM = "symbol_id string, canonical_key string, kind string, qualified_name string, signature string, body_recovery_status string"


def portal_symbols(spark):
    rows = [("t", "Game:Installed:Type:N.T", "Type", "N.T", "N.T", None), ("m", "Game:Installed:Method:N.T::M():System.Void", "Method", "N.T::M():System.Void", "M()", "Recovered"), ("f", "Game:Installed:Field:N.T::int f", "Field", "N.T::int f", "int f", None),
            ("g", "Game:Installed:Field:Gone::int f", "Field", "Gone::int f", "int f", None), ("h", "Game:Beta:Field:N.T::int f", "Field", "N.T::int f", "int f", None)]
    return spark.createDataFrame(rows, SYM)


def test_members_stand_on_their_types_page(spark):
    rows = {r.symbol_id: r for r in portal.pages(portal_symbols(spark)).collect()}
    assert rows["f"].page_path == rows["t"].page_path and rows["f"].anchor != rows["t"].anchor and rows["f"].href == f"{rows['t'].page_path}#{rows['f'].anchor}"
    assert rows["m"].page_path != rows["t"].page_path and rows["t"].page_path.startswith("code/game/installed/symbols/") and rows["t"].page_path.endswith(".html")
    assert rows["g"].page_path != rows["t"].page_path and "/beta/" in rows["h"].page_path  # no such type, and one of another channel


def test_portal_model_and_search_index(spark):
    edge = "relationship_id string, source_symbol_id string, target_symbol_id string, target_text string, relationship_kind string"
    edges = spark.createDataFrame([("1", "m", "m", "x", "Calls"), ("2", "m", "t", "x", "ReadsField"), ("3", "t", "m", "x", "Constructs"), ("4", "m", None, "x", "Calls")], edge)
    rows = {r.symbol_id: r.evidence for r in portal.model(portal_symbols(spark), edges, "P", shown=2).collect()}
    assert (rows["m"].references, rows["m"].callers, rows["m"].callees) == (4, 2, 2) and [x.relationship_id for x in rows["m"].references_shown] == ["1", "2"]
    assert [(x.relationship_id, x.direction) for x in rows["m"].callers_shown] == [("1", "Incoming"), ("3", "Incoming")] and rows["m"].callees_notice == "P has affirmative recovered-body evidence."
    assert rows["t"].references == 2 and rows["f"] is None
    lines = [json.loads(r.line) for r in portal.search_index(portal.pages(portal_symbols(spark))).collect()]
    order = [(x["codebase"], x["channel"], x["qualifiedName"], x["signature"], x["kind"], x["symbolId"], x["href"]) for x in lines]
    assert order == sorted(order) and set(lines[0]) == {"codebase", "channel", "qualifiedName", "signature", "kind", "symbolId", "exactKey", "href"}


def test_statements_and_numbers(spark):
    counted = spark.createDataFrame([("s", 0, 1, 11, "Unavailable")], "symbol_id string, callers long, callees long, references long, state string")
    said = [r.statement for r in portal.statements(counted, F.col("state")).orderBy("place").collect()]
    assert said == ["DERIVED: zero callers in this index.", "DERIVED: one callee in this index.", "DERIVED: 11 references in this index.", "DERIVED: Modder relevance signal: zero callers and one callee are measured in this index.", "DERIVED: Unavailable"]
    assert counted.select(text.coverage_text(F.lit(10), F.lit(12))).first()[0] == "showing ten of 12"


# ---- inputs ----

CANDIDATE = "candidate_id string, build_id string, kind string, root string, newness long, valid boolean, replay_verified boolean"


def test_precedence_of_inputs(spark):
    rows = [
        ("o1", "a", "observation", "C:/G", 1, True, False), ("o2", "a", "observation", "C:/H", 2, True, False), ("d1", "a", "default", "C:/I", -1, True, False), ("z1", "a", "archive", "S/1", 9, True, True),
        ("o3", "b", "observation", "C:/G", 5, False, False), ("d2", "b", "default", "c:\\g\\", -1, True, False), ("d3", "b", "default", "C:/K", -2, True, False), ("z2", "b", "archive", "S/2", 9, True, True),
        ("z3", "c", "archive", "S/3", 9, True, False), ("z4", "c", "archive", "S/4", 5, False, True), ("z5", "d", "archive", "S/5", 1, True, True), ("z6", "d", "archive", "S/6", 1, True, True),
    ]
    asks = [(1, "a", None, None), (2, "b", " ", ""), (3, "c", None, None), (4, "d", None, None), (5, "e", None, None), (6, "a", "z1", "D:/x"), (7, "c", "z3", None), (8, "a", "z3", None), (9, "a", None, "D:/x"), (10, "c", "z4", None), (11, "a", "nope", None), (12, "a", "o1", None)]
    got = inputs.choose(spark.createDataFrame(asks, "request_id long, build_id string, snapshot string, path string"), spark.createDataFrame(rows, CANDIDATE)).collect()
    assert {r.request_id: (r.outcome, r.candidate_id) for r in got} == {
        1: ("observation", "o2"), 2: ("default", "d3"), 3: ("ArchivedInputInvalid", None), 4: ("archive", "z6"), 5: ("LiveInputNotFound", None), 6: ("Exclusive", None), 7: ("ExplicitSnapshot", "z3"),
        8: ("ArchivedInputInvalid", None), 9: ("ExplicitPath", None), 10: ("ArchivedInputInvalid", None), 11: ("ArchivedInputInvalid", None), 12: ("ArchivedInputInvalid", None),
    }


def test_schema_versions_read_as_one(spark):
    builds = spark.createDataFrame([("b", "t", "v1", "s1")], "build_id string, scanned_at string, game_version string, steam_build_id string")
    old = spark.createDataFrame([("e1", "b"), ("e2", "gone"), ("e3", "b")], "snapshot_id string, build_id string")
    new = inputs.upgraded_environments(old, builds)
    assert {(r.snapshot_id, r.identity_version, r.executable_version, r.steam_build_id, r.installation_root) for r in new.collect()} == {("e1", 1, "v1", "s1", None), ("e2", 1, None, None, None), ("e3", 1, "v1", "s1", None)}
    later = inputs.upgraded_builds(builds)
    assert later.columns == ["build_id", "first_seen"] and inputs.upgraded_builds(later).columns == later.columns
    assert sorted(map(str, inputs.upgraded_environments(new, later).collect())) == sorted(map(str, new.collect()))  # again changes nothing
    fresh = new.where("snapshot_id = 'e3'").withColumn("executable_version", F.lit("v9"))
    one = {r.snapshot_id: r.executable_version for r in inputs.as_one([(old, builds), (fresh, later)]).collect()}
    assert one == {"e1": "v1", "e2": None, "e3": "v9"}


# ---- cleanup, and rules of one value ----


def test_cleanup_reasons_in_their_order(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    name = lambda c: c * 32
    row = lambda c, **k: {"attempt_id": name(c), "build_id": "b", "status": "Failed", "completed_at": day(1), "result_id": None, "candidate_output": None, "journal": False, "blocked": False, "evidence": False} | k
    rows = [row("a"), row("b", evidence=True), row("c", blocked=True, evidence=True), row("d", journal=True, blocked=True), row("e", candidate_output="x", journal=True), row("f", result_id="x", candidate_output="x"), row("1", build_id="..", result_id="x"),
            row("2", completed_at=day(5)), row("3", completed_at=None), row("4", status="Running"), row("5", attempt_id="A" * 32)]
    schema = "attempt_id string, build_id string, status string, completed_at timestamp_ntz, result_id string, candidate_output string, journal boolean, blocked boolean, evidence boolean"
    attempts = spark.createDataFrame([[r[c.split()[0]] for c in schema.split(", ")] for r in rows], schema)
    cutoff = F.lit(day(5)).cast("timestamp_ntz")
    got = {r.id[0]: r.decision for r in lineage.cleanup_decisions(attempts, cutoff).collect()}
    assert got == {"a": "Eligible", "b": "CleanupCompletionEvidence", "c": "CleanupTreeBlocked", "d": "CleanupPromotionJournal", "e": "CleanupCandidateOutput", "f": "CleanupHasResultExtraction", "1": "CleanupUnsafeIdentity", "A": "CleanupUnsafeIdentity"}
    entries = [(name("a"), True), (name("b"), True), (name("b") + ".promotion.json", False), (name("9"), True), (name("4"), True), (name("2"), True), ("x", True), (name("c"), False)]
    got = {r.id: r.decision for r in lineage.staging_decisions(spark.createDataFrame(entries, "name string, is_folder boolean"), attempts, cutoff).collect()}
    want = ["Eligible", "CleanupPromotionJournal", "CleanupPromotionJournal", "CleanupOrphanStaging", "CleanupActiveAttempt", "CleanupTooRecent", "CleanupUnknownEntry", "CleanupUnknownEntry"]
    assert got == {e[0]: w for e, w in zip(entries, want, strict=True)}


def test_durations_hashes_and_recovery(spark):
    texts = ["1m", "2h", "36500d", "36501d", "0d", "-1d", "1.5h", "5", "d", "5w", " 5d", "99999999999999999999d", None, "5D"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in d.select(text.duration_minutes(F.col("t"))).collect()] == [1, 120, 52_560_000, *[None] * 11]
    hashes = ["a" * 64, "A" * 64, "a" * 63, "a" * 64 + "\n", "g" * 64, None, "a" * 32]
    h = spark.createDataFrame([(t,) for t in hashes], "t string")
    assert [r[0] for r in h.select(text.is_sha256(F.col("t"))).collect()] == [True, *[False] * 6] and [r[0] for r in h.select(text.is_guid(F.col("t"))).collect()] == [*[False] * 6, True]
    facts = [(False, True, True, True, True), (True, False, True, True, True), (True, True, True, False, True), (True, True, True, True, True), (True, True, True, True, False), (True, True, False, False, True)]
    f = spark.createDataFrame(facts, "a boolean, b boolean, c boolean, d boolean, e boolean")
    assert [r[0] for r in f.select(text.scene_recovery(*(F.col(x) for x in "abcde"))).collect()] == ["Unknown", "StubOrUnavailable", "GraphOnly", "FullyRecovered", "PartiallyRecovered", "PartiallyRecovered"]
