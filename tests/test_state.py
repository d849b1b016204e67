"""Versioned logs, guarded changes, preferences, authority, checked write-sets, reconciling and integrity: small cases and brute force."""

import datetime
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from codeloom.operators import authority, indexing, integrity, lineage, preference, state, writeset
from codeloom.operators.asof import at_times
from codeloom.sources.snapshots import Store, create_file
from codeloom.sources.versions import VersionedLog

T0 = datetime.datetime(2024, 1, 1)
ATTEMPT = "attempt_id long, status string, changed_at timestamp_ntz, completed_at timestamp_ntz, result_id string"
MOVE = "request_id long, attempt_id long, expected_status string, expected_at timestamp_ntz, next_status string, moment timestamp_ntz"


def t(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


# ---- the log ----


def log_of(spark, tmp_path, rows):
    log = VersionedLog(spark, f"file://{tmp_path}/log")
    assert log.version() == 0 and log.state(["attempt_id"]) is None
    assert log.commit(spark.createDataFrame(rows, ATTEMPT), 1)
    return log


def test_of_two_writers_one_wins(spark, tmp_path):
    log = log_of(spark, tmp_path, [(1, "Created", t(0), None, None)])
    other = VersionedLog(spark, log.path)
    move = lambda next_, i: spark.createDataFrame([(i, 1, "Created", t(0), next_, t(i))], MOVE)
    ours, theirs = (state.transition(w.state(["attempt_id"]), move(n, i)) for w, n, i in ((log, "Preparing", 1), (other, "Failed", 2)))
    assert other.commit(state.moved(theirs), 2) and not log.commit(state.moved(ours), 2)  # both saw version 1
    again = state.transition(log.state(["attempt_id"]), move("Preparing", 1)).collect()
    assert [r.outcome for r in again] == ["Illegal"]  # from Failed nothing follows
    assert [(r.status, r.completed_at) for r in log.state(["attempt_id"]).collect()] == [("Failed", t(2))] and log.version() == 2


def test_a_change_is_decided_again_after_a_lost_race(spark, tmp_path):
    log = log_of(spark, tmp_path, [(1, "Created", t(0), None, None)])
    seen = []

    def decide(now):
        seen.append(log.version())
        if len(seen) == 1:  # another writer comes between
            assert VersionedLog(spark, log.path).commit(spark.createDataFrame([(1, "Preparing", t(1), None, None)], ATTEMPT), 2)
        return state.transition(now, spark.createDataFrame([(9, 1, "Created", t(0), "Failed", t(5))], MOVE))

    decided = log.change(["attempt_id"], decide, state.moved).collect()
    assert seen == [1, 2] and [r.outcome for r in decided] == ["StatusChanged"]
    assert [r.status for r in log.state(["attempt_id"]).collect()] == ["Preparing"] and log.version() == 3


def test_replay_compaction_and_lost_writers(spark, tmp_path):
    log = log_of(spark, tmp_path, [(1, "Created", t(0), None, None), (2, "Created", t(0), None, None)])
    gone = spark.createDataFrame([(2, "Created", t(0), None, None)], ATTEMPT).withColumn("_deleted", F.lit(True))
    assert log.commit(gone, 2)
    assert create_file(spark, f"{log.path}/_versions/{3:020d}.json", "")  # a writer that was lost before it named its folder
    assert log.version() == 3 and {r.attempt_id for r in log.state(["attempt_id"]).collect()} == {1}
    assert log.compact(["attempt_id"]) and log.version() == 4
    assert log.rows().count() == 1 and {r.attempt_id for r in log.state(["attempt_id"], until=1).collect()} == {1, 2}
    assert log.commit(spark.createDataFrame([(2, "Running", t(9), None, None)], ATTEMPT), 5)
    assert {r.attempt_id: r.status for r in log.state(["attempt_id"]).collect()} == {1: "Created", 2: "Running"}


# ---- guarded changes ----


def test_run_starts_and_ends(spark):
    runs = [("a", "s", "Failed", t(0)), ("b", "s", "Running", t(0)), ("c", "s", "Completed", t(0)), ("d", "s", "Running", t(0))]
    current = spark.createDataFrame(runs, "index_id string, snapshot_id string, status string, started_at timestamp_ntz")
    ask = [("1", "a", "x", t(1)), ("2", "b", "x", t(60)), ("3", "d", "x", t(61)), ("4", "c", "x", t(999)), ("5", "e", "x", t(2)), ("6", "e", "y", t(1)), ("7", "a", "y", t(1))]
    decided = state.start_runs(current, spark.createDataFrame(ask, "request_id string, index_id string, snapshot_id string, moment timestamp_ntz"))
    assert {r.request_id: r.outcome for r in decided.collect()} == {"1": "Restarted", "2": "Running", "3": "Restarted", "4": "Completed", "5": "Lost", "6": "Started", "7": "Lost"}
    assert {(r.index_id, r.snapshot_id, r.status, r.started_at) for r in state.started(decided).collect()} == {("a", "x", "Running", t(1)), ("d", "x", "Running", t(61)), ("e", "y", "Running", t(1))}
    ask = [("1", "a", None, t(1)), ("2", "b", None, t(2)), ("3", "d", "broke", t(3)), ("4", "z", None, t(4))]
    decided = state.end_runs(current, spark.createDataFrame(ask, "request_id string, index_id string, failure string, moment timestamp_ntz"))
    assert {r.request_id: r.outcome for r in decided.collect()} == {"1": "NotRunning", "2": "Completed", "3": "Failed", "4": "Missing"}
    assert {(r.index_id, r.status, r.failure) for r in state.ended(decided).collect()} == {("b", "Completed", None), ("d", "Failed", "broke")}


def test_transitions_equal_one_by_one(spark):
    """Requests decided at once give what a store gives that takes them one by one and compares state and time."""
    rng = random.Random(2)
    statuses = [*lineage.FOLLOWING, "Succeeded", "Failed"]
    rows = {i: [rng.choice(statuses), t(i % 5), None, None] for i in range(60)}
    asks = []
    for i in range(400):
        key = rng.choice([0, *range(70)]) if i % 3 else 0  # a third of the requests want one attempt
        s, at, _, _ = rows.get(key, ("Created", t(0), None, None))
        asks.append((i, key, s if rng.random() < 0.8 else rng.choice(statuses), at if rng.random() < 0.8 else t(99), rng.choice(statuses), t(100 + rng.randint(0, 300))))
    want, now = {}, {k: list(v) for k, v in rows.items()}
    for i, key, s, at, next_, moment in sorted(asks, key=lambda a: (a[5], a[0])):
        fits = key in rows and (rows[key][0], next_) in lineage.LEGAL and rows[key][0] == s and rows[key][1] == at
        if fits and now[key] == rows[key]:
            now[key], want[i] = [next_, moment, moment if next_ in ("Succeeded", "Failed", "Canceled", "Abandoned") else None, None], "Moved"
        elif fits:
            want[i] = "Lost"
    decided = state.transition(spark.createDataFrame([(k, *v) for k, v in rows.items()], ATTEMPT), spark.createDataFrame(asks, MOVE))
    got = {r.request_id: r.outcome for r in decided.collect()}
    assert len(got) == 400 and {i: o for i, o in got.items() if o in ("Moved", "Lost")} == want
    assert {r.attempt_id: [r.status, r.changed_at, r.completed_at, r.result_id] for r in state.moved(decided).collect()} == {k: v for k, v in now.items() if v != rows[k]}


def test_deletes_give_the_first_reason(spark):
    rows = [(1, "Failed", t(0), t(1), None), (2, "Running", t(0), None, None), (3, "Failed", t(0), t(1), "x"), (4, "Abandoned", t(0), t(1), None), (5, "Failed", t(0), None, None)]
    ask = [(1, 1, "Failed", t(1)), (2, 1, "Failed", t(1)), (3, 1, "Canceled", t(1)), (4, 1, "Failed", t(2)), (5, 2, "Running", None), (6, 3, "Failed", t(1)), (7, 4, "Abandoned", t(1)), (8, 9, "Failed", t(1)), (9, 5, "Failed", None)]
    asks = spark.createDataFrame([(*a, t(10 + a[0])) for a in ask], "request_id long, attempt_id long, expected_status string, expected_at timestamp_ntz, moment timestamp_ntz")
    decided = state.delete(spark.createDataFrame(rows, ATTEMPT), asks, spark.createDataFrame([(4,), (4,)], "attempt_id long"))
    want = {1: "Deleted", 2: "Lost", 3: "StatusChanged", 4: "TimeChanged", 5: "NotTerminal", 6: "HasResult", 7: "IsSource", 8: "Missing", 9: "Deleted"}
    assert {r.request_id: r.outcome for r in decided.collect()} == want and {r.attempt_id for r in state.deleted(decided).collect()} == {1, 5}


def test_certification_keeps_the_first_time(spark):
    schema = "input_id string, build_id string, manifest_digest string, {} timestamp_ntz"
    inputs = spark.createDataFrame([("a", "b", "d", None), ("c", "b", "d", t(1)), ("e", "b", "d", None)], schema.format("verified_at"))
    marks = spark.createDataFrame([("a", "b", "d", t(5)), ("a", "b", "d", t(4)), ("c", "b", "d", t(0)), ("e", "x", "d", t(3))], schema.format("moment"))
    assert {r.input_id: r.verified_at for r in state.certify(inputs, marks).collect()} == {"a": t(4), "c": t(1), "e": None}


# ---- preferences and authority ----


def brute_preferences(events, owner):
    now, out = {}, {}
    for e, build, action, x, _, _ in sorted(events, key=lambda r: (r[5], r[0])):
        before = now.get(build)
        if action == "Set":
            outcome = "UnknownExtraction" if x not in owner else "Set" if owner[x] == build else "OtherBuild"
            if outcome == "Set":
                now[build] = x
        else:
            outcome = "Cleared" if before == x else "NotPreferred"
            if outcome == "Cleared":
                del now[build]
        counts = outcome in ("Set", "Cleared")
        out[e] = (outcome, before if counts else None, x if outcome == "Set" else None)
    return out, now


EVENT = "event_id long, build_id string, action string, extraction_id string, reason string, moment timestamp_ntz"


def test_preferences_equal_one_by_one(spark):
    rng = random.Random(4)
    owner = {f"x{i}": f"b{i % 4}" for i in range(12)}
    events = []
    for i in range(600):
        build = "b0" if i % 3 == 0 else f"b{rng.randint(0, 5)}"
        x = rng.choice([k for k, b in owner.items() if b == build] or ["none"]) if rng.random() < 0.85 else rng.choice([*owner, "none"])
        events.append((i, build, rng.choice(["Set", "Clear", "Clear"]), x, "r", t(rng.randint(0, 40) * 300)))  # ties, and several days
    frame = spark.createDataFrame(events, EVENT)
    audited = preference.audit(frame, spark.createDataFrame([(x, b) for x, b in owner.items()], "extraction_id string, build_id string"))
    want, now = brute_preferences(events, owner)
    rows = audited.collect()
    assert {r.event_id: (r.outcome, r.previous, r.current) for r in rows} == want and len(rows) == 600
    assert {r.build_id: r.extraction_id for r in preference.current(audited).collect()} == now
    asks = [(i, rng.choice([None, "b0", "b1", "b9"]), t(rng.randint(-5, 45) * 299)) for i in range(200)]
    got = {r.request_id: r.preferred for r in preference.preferred_at(spark.createDataFrame(asks, "request_id long, build_id string, moment timestamp_ntz"), audited).collect()}
    assert got == {i: brute_preferences([e for e in events if e[5] <= at], owner)[1].get(b) for i, b, at in asks}


def test_values_at_times_over_empty_tables(spark):
    ask = spark.createDataFrame([(1, "a", t(0)), (2, None, t(0))], "request_id long, k string, moment timestamp_ntz")
    facts = spark.createDataFrame([], "fact_id long, k string, moment timestamp_ntz, v string")
    assert {(r.request_id, r.held) for r in at_times(ask, facts, "k", F.col("v"), "day", "held").collect()} == {(1, None), (2, None)}
    assert at_times(ask.limit(0), facts, "k", F.col("v"), "day", "held").collect() == []


def test_seven_outcomes_of_authority(spark):
    builds = spark.createDataFrame([(b,) for b in "abcdefg"], "build_id string")
    seen = spark.createDataFrame([(1, "a", t(10)), (2, "b", t(10)), (3, "c", t(2000))], "fact_id long, build_id string, moment timestamp_ntz")
    extractions = spark.createDataFrame([("xa", "a", True), ("xb", "b", False), ("xc", "c", True), ("xd", "d", True), ("xe", "e", True), ("xf", "z", True)], "extraction_id string, build_id string, verified boolean")
    run = lambda i, x, b, s="Completed", c="installed", at=0: (i, f"s{i}", "game", c, x, b, s, t(at))
    runs = [run("1", "xa", "a"), run("2", "xa", None, at=1), run("3", "xa", "a", s="Running", at=9), run("4", "xc", "c", s="Failed"), run("5", "xc", "c", c="upstream"), run("6", "xd", "other"), run("7", "xe", None, at=1), run("8", "xe", "e", at=1)]
    runs = spark.createDataFrame(runs, "index_id string, snapshot_id string, codebase string, channel string, source_identity string, build_id string, status string, completed_at timestamp_ntz")
    log = [(i, b, "Set", x, "r", t(5)) for i, (b, x) in enumerate([("a", "xa"), ("b", "xb"), ("c", "xc"), ("d", "xd"), ("e", "xe")])] + [(10, "e", "Clear", "xe", "r", t(50))]
    audited = preference.audit(spark.createDataFrame(log, EVENT), extractions)
    asks = [(1, None, t(9)), (2, " ", t(10)), (3, "nope", t(99)), (4, "f", t(99)), (5, "b", t(99)), (6, "c", t(99)), (7, "d", t(99)), (8, "a", t(99)), (9, "e", t(49)), (10, "e", t(50)), (11, "", t(3000)), (12, "a", t(4))]
    got = authority.at_request(spark.createDataFrame(asks, "request_id long, build_id string, moment timestamp_ntz"), seen, builds, audited, extractions, runs)
    want = {
        1: (None, "NoCurrentBuild", None), 2: ("b", "ExtractionIntegrityFailure", None), 3: ("nope", "BuildNotFound", None), 4: ("f", "NoPreferredVerifiedExtraction", None), 5: ("b", "ExtractionIntegrityFailure", None),
        6: ("c", "NoCompletedIndex", None), 7: ("d", "IndexBuildMismatch", None), 8: ("a", "Resolved", "2"), 9: ("e", "Resolved", "8"), 10: ("e", "NoPreferredVerifiedExtraction", None), 11: ("c", "NoCompletedIndex", None),
        12: ("a", "NoPreferredVerifiedExtraction", None),
    }
    assert {r.request_id: (r.build_id, r.status, r.index_id) for r in got.collect()} == want
    foreign = authority.resolved(spark.createDataFrame([("a", True, True, "xf")], "build_id string, build_known boolean, is_explicit boolean, preferred string"), extractions, runs)
    assert [r.status for r in foreign.collect()] == ["IndexBuildMismatch"]


def test_scenes_must_rest_on_the_same_triple(spark):
    scenes = [("a", "s1", "xa", "1", "Completed", t(1), t(1)), ("a", "s2", "xa", "2", "Completed", t(2), None), ("b", "s3", "xb", "9", "Completed", t(1), t(1)), ("d", "s4", "xd", "4", "Failed", t(1), t(1))]
    scenes = spark.createDataFrame(scenes, "build_id string, scene_snapshot_id string, extraction_id string, code_index_id string, status string, completed_at timestamp_ntz, published_at timestamp_ntz")
    now = spark.createDataFrame([("a", "Resolved", "xa", "1"), ("b", "Resolved", "xb", "2"), ("c", "NoCompletedIndex", None, None), ("d", "Resolved", "xd", "4")], "build_id string, status string, extraction_id string, index_id string")
    assert {r.build_id: r.outcome for r in authority.scene_authority(scenes, now).collect()} == {"a": "Match", "b": "SceneAuthorityMismatch", "c": "NoCompletedIndex", "d": "NoPublishedScene"}


def test_adjacent_builds_over_empty_months(spark):
    builds = spark.createDataFrame([("a", t(0)), ("b", t(0)), ("c", t(60 * 24 * 100)), ("d", t(60 * 24 * 101))], "build_id string, first_seen timestamp_ntz")
    assert {(r.build_id, r.next_build_id) for r in lineage.adjacent(builds).collect()} == {("a", "b"), ("b", "c"), ("c", "d")}


# ---- write-sets and unpublished attempts ----


def tables(spark, bad_child=False):
    f = spark.createDataFrame
    return {
        "containers": f([("c", "s")], "container_id string, scene_snapshot_id string"), "documents": f([("d", "c", "s")], "scene_id string, container_id string, scene_snapshot_id string"),
        "objects": f([("g", "d", "c"), ("h", "d", "c")], "game_object_id string, scene_id string, container_id string"), "transforms": f([("g", None), ("h", "g")], "game_object_id string, parent_id string"),
        "components": f([("k", "nowhere" if bad_child else "g", "c", "type")], "component_id string, game_object_id string, container_id string, resolved_symbol_id string"),
        "references": f([("r", "s", "c", "k", None, "h", None, None)], "reference_id string, scene_snapshot_id string, source_container_id string, source_component_id string, target_container_id string, target_object_id string, target_component_id string, target_symbol_id string"),
    }


def test_a_bad_child_publishes_nothing(spark, tmp_path):
    types = spark.createDataFrame([("type",)], "symbol_id string")
    store = Store(spark, f"file://{tmp_path}/store")
    check = lambda written: writeset.problems(written, "s", types)
    found = store.publish_checked("s", tables(spark, bad_child=True), check)
    assert [(r.problem, r.table_name, r.row_id) for r in found.collect()] == [("NoOwner:game_object_id", "components", "k")] and store.published() == []
    assert store.publish_checked("s", tables(spark), check) is None and store.published() == ["s"] and store.read("objects").count() == 2
    assert [r.problem for r in store.publish_checked("s", tables(spark), check).collect()] == ["AlreadyPublished"]
    assert {(r.problem, r.table_name) for r in writeset.problems(tables(spark), "t", types.limit(0)).collect()} == {("OtherSnapshot", "containers"), ("OtherSnapshot", "documents"), ("OtherSnapshot", "references"), ("ForeignSymbol", "components")}


def index_tables(spark, bad=False):
    f = spark.createDataFrame
    return {
        "source_files": f([("f", "s")], "source_file_id string, snapshot_id string"), "symbols": f([("t", "s"), ("m", "s")], "symbol_id string, snapshot_id string"), "source_locations": f([("m", "f")], "symbol_id string, source_file_id string"),
        "fingerprints": f([("gone" if bad else "m", "x")], "symbol_id string, fingerprint string"), "relationships": f([("r", "m", "t", "s"), ("q", "m", None, "s")], "relationship_id string, source_symbol_id string, target_symbol_id string, snapshot_id string"),
    }


def test_an_index_is_completed_with_all_its_tables_or_not_at_all(spark, tmp_path):
    store, log = Store(spark, f"file://{tmp_path}/store"), VersionedLog(spark, f"file://{tmp_path}/runs")
    runs = [("i1", "s", "Running", t(0), None, None), ("i2", "other", "Running", t(0), None, None), ("i3", "s", "Completed", t(0), t(1), None), ("i4", "s", "Running", t(0), None, None)]
    assert log.commit(spark.createDataFrame(runs, "index_id string, snapshot_id string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, failure string"), 1)
    status = lambda: {r.index_id: r.status for r in log.state(["index_id"]).collect()}
    found = indexing.complete(store, log, "i1", index_tables(spark, bad=True), t(5))
    assert [(r.problem, r.table_name, r.row_id) for r in found.collect()] == [("NoOwner:symbol_id", "fingerprints", "gone")] and store.published() == [] and status()["i1"] == "Running"
    assert {r.problem for r in indexing.complete(store, log, "i2", index_tables(spark), t(5)).collect()} == {"OtherSnapshot"} and status()["i2"] == "Running"
    assert indexing.complete(store, log, "i1", index_tables(spark), t(6)) is None and store.published() == ["index-i1"] and status()["i1"] == "Completed"
    for i in ("i1", "i3", "i9"):
        assert [r.problem for r in indexing.complete(store, log, i, index_tables(spark), t(7)).collect()] == ["NotRunning"]
    # a writer that was lost after it published: the next one only ends the run
    assert store.publish("index-i4", index_tables(spark))
    assert indexing.complete(store, log, "i4", index_tables(spark), t(8)) is None and status() == {"i1": "Completed", "i2": "Running", "i3": "Completed", "i4": "Completed"}


def test_building_again_gives_the_same(spark):
    types = spark.createDataFrame([("N.A", "N.B", ["I"], [("N.A::M", "Method", None, ["N.B"], "System.Void", [("Calls", "N.A::M")])]), ("N.B", "System.Object", [], [])],
                                  "full_name string, base_type string, interfaces array<string>, members array<struct<name:string,kind:string,value_type:string,parameter_types:array<string>,return_type:string,references:array<struct<kind:string,target:string>>>>")
    evidence = spark.createDataFrame([("g:i:Method:N.A::M", "x"), ("g:i:Method:gone", "y")], "canonical_key string, line string")
    one, two = (indexing.build(types, evidence, "s", "g:i") for _ in range(2))
    assert {n: sorted(map(str, rows.collect())) for n, rows in one.items()} == {n: sorted(map(str, rows.collect())) for n, rows in two.items()}
    empty = {"source_files": spark.createDataFrame([], "source_file_id string, snapshot_id string"), "source_locations": spark.createDataFrame([], "symbol_id string, source_file_id string")}
    assert indexing.problems(one | empty, "s").collect() == [] and one["symbols"].count() == 3
    kinds = {r.symbol_id: r.kind for r in one["symbols"].collect()}
    edges = {(r.relationship_kind, r.target_text, r.target_symbol_id is not None) for r in one["relationships"].collect()}
    assert edges == {("Inherits", "N.B", True), ("ImplementsInterface", "I", False), ("ParameterType", "N.B", True), ("Calls", "N.A::M", True)} and sorted(kinds.values()) == ["Method", "Type", "Type"]
    assert one["fingerprints"].where("fingerprint_kind = 'method-body'").count() == 1


def test_sweep_leaves_what_is_published_or_may_be_written(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(1,)], "v int")
    assert store.unpublished() == []
    store.publish("a", {"t": rows})
    left = {store.stage("a", {"t": rows}), store.stage("b", {"t": rows})}
    assert set(store.unpublished()) == left and store.sweep(int(time.time() * 1000) - 3_600_000) == []
    assert set(store.sweep(int(time.time() * 1000) + 60_000)) == left and store.unpublished() == [] and store.read("t").count() == 1


def test_same_build_of_seven_tables(spark):
    f = spark.createDataFrame
    scene = lambda i, **k: {"scene_snapshot_id": i, "build_id": "b", "extraction_id": "x", "input_id": "in", "code_snapshot_id": "c", "code_index_id": "i"} | k
    scenes = [scene("ok"), scene("1", extraction_id="y"), scene("2", input_id="in2"), scene("3", code_index_id="i2"), scene("4", code_index_id="gone"), scene("5", input_id="in3"), scene("6", code_index_id="i3"), scene("7", code_snapshot_id="c2")]
    got = writeset.same_build(
        f(scenes), f([("x", "b"), ("y", "o")], "extraction_id string, build_id string"), f([("x", "in"), ("y", "in")], "extraction_id string, input_id string"),
        f([("in", "b", True), ("in2", "b", False), ("in3", "b", True)], "input_id string, build_id string, replay_verified boolean"), f([("c", "game", "installed", "e"), ("c2", "game", "beta", "e")], "snapshot_id string, codebase string, channel string, environment_id string"),
        f([("e", "b")], "environment_id string, build_id string"), f([("i", "c", "Completed"), ("i2", "c", "Failed"), ("i3", "c9", "Completed")], "index_id string, snapshot_id string, status string"),
    )
    assert {r.scene_snapshot_id: r.problem for r in got.collect()} == {"ok": None, "1": "ExtractionBuild", "2": "NotReplayed", "3": "IndexNotCompleted", "4": "Missing", "5": "OtherInput", "6": "OtherIndex", "7": "OtherCode"}


# ---- integrity over files ----


@pytest.fixture
def stored(spark, tmp_path):
    root = tmp_path / "store"
    for x in ("ok", "altered", "missing", "extra", "longer"):
        os.makedirs(root / x / "sub dir")
        for name in ("a.txt", "sub dir/b.txt"):
            (root / x / name).write_bytes(f"{x} {name}\r\n".encode())
    return root


def test_integrity_of_files(spark, stored):
    read = lambda: integrity.inventory(integrity.read_files(spark, f"file://{stored}"))
    before = spark.createDataFrame(read().collect(), "extraction_id string, path string, size long, sha256 string")
    assert before.count() == 10 and {r.path for r in before.collect()} == {"a.txt", "sub dir/b.txt"}
    records = integrity.summed(before)
    assert {r.reason for r in integrity.verify(records, before, before, read()).collect()} == {"Verified"} and integrity.changed(before, read()).isEmpty()
    (stored / "altered" / "a.txt").write_bytes(b"Altered a.txt\r\n")
    (stored / "missing" / "a.txt").unlink()
    (stored / "extra" / "new.txt").write_bytes(b"")
    (stored / "longer" / "a.txt").write_bytes(b"longer than it was before")
    reasons = {r.extraction_id: r.reason for r in integrity.verify(records, before, before, read()).collect()}
    assert reasons == {"ok": "Verified", "altered": "HashDiffers", "missing": "MissingFile", "extra": "ExtraFile", "longer": "SizeDiffers"}
    assert {(r.extraction_id, r.path, r.change) for r in integrity.changed(before, read()).collect()} == {("altered", "a.txt", "Changed"), ("missing", "a.txt", "Removed"), ("extra", "new.txt", "Added"), ("longer", "a.txt", "Changed")}


def test_the_first_failing_step_gives_the_reason(spark):
    row = lambda x, path="p", size=1, sha="h": (x, path, size, sha)
    f = lambda rows: spark.createDataFrame(rows, "extraction_id string, path string, size long, sha256 string")
    names = ["ok", "unsafe", "digest", "rows", "twice", "stats"]
    manifest = f([row(x, "../p" if x == "unsafe" else "p") for x in names])
    artifacts = f([row(x, size=2 if x == "rows" else 1) for x in names] + [row("twice")])
    records = integrity.summed(manifest).select("extraction_id", F.when(F.col("extraction_id") == "digest", "no").otherwise(F.col("digest")).alias("digest"), "files", (F.col("bytes") + (F.col("extraction_id") == "stats").cast("long")).alias("bytes"))
    records = records.unionByName(spark.createDataFrame([("bare", "d", 0, 0)], records.schema))
    got = {r.extraction_id: r.reason for r in integrity.verify(records, manifest, artifacts, f([row(x) for x in names])).collect()}
    assert got == {"ok": "Verified", "unsafe": "UnsafePath", "digest": "DigestDiffers", "rows": "ManifestRowsDiffer", "twice": "ManifestRowsDiffer", "stats": "StatisticsDiffer", "bare": "NoManifest"}
