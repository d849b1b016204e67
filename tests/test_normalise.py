"""Scene normalisation, selectors, channels and policy on small frames."""

import pytest

from codeloom.operators import lookup, normalise, policy
from codeloom.sources.cuts import cut
from codeloom.sources.snapshots import Store

T = "transform_id string, parent_id string, root_order long, file_version int, unity_version string, byte_offset long, byte_count long, container_size long"
L = "parent_id string, place long, child_id string"


def transform(name, parent=None, order=0, version=22, offset=0, count=1):
    return (name, parent, order, version, "2022.3.62f1", offset, count, 100)


def test_reconciliation(spark):
    t = spark.createDataFrame([transform("r", order=4), transform("a", "r"), transform("b", "r"), transform("x", "gone"), transform("old", "r", version=21), transform("out", None, 0, 22, 2**62, 2**62)], T)
    lists = spark.createDataFrame([("r", 0, "a"), ("r", 3, "a"), ("x", 0, None), ("out", 0, "a")], L)
    got = {r.transform_id: (r.sibling_index, r.schema_valid, r.hierarchy_complete) for r in normalise.reconcile(t, lists).collect()}
    assert got == {"r": (4, True, False), "a": (3, True, True), "b": (None, True, False), "x": (None, True, False), "old": (None, False, False), "out": (None, False, False)}


def test_list_violations(spark):
    t = spark.createDataFrame([transform("r"), transform("s"), transform("a", "r"), transform("old", "r", version=21)], T)
    lists = spark.createDataFrame([("r", 0, "a"), ("s", 0, "a"), ("r", 1, "never"), ("r", 2, "old"), ("r", 3, None)], L)
    assert sorted((r.parent_id, r.child_id) for r in normalise.list_violations(t, lists).collect()) == [("r", "never"), ("r", "old"), ("s", "a")]


def test_pointers(spark):
    containers = spark.createDataFrame([("level0",), ("p/one.assets",), ("q/one.assets",), ("p/two.assets",)], "container_path string")
    objects = containers.selectExpr("container_path", "7L AS local_file_id")
    ext = [("level0", 1, "p/one.assets", None), ("level0", 2, "z/one.assets", None), ("level0", 3, "z/two.assets", " "), ("level0", 4, None, None), ("level0", 5, "ARCHIVE:/a/cab/p\\two.assets", None)]
    externals = spark.createDataFrame(ext, "source_path string, file_id long, path_name string, original_path_name string")
    rows = [(1, 0, 7), (2, 0, 0), (3, 0, -1), (4, 0, 8), (5, 1, 7), (6, 2, 7), (7, 3, 7), (8, 4, 7), (9, 5, 7), (10, 6, 7)]
    pointers = spark.createDataFrame([(i, "level0", f, n) for i, f, n in rows], "pointer_id long, source_path string, file_id long, local_file_id long")
    got = {r.pointer_id: (r.status, r.target_path, r.violation) for r in normalise.resolve_pointers(pointers, externals, containers, objects).collect()}
    text = ("UnresolvedText", None, None)
    assert got == {1: ("Resolved", "level0", None), 2: ("Unavailable", None, None), 3: (None, None, "NegativeLocalId"), 4: (None, None, "MissingTarget"), 5: ("Resolved", "p/one.assets", None), 6: text,
                   7: ("Resolved", "p/two.assets", None), 8: text, 9: ("Resolved", "p/two.assets", None), 10: text}


def test_prefabs_and_documents(spark):
    o = spark.createDataFrame([("a", None, "x.assets"), ("b", "a", "x.assets"), ("c", "b", "level1"), ("u", "v", "y.assets"), ("v", "u", "y.assets"), ("w", None, "y.assets")], "game_object_id string, parent_id string, container_path string")
    e = [("e1", 1001, "m_Root", "a"), ("e2", 1001480554, "rootObject", "u"), ("e3", 1001, "m_Root", "a"), ("e3", 1001, "m_Root", "b"), ("e4", 114, "m_Root", "w"), ("e5", 1001, "m_Root", "c"), ("e6", 1001, "other", "w")]
    evidence = spark.createDataFrame(e, "evidence_id string, class_id long, field_path string, target_id string").selectExpr("*", "'PPtr<GameObject>' AS declared_type")
    roots = normalise.prefab_roots(evidence, o)
    assert {r.evidence_id: (r.root_id, r.roots) for r in roots.collect()} == {"e1": ("a", 1), "e2": ("u", 1), "e3": (None, 2), "e5": ("c", 1), "e6": (None, 0)}
    down = normalise.descendants(o, roots, cut)
    assert sorted(map(tuple, down.collect())) == [("e1", "a", 0), ("e1", "b", 1), ("e1", "c", 2), ("e2", "u", 0), ("e2", "v", 1), ("e5", "c", 0)]
    got = {r.game_object_id: (r.kind, r.document, r.claims) for r in normalise.assign_documents(o, roots, down).collect()}
    assert got == {"a": ("Prefab", "e1", 1), "b": ("Prefab", "e1", 1), "c": ("Scene", "level1", 2), "u": ("Prefab", "e2", 1), "v": ("Prefab", "e2", 1), "w": ("AssetGraph", "y.assets", 0)}


def test_selectors(spark):
    rows = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "1"), ("4", "y")], "id string, name string")
    asked = spark.createDataFrame([("1",), ("x",), ("y",), ("z",)], "selector string")
    got = {r.selector: (r.status, r.id) for r in lookup.select_rows(rows, asked, "id", [rows["name"]]).collect()}
    assert got == {"1": ("Resolved", "1"), "x": ("Ambiguous", None), "y": ("Resolved", "4"), "z": ("NotFound", None)}


def test_channels(spark):
    s = spark.createDataFrame([("1", "in", "A.Foo"), ("2", "up", "A.Foo"), ("3", "in", "A.Bar"), ("4", "night", "A.Night")], "symbol_id string, channel string, qualified_name string").selectExpr("*", "qualified_name AS signature", "concat('k:', qualified_name) AS canonical_key")
    runs = lambda *done: spark.createDataFrame([(c, "Completed" if c in done else "Running") for c in ("in", "up", "night")], "channel string, status string")
    asked = spark.createDataFrame([("A.Foo",), ("Bar",), ("A.Night",)], "selector string")
    run = lambda r: {x.selector: (x.status, x.symbol_id) for x in lookup.resolve_channels(s, r, asked, ["in", "up", "night"]).collect()}
    assert run(runs("in", "up")) == {"A.Foo": ("Ambiguous", None), "Bar": ("Resolved", "3"), "A.Night": ("NotFound", None)}
    assert {v[0] for v in run(runs()).values()} == {"NoCompletedIndex"}


def test_outcome_and_preference(spark):
    base = "attempt_id long, containment_passed boolean, input_integrity_passed boolean, process_integrity_passed boolean, trust string, tool_id string, candidate_id string, preferred_id string, preferred_reason string, preferred_tool_id string"
    row = lambda i, c=True, p=True, pid=None, why=None, tool="t": (i, c, True, p, "ManagedPinned", "t", "me", pid, why, tool)
    v = spark.createDataFrame([row(1), row(2, c=False), row(3, p=False), row(4), row(5), row(6, pid="me", tool="u"), row(7, pid="o", why="ManualPromotion", tool="u"), row(8, pid="o", why="ManagedAutomatic", tool="u"), row(9, pid="o", why="ManagedAutomatic")], base)
    issues = spark.createDataFrame([(4, "Warning", True), (5, "Error", False), (5, "Info", False)], "attempt_id long, severity string, preference_blocking boolean")
    out = policy.outcomes(v, issues)
    got = {r.attempt_id: (r.outcome, r.preference_eligible, r.why) for r in out.withColumn("why", policy.preference(out)).collect()}
    assert got == {1: ("Valid", True, "ManagedAutomatic"), 2: ("Invalid", False, None), 3: ("Valid", False, None), 4: ("ValidWithWarnings", False, None), 5: ("Invalid", False, None), 6: ("Valid", True, None), 7: ("Valid", True, None), 8: ("Valid", True, "ReplacementAfterToolUpgrade"), 9: ("Valid", True, None)}


def test_recovery(spark):
    a = spark.createDataFrame([(1, "Running", True, None, 4), (2, "Created", None, None, 4), (3, "Failed", False, False, 4), (4, "Validating", False, False, None)], "attempt_id long, status string, owner_alive boolean, child_alive boolean, files long")
    assert sorted(map(tuple, policy.recover(a, False).collect())) == [(1, "Refused", "Running", 0), (2, "Recovered", "Abandoned", 4), (4, "Recovered", "Abandoned", 0)]
    assert {r.discarded for r in policy.recover(a, True).collect()} == {0}


def test_two_writers_publish_once(spark, tmp_path):
    t = spark.createDataFrame([("s1", 1), ("s1", 2)], "snapshot_id string, v int")
    store = Store(spark, f"file://{tmp_path}/store")
    one, two = store.stage("s1", {"t": t}), store.stage("s1", {"t": t.limit(1)})
    assert store.published() == [] and store.claim("s1", one) and not store.claim("s1", two)
    assert store.read("t", "s1").count() == 2


def test_limits():
    assert lookup.bounded(900) == 500
    with pytest.raises(ValueError):
        lookup.bounded(0)


def test_proofs_of_one_root_descend_once(spark):
    """Eighty proofs of one root with a thousand objects below it: rows of a round are those of the root, not of its proofs."""
    o = spark.createDataFrame([("r", None, "a.assets")] + [(f"o{i}", "r" if i < 10 else f"o{i % 10}", "a.assets") for i in range(1000)], "game_object_id string, parent_id string, container_path string")
    roots = spark.createDataFrame([(f"e{i:02}", "r", 1) for i in range(80)] + [("x", "o3", 1), ("none", None, 0)], "evidence_id string, root_id string, roots long")
    written = []

    def put(rows):
        out = cut(rows)
        written.append(out.count())
        return out

    down = normalise.descendants(o, roots, put)
    assert sum(written) == 1001 + 100 and written[-1] == 0
    rows = {(r.evidence_id, r.game_object_id): r.depth for r in down.collect()}
    assert len(rows) == 80 * 1001 + 100 and rows["e07", "o3"] == 1 and rows["e79", "o13"] == 2 and rows["x", "o13"] == 1
    a, b = (sorted(map(tuple, normalise.assign_documents(o, roots, m).collect())) for m in (down, normalise.reached(o, roots, cut)))
    assert a == b and ("o13", "Prefab", "e00", 81) in a and ("o4", "Prefab", "e00", 80) in a
