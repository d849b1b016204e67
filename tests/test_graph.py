"""Named semantics of the graph operators on small frames, and all catalogue queries against SQL."""

import glob
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from codeloom.functions import canonical, text
from codeloom.operators import checks, graph, lineage, scene, source
from codeloom.plans import catalogue
from codeloom.sources import snapshots

SYM = "symbol_id string, canonical_key string, kind string, qualified_name string, signature string, body_recovery_status string"
EDGE = "relationship_id string, source_symbol_id string, target_symbol_id string, target_text string, relationship_kind string"
DATA = "/root/testdata/sf0.001"


def symbols(spark, *names):
    return spark.createDataFrame([(f"{n}-id", f"g:i:Type:{n}", "Type", n, n, None) for n in names], SYM)


def ranks(spark, query, *names):
    return {r.qualified_name: r["rank"] for r in graph.search(symbols(spark, *names), query).collect()}


def test_ranks_and_literal_wildcards(spark):
    assert ranks(spark, "Foo", "Foo", "A.foo", "FooBar", "xFoox", "bar") == {"Foo": 0, "A.foo": 1, "FooBar": 2, "xFoox": 3}
    assert ranks(spark, "a%", "a%b", "axb") == {"a%b": 2}
    assert ranks(spark, "é", "É") == {}  # only ASCII case folds


def test_resolution(spark):
    s = symbols(spark, "A.X", "B", "b")
    q = spark.createDataFrame([("A.X-id",), ("g:i:Type:A.X",), ("a.x",), ("B",), ("none",), ("x",), ("g:i:Field:A.x",)], "selector string")
    want = {"A.X-id": "Resolved", "g:i:Type:A.X": "Resolved", "a.x": "Resolved", "B": "Ambiguous", "none": "NotFound", "x": "Resolved", "g:i:Field:A.x": "Resolved"}
    assert {r.selector: r.status for r in graph.resolve(s, q, "g:i:").collect()} == want
    # a key of another index is no key of this one
    q = spark.createDataFrame([("g:u:Field:A.x",), ("g:i:Field:",), ("g:i:A.X",)], "selector string")
    assert {r.status for r in graph.resolve(s, q, "g:i:").collect()} == {"NotFound"}


def test_candidates_of_ambiguous_selectors(spark):
    s = symbols(spark, "N.Foo", "M.foo", "Other", "FooBar")
    q = spark.createDataFrame([("foo",), ("other",), ("none",), ("oo",)], "selector string")
    got = {(r.selector, r.place): r.qualified_name for r in graph.candidates(s, q).collect()}
    assert got == {("foo", 1): "M.foo", ("foo", 2): "N.Foo", ("oo", 1): "FooBar", ("oo", 2): "M.foo", ("oo", 3): "N.Foo"}


def test_best_rank_resolves_or_is_ambiguous(spark):
    s = symbols(spark, "N.Foo", "FooBar", "M.FooBaz", "P.Dup", "Q.Dup", "xDup")
    q = spark.createDataFrame([("Foo",), ("dup",), ("oobar",), ("Fo",), ("%",)], "selector string")
    got = {r.selector: (r.status, r.symbol_id) for r in graph.resolve(s, q).collect()}
    assert got == {"Foo": ("Resolved", "N.Foo-id"), "dup": ("Ambiguous", None), "oobar": ("Resolved", "FooBar-id"), "Fo": ("Resolved", "FooBar-id"), "%": ("NotFound", None)}


def test_neighbourhood(spark):
    e = spark.createDataFrame([("1", "a", "b", "b", "Calls"), ("2", "c", "b", "b", "ReadsField"), ("3", "b", None, "text", "Constructs"), ("4", "b", "b", "b", "Calls")], EDGE)
    ids = lambda d: sorted(r.relationship_id for r in graph.edges(e, "b", d).collect())
    assert ids("callers") == ["1", "4"] and ids("callees") == ["3", "4"] and ids("refs") == ["1", "2", "3", "4"]


def two_sides(a, b, prints_a, prints_b, edges_a, edges_b):
    """The diff of two indexes that are given apart."""
    union = lambda x, y: x.withColumn("k", F.lit(0)).unionByName(y.withColumn("k", F.lit(1)))
    side = lambda rows, k, *ids: rows.withColumns({c: F.concat(F.lit(f"{k}/"), c) for c in ids})  # noqa: E731  ids differ between builds
    edges = [side(e, k, "source_symbol_id", "target_symbol_id") for k, e in enumerate((edges_a, edges_b))]
    return graph.diff(union(side(a, 0, "symbol_id"), side(b, 1, "symbol_id")), union(side(prints_a, 0, "symbol_id"), side(prints_b, 1, "symbol_id")), union(*edges), 0, 1)


def body(spark, rows):
    return spark.createDataFrame(rows, "symbol_id string, fingerprint_kind string, fingerprint string")


@pytest.mark.parametrize(("status_b", "expected"), [("Recovered", "MethodBodyChanged"), ("StubOrUnavailable", "Unchanged"), (None, "Unchanged")])
def test_one_sided_body(spark, status_b, expected):
    a = symbols(spark, "m").withColumn("kind", F.lit("Method"))
    b = a.withColumn("body_recovery_status", F.lit(status_b).cast("string"))
    none = spark.createDataFrame([], EDGE)
    found = two_sides(a, b, body(spark, [("m-id", "method-body", "x")]), body(spark, []), none, none)
    assert [r.classification for r in found.collect()] == [expected]


def test_diff_with_itself_and_swapped(spark):
    a, b, none, prints = symbols(spark, "x", "y"), symbols(spark, "y", "z"), spark.createDataFrame([], EDGE), body(spark, [])
    assert {r.classification for r in two_sides(a, a, prints, prints, none, none).collect()} == {"Unchanged"}
    kinds = lambda p, q: {r.name: r.classification for r in two_sides(p, q, prints, prints, none, none).collect()}
    assert kinds(a, b) == {"x": "Removed", "y": "Unchanged", "z": "Added"} and kinds(b, a) == {"x": "Added", "y": "Unchanged", "z": "Removed"}


def test_cycles_are_found(spark):
    o = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x")], "game_object_id string, parent_id string")
    got = {r.game_object_id: (r.root_id, r.depth, r.in_cycle) for r in scene.roots(o).collect()}
    assert got["c"] == ("a", 2, False) and all(got[i] == (None, None, True) for i in "xyz")


ARTIFACT = "candidate_id long, relative_path string, assembly_name string, invalid boolean, size long, sha256 string, type_count long, method_count long"


def test_thresholds_are_strict(spark):
    rows = lambda size, name="A", types=4: spark.createDataFrame([(1, "p", name, False, size, "h", types, None)], ARTIFACT)
    found = lambda a, b: {(r.metric, r.assembly): (r.classification, r.severity) for r in checks.comparative(a, b).collect()}
    grade = lambda a, b: found(rows(a), rows(b))["TotalManagedBytes", None]
    fine, warning, error = ("WithinTolerance", None), ("ComparativeSanityDeviation", "Warning"), ("CatastrophicSanityDeviation", "Error")
    assert grade(100, 125) == fine and grade(100, 126) == warning and grade(100, 20) == warning and grade(100, 19) == error and grade(100, 1000) == warning
    assert grade(0, 5) == ("BaselineZeroChanged", "Warning") and grade(0, 0) == fine
    got = found(rows(1), rows(1, "a", types=4))
    assert len(got) == 6 and set(got.values()) == {fine} and ("MethodDefinitionCount", "a") in got  # names meet without case
    assert found(rows(1), rows(1, "B"))["TypeDefinitionCount", "a"] == error


def test_absolute_issues(spark):
    rows = [(1, "a", "assembly-csharp", False, 2_000_000, "h", 1, 1), (2, "b", "Other", False, 5, "h", 0, None), (2, "c", "other", False, 0, "i", 0, 0), (3, "d", None, True, 5, "h", None, None), (5, "e", "Assembly-CSharp", False, 2_000_000, "h", 1, 1), (5, "f", "assembly-csharp", False, 1, "h", 1, 1)]
    found = checks.absolute(spark.createDataFrame([(i,) for i in range(1, 6)], "candidate_id long"), spark.createDataFrame(rows, ARTIFACT))
    got = {i: sorted((r.code, r.detail, r.severity) for r in found.collect() if r.candidate_id == i) for i in range(1, 6)}
    e = lambda code, detail=None: (code, detail, "Error")
    assert got[1] == [] and got[4] == [e("NoArtifactsProduced"), e("RequiredAssemblyMissing", "Assembly-CSharp")] and got[5] == [("DuplicateAssemblyIdentity", "assembly-csharp", "Information")]
    assert got[3] == [e("InvalidManagedAssembly", "d"), e("NoManagedAssembliesProduced"), e("RequiredAssemblyMissing", "Assembly-CSharp")]
    assert got[2] == [e("DuplicateAssemblyIdentity", "other"), e("EmptyArtifact", "c"), e("InsufficientManagedBytes"), e("InsufficientMethodDefinitionCount"), e("InsufficientTypeDefinitionCount"), e("RequiredAssemblyMissing", "Assembly-CSharp")]


def test_snippets(spark):
    d = spark.createDataFrame([("a\r\nb\rc\nd",)], "text string")
    cut = lambda s, e, c: d.select(source.snippet(F.col("text"), F.lit(s), F.lit(e), c)).first()[0]
    assert cut(2, 2, 0) == "b" and cut(1, 2, 5) == "a\nb\nc\nd" and cut(4, 5, 0) is None


TYPES = {
    "int": "System.Int32", "System.Int32": "System.Int32", "ref int?[]*": "System.Nullable`1<System.Int32>[]*&", "System.Nullable<System.Int32>": "System.Nullable`1<System.Int32>", "int?": "System.Nullable`1<System.Int32>",
    "(int, string)": "System.ValueTuple<System.Int32,System.String>", "string?": "System.String?", "Foo?": "Foo?", "Outer/Inner": "Outer+Inner", "List`7<int>": "List`7<System.Int32>", "global::Foo.Bar": "Foo.Bar", "out\tbool": "System.Boolean&",
    "Dictionary<string, List<(int, A/B)>>[]": "Dictionary`2<System.String,List`1<System.ValueTuple<System.Int32,A+B>>>[]", "int[][,]": "System.Int32[,][]", "void**": "System.Void**", "DateTime?": "DateTime?", "System.DateTime?": "System.Nullable`1<System.DateTime>",
    "ref readonly int": "readonlyint&", "refx": "refx", "in T": "T&", " nint ": "System.IntPtr", "": None, " ": None, None: None, "Func<int,Task<string?>>?": "Func`2<System.Int32,Task`1<System.String?>>?",
}


def test_canonical_types(spark):
    rows = spark.createDataFrame([*((t,) for t in TYPES), ("<" * 5000 + ">" * 5000,)], "t string")
    got = {r.t: r.c for r in rows.select("t", canonical.canonical_type("t").alias("c")).collect()}
    assert {k: got[k] for k in TYPES} == TYPES


def test_method_signatures_and_members(spark):
    rows = [("Demo.Widget", "Run", ["ref int", "Foo?"], "void", 1), ("Demo/Widget", "Run", [], "int[]", 0), ("A", "B", None, "A", 0), ("A", "B", ["int"], None, 0)]
    d = spark.createDataFrame(rows, "o string, n string, p array<string>, r string, a int").withColumn("k", F.lit("Method")).withColumn("s", F.lit("text"))
    c = lambda *names: [F.col(n) for n in names]
    assert [r[0] for r in d.select(canonical.method_signature(*c("o", "n", "p", "r", "a"))).collect()] == ["Demo.Widget::Run`1(System.Int32&,Foo?):System.Void", "Demo+Widget::Run():System.Int32[]", "A::B():A", None]
    assert [r[0] for r in d.select(canonical.member_identity(*c("o", "k", "n", "s", "p", "r", "a"))).collect()][2:] == ["A::B():A", "A::text"]


def test_slugs(spark):
    keys = ["ScheduleOne.Employees.Employee.Fire(System.Int32)", "Employee", "employee", "CON", "lpt9", "com0", "É-_ü", "", "a" * 79 + "--b", "日本"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(canonical.slug(F.col("k"))).collect()]
    stems = ["scheduleone-employees-employee-fire-system-int32", "employee", "employee", "x-con", "x-lpt9", "com0", "e-u", "x-", "a" * 79, "x-"]
    assert [g[:-13] for g in got] == stems and all(g[-12:] == hashlib.sha256(k.encode()).hexdigest()[:12] for g, k in zip(got, keys, strict=True)) and got[1] != got[2]


def test_length_prefixed_hash_separates_fields(spark):
    d = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc")], "x string, y string")
    assert d.select(canonical.prefixed_hash("id", 1, F.col("x"), F.col("y")).alias("h")).distinct().count() == 4
    want = hashlib.sha256(b"".join(bytes([1]) + len(v).to_bytes(4, "little") + v for v in (b"id", b"1", "é".encode())) + b"\0").hexdigest()
    assert d.select(canonical.prefixed_hash("id", 1, F.lit("é"), F.lit(None).cast("string")).alias("h")).first().h == want


def test_safe_paths(spark):
    d = spark.createDataFrame([("a/b",), ("/a",), ("a/../b",), ("C:/x",), ("a//b",), (".",)], "p string")
    assert [r[0] for r in d.select(text.path_is_safe(F.col("p"))).collect()] == [True, False, False, False, False, False]


def test_publish_and_read(spark, tmp_path):
    t = spark.createDataFrame([("s1", 1), ("s1", 2)], "snapshot_id string, v int")
    store = snapshots.Store(spark, f"file://{tmp_path}/store")
    assert store.publish("s1", {"t": t}) and not store.publish("s1", {"t": t.limit(1)})
    store.stage("s2", {"t": t.withColumn("snapshot_id", F.lit("s2"))})
    assert store.read("t").count() == 2 and store.published() == ["s1"]


def test_violations(spark):
    steps = ["Created", "Preparing", "Running", "ProcessCompleted", "Validating", "Succeeded", "Failed"]
    d = spark.createDataFrame([(i, 1, s, i) for i, s in enumerate(steps)] + [(20, 2, "Running", 1), (21, 2, "Succeeded", 2)], "attempt_id long, user_id long, status string, changed_at int")
    assert sorted((r.before, r.status) for r in lineage.violations(d).collect()) == [("Running", "Succeeded"), ("Succeeded", "Failed")]


def test_cleanup_keeps_what_has_no_completion(spark):
    d = spark.createDataFrame([(1, "Failed", None, None), (2, "Failed", 5, None), (3, "Failed", 10, None), (4, "Abandoned", 5, "e"), (5, "Succeeded", 5, "e"), (6, "Running", None, None)], "attempt_id long, status string, completed_at int, result_id string")
    got = {r.attempt_id: r.reason for r in lineage.cleanup_plan(d, F.lit(10)).collect()}
    assert got == {1: "NotCompleted", 2: "Eligible", 3: "TooRecent", 4: "HasResult", 5: "NotCleanable", 6: "NotCleanable"}


def test_body_recovery_rules(spark):
    rows = [(True, False, False, 0, 5, 1), (True, False, False, 9, 0, 1), (True, False, False, 1, 1, 1), (True, False, False, 3, 3, 0), (True, False, False, 2, 9, 0), (False, True, False, 0, 0, 0), (True, False, True, 9, 9, 9)]
    d = spark.createDataFrame(rows, "b boolean, d boolean, s boolean, il int, i int, r int")
    got = [r[0] for r in d.select(text.body_recovery(*(F.col(c) for c in ("b", "d", "s", "il", "i", "r")))).collect()]
    assert got == ["StubOrUnavailable", "StubOrUnavailable", "Recovered", "Recovered", "Unknown", "NoBodyByDesign", "StubOrUnavailable"]


def test_edges_compare_by_key_and_bodies_of_callables_only(spark):
    a = symbols(spark, "x", "t")
    b = a.withColumn("symbol_id", F.concat(F.lit("2"), "symbol_id"))
    edge = lambda p, text: spark.createDataFrame([("1", f"{p}x-id", f"{p}t-id", text, "Calls"), ("2", f"{p}x-id", None, None, "Calls")], EDGE)
    prints = body(spark, [("x-id", "method-body", "1")]), body(spark, [("2x-id", "method-body", "2")])
    assert {r.classification for r in two_sides(a, b, *prints, edge("", "old name"), edge("2", "new name")).collect()} == {"Unchanged"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_catalogue(spark, duck, name):
    found = catalogue.queries()[name](spark, DATA)
    cols = sorted(found.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in found.collect())
    out = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in cols)) for r in out.fetchall())
