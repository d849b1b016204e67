"""Declarations with spans, and concepts, from hand-made sources."""

import hashlib
import time

import pytest

from codeloom.functions.concepts import LABELS, concepts, shown
from codeloom.functions.scanner import declarations, declared
from codeloom.operators import source

SOURCE = """using System;
namespace A.B
{
    // class Fake { }
    [Attr("}")]
    public sealed class C<T> : Base where T : class, new()
    {
        private readonly List<int> _a = new() { 1, 2 }, _b;
        public const string S = "}{ class X {";
        public int P { get; set; } = 5;
        public int Q => _a.Count;
        public event Action E { add { } remove { } }
        public event Action F;
        static C() { }
        public C(int a, ref string b = null, params object[] c) : base(a) { if (a > 0) { } }
        public Dictionary<string, List<int?>> M<U, V>(in U u, (int, string) t) where U : V { /* } */ var s = @"a""}"; return null; }
        void IFoo.Bar() => Console.WriteLine('}');
        public abstract void N();
        public int this[int i] { get { return 1; } }
        public static C operator +(C a, C b) { return a; }
        ~C() { }
        delegate void D(int x);
        enum G { A, B }
        struct Inner { int x, y; }
        int[] arr = { 1, 2 };
        Func<int, int> f = x => { return x; };
    }
    record R(int X);
    interface I { void Z(int a); int W { get; } }
}
"""
MEMBERS = {
    ("Type", "A.B.C"): (5, 5, 27, 6), ("Type", "A.B.C.Inner"): (24, 9, 24, 35), ("Type", "A.B.R"): (28, 5, 28, 21), ("Type", "A.B.I"): (29, 5, 29, 50),
    ("Field", "A.B.C::List`1<System.Int32> _a"): (8, 9, 8, 60), ("Field", "A.B.C::List`1<System.Int32> _b"): (8, 9, 8, 60), ("Field", "A.B.C::System.String S"): (9, 9, 9, 48), ("Field", "A.B.C::System.Int32[] arr"): (25, 9, 25, 30),
    ("Field", "A.B.C::Func`2<System.Int32,System.Int32> f"): (26, 9, 26, 47), ("Field", "A.B.C.Inner::System.Int32 x"): (24, 24, 24, 33), ("Field", "A.B.C.Inner::System.Int32 y"): (24, 24, 24, 33),
    ("Property", "A.B.C::System.Int32 P"): (10, 9, 10, 40), ("Property", "A.B.C::System.Int32 Q"): (11, 9, 11, 34), ("Property", "A.B.I::System.Int32 W"): (29, 34, 29, 48), ("Event", "A.B.C::Action E"): (12, 9, 12, 53),
    ("Constructor", "A.B.C::.ctor():System.Void"): (14, 9, 14, 23), ("Constructor", "A.B.C::.ctor(System.Int32,System.String&,System.Object[]):System.Void"): (15, 9, 15, 93),
    ("Method", "A.B.C::M`2(U&,System.ValueTuple<System.Int32,System.String>):Dictionary`2<System.String,List`1<System.Nullable`1<System.Int32>>>"): (16, 9, 16, 133), ("Method", "A.B.C::Bar():System.Void"): (17, 9, 17, 51),
    ("Method", "A.B.C::N():System.Void"): (18, 9, 18, 34), ("Method", "A.B.I::Z(System.Int32):System.Void"): (29, 19, 29, 33),
}


def test_declarations_and_spans():
    found = declarations(SOURCE)
    assert {r[:2]: r[3:] for r in found} == MEMBERS and len(found) == len(MEMBERS)
    assert [(r[2], r[0]) for r in found] == sorted((r[2], r[0]) for r in found)
    for kind, name, _, line, column, end, after in found:  # a span begins with its first token and ends with its last
        lines = SOURCE.split("\n")[line - 1 : end]
        lines[-1] = lines[-1][: after - 1]
        assert not lines[0][column - 1].isspace() and lines[-1][-1] in "};", (kind, name)


def test_open_ends_and_made_up_names():
    spans = lambda text: {r[1]: r[3:] for r in declarations(text)}
    assert spans('class A { string s = "abc\n int x; }') == {"A": (1, 1, 2, 10), "A::System.String s": (1, 11, 2, 8)}
    assert spans("class A { void M() { /* open ") == {"A": (1, 1, 1, 21), "A::M():System.Void": (1, 11, 1, 21)}
    assert spans("namespace X; class A { int b; void <M>b__0() { } }") == {"X.A": (1, 14, 1, 51), "X.A::System.Int32 b": (1, 24, 1, 30), "X.A::_M_b__0():System.Void": (1, 31, 1, 49)}
    for odd in ("", None, "}}}}", "class", "class {", "int x;", "{{{", "class A : B", '"', "/*", "'"):
        assert declarations(odd) == []


def test_scanning_takes_linear_time():  # but for types within types, whose full names are the output
    for unit in ("class A { int x; } ", "{", "(", "int x = (", '"', "/* ", "a<", "} ", '@"', "[a", "x => {"):
        times = []
        for n in (4_000, 16_000):
            began = time.process_time()
            declarations(unit * n)
            times.append(time.process_time() - began)
        assert times[1] < 12 * times[0] + 2, unit


def test_files_of_a_table(spark):
    files = spark.createDataFrame([("a.cs", SOURCE), ("b.cs", None), ("c.cs", ""), ("a.cs", SOURCE)], "path string, text string").selectExpr("*", "1 AS kind")
    rows = declared(files).collect()
    assert len(rows) == 2 * len(MEMBERS) and {((r.kind, r.qualified_name), (r.start_line, r.start_column, r.end_line, r.end_column)) for r in rows} == set(MEMBERS.items())
    assert [r.concept for r in shown(files.limit(1)).orderBy("place").collect()] == concepts(SOURCE) and declared(files.limit(0)).collect() == []


def test_checked_source_of_symbols(spark):
    text = "a\r\nb\nc\nd\ne"
    sha = hashlib.sha256(text.encode()).hexdigest()
    symbols = spark.createDataFrame([(c, "Method" if c == "a" else "Type", None) for c in "abcdefgh"], "symbol_id string, kind string, body_recovery_status string")
    places = [("a", "1", 2, 3), ("b", "1", 5, 6), ("c", "1", 1, 1), ("c", "1", 2, 2), ("d", "9", 1, 1), ("e", "2", 1, 1), ("f", "3", 1, 1), ("g", "4", 1, 1)]
    locations = spark.createDataFrame(places, "symbol_id string, source_file_id string, start_line int, end_line int")
    records = spark.createDataFrame([("1", "x.cs", sha.upper(), 9), ("2", "../x.cs", sha, 9), ("3", "gone.cs", sha, 9), ("4", "y.cs", sha, 9)], "source_file_id string, relative_path string, sha256 string, byte_count long")
    files = spark.createDataFrame([("x.cs", text), ("y.cs", text + " "), ("../x.cs", text)], "relative_path string, text string")
    rows = {r.symbol_id: r for r in source.selected(symbols, locations, records, files, 1, "g:i:generated").collect()}
    assert {k: r.state for k, r in rows.items()} == {"a": "Available", "b": "SpanOutside", "c": "SeveralLocations", "d": "NoFileRecord", "e": "UnsafePath", "f": "FileMissing", "g": "HashMismatch", "h": "NoIndexedLocation"}
    assert (rows["a"].snippet, rows["a"].context_before, rows["a"].context_after, rows["a"].body_status, rows["a"].provenance, rows["a"].byte_count) == ("a\nb\nc\nd", 1, 1, "Unknown", "g:i:generated", 9)
    assert rows["g"].snippet is None and rows["g"].relative_path is None


YES = {
    "generic": ["public void M<T>(T value) { }", "List<int> x;", "new Dictionary<string, List<int>>();", "f(A<B>.C);"], "conditional": ["var r = value?.ToString();", "a?[0];"], "coalesce": ['x ?? "none";'],
    "query": ["var v = from item in items select item;", "from int x in xs select x;"], "creation": ["new Foo();", "new A.B<int> { X = 1 };"], "invocation": ["Foo();", "a.B(1);", "Make<int>(2);", "return F(1);", "x = this.M();", "f()();", "nameof(x);"],
    "lambda": ["f(x => x);", "var g = (a, b) => a;", "x = async () => { };"], "property": ["class C { int P { get; } }", "class C { int Q => 1; }", "class C { List<int> R { private get; set; } }"], "event": ["class C { event Action E { add { } remove { } } }"],
    "constructor": ["class C { public C() { } }", "class C { C(int a) : base(a) { } }"], "static": ["class C { static int x; }", "class C { public static void M() { } }"],
}
NO = {
    "generic": ["if (a < b && c > d) { }", "for (i = 0; i < n; i++) x = y > z;", "// List<int>", '"List<int>"'], "conditional": ["a ? .5 : 1;", "int?[] x;", "a ? b : c;"], "coalesce": ["x ??= 1;", '"a ?? b"'],
    "query": ["Enumerable.Select(items, item => item);", "x.from(a);"], "creation": ["new[] { 1 };", "new int[3];", "new { X = 1 };", "new();"], "invocation": ["if (a) { }", "void M(int a) { }", "new Foo();", "class C { C() { } }", "typeof(int);", "[Attr(1)] class C { }"],
    "lambda": ["class C { int Q => 1; void M() => x; }", "x switch { 1 => 2, y => 3 };"], "property": ["void M() { get(); }", "x => 1;", "class C { event Action E { add { } remove { } } }"], "event": ["class C { event Action E; }"],
    "constructor": ["class C { void M() { } }", "Foo();"], "static": ["using static System.Math;", "f(static x => x);", "class C { void M() { static void L() { } } }"],
}


@pytest.mark.parametrize("name", LABELS)
def test_concepts(name):
    for text in YES[name]:
        assert LABELS[name] in concepts(text), text
    for text in NO[name]:
        assert LABELS[name] not in concepts(text), text


def test_concepts_of_odd_texts():
    assert concepts(None) == concepts("") == concepts("words of prose, and no more") == []
    for odd in ("(((", ")))", "<<<", "=>", "new", "{", "from x in", "?.", "static", "event"):
        concepts(odd)
