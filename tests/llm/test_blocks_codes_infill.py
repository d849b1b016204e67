"""Vector codes, main texts and fill-in-middle: brute force, vectors made by hand, round trips, and odd input."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import codebooks, extract, infill

VEC = "vec_id long, embedding array<float>, label int"


# ---- vector codes ----


def brute_codes(rows, parts, entries, rounds, scale):
    """Plain Lloyd over all vectors, in Python's integers."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda q, p: tuple(q[p * width : (p + 1) * width])
    first = sorted(kept)[:entries]
    books = [[list(cut(q, p)) for _, q, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min((far(v, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            met = {}
            for _, q, _ in kept:
                met.setdefault(near(p, cut(q, p))[1], []).append(cut(q, p))
            new.append([[sum(c) // len(c) for c in zip(*met[i], strict=True)] if i in met else e for i, e in enumerate(books[p])])
        books[:] = new
    found = [[near(p, cut(q, p)) for p in range(parts)] for _, q, _ in kept]
    codes = [(i, "".join(f"{c:02x}" for _, c in f), sum(d for d, _ in f), lab) for (i, _, lab), f in zip(kept, found, strict=True)]
    sums = {}
    for _, _, e, lab in codes:
        sums[lab] = sums.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, sums[lab]) for i, c, e, lab in codes), sha


@pytest.mark.parametrize("hot_share", [1 / 1024, 0.02, 0.6, 2.0])
def test_codes_equal_brute_force(spark, hot_share):
    rng = random.Random(3)
    value = lambda: rng.choice([0.0, 0.0, rng.uniform(-1, 1), 1e-3, -1e-3, float(rng.randint(-3, 3))])
    rows = [(i, [value() for _ in range(8)], rng.choice([None, 1, 2])) for i in range(120)] + [(500 + i, [0.5] * 8, 7) for i in range(80)]
    rows += [(900, None, 1), (901, [float("nan")] * 8, 1), (902, [None, *[1.0] * 7], 1), (903, [float("-inf")] * 8, 1)]
    out, books = codebooks.compress(spark.createDataFrame(rows, VEC).withColumn("key", F.lit("x")).withColumn("n", F.lit(1)), parts=4, entries=16, hot_share=hot_share)
    assert (sorted((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), codebooks.digest(books)) == brute_codes(rows, 4, 16, 2, 256)


def test_large_components_are_exact(spark):
    rows = [(i, [float(2 ** (i % 40)), 1.0, -float(3 ** (i % 20)), 0.5], 1) for i in range(60)]
    out, books = codebooks.compress(spark.createDataFrame(rows, VEC), parts=2, entries=4)
    want, sha = brute_codes(rows, 2, 4, 2, 256)
    most = codebooks.MOST
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()) == [(i, c, min(e, most), min(t, most)) for i, c, e, t in want] and codebooks.digest(books) == sha


def test_codes_of_odd_tables(spark):
    out, books = codebooks.compress(spark.createDataFrame([], VEC))
    assert out.count() == 0 and codebooks.digest(books) == hashlib.sha256(b"").hexdigest()
    rows = [(2, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.0], 1), (None, [4.0, 5.0, 6.0], None), (1, [0.0], 1), (0, [], 1)]
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in codebooks.compress(spark.createDataFrame(rows, VEC), parts=2)[0].collect()), key=str)
    # three components are padded to four; other lengths keep a row without a code; equal rows share the lower entry
    assert got == [(0, None, None, 0), (1, None, None, 0), (2, "0000", 0, 0), (2, "0000", 0, 0), (None, "0202", 0, 0)]


# ---- main texts ----

PROSE = "It was one of the first days of the year when they had come down to the river and there was no one on the other side, so that all of them could see what had been left there by the water and by the wind."
MORE = "This is what we have from them, and there is more of it in the letters that he and his brother have been given when they were in the town for the last time, so it can be said that all of it was theirs."


def test_boilerplate_goes_and_the_article_stays():
    page = f"""<!doctype html><html><head><title>T &amp; T</title><style>p {{ color: red }}</style><script>var x = "<p>{PROSE}</p>";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1><p>{PROSE}</p></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
    <div class="cookie-notice"><p>{PROSE}</p></div><aside><p>{MORE}</p></aside><!-- <p>{PROSE}</p> -->
    <main><article><header><h1>The &quot;title&quot;</h1></header><p>{PROSE}</p><p>Short&nbsp;one.</p><div class="advert">{MORE}</div>
    <h2>Part two</h2><p>First   line<br>second <b>bold</b> <a href="x">link</a> of it.</p><ul><li>An item</li><li>Another</li></ul><form><p>{PROSE}</p></form>
    <blockquote>{MORE}</blockquote><section class="comments"><h3>Comments</h3><p>{PROSE}</p></section></article></main>
    <div id="sidebar"><p>{PROSE}</p></div><footer>&copy; {PROSE}</footer></body></html>"""
    want = ['The "title"', PROSE, "Short one.", "Part two", "First line second bold link of it.", "An item", "Another", MORE]
    assert extract.main_text(page).split("\n") == want


def test_pages_without_an_article():
    page = f"""<body><div class="menu"><a href=1>One</a> <a href=2>Two</a></div><div class="content"><h2>What was left</h2><p>{PROSE}</p><p>So it was.</p><p>{MORE}</p></div>
    <div><a href=3>{PROSE}</a></div><div>Call now</div><div>&copy; All of the rights are with the owner of it and no one else has any of them at all in this or any other year</div></body>"""
    assert extract.main_text(page).split("\n") == ["What was left", PROSE, "So it was.", MORE]
    assert extract.main_text(f"<nav>{PROSE}</nav><footer>{MORE}</footer>") == ""


def test_open_blocks_take_the_nearest_label():
    b = lambda text, density, **k: extract.Block(text, density=density, section=1, **k)
    long_good, long_bad = b("g" * 300, 0.4), b("b" * 300, 0.4, linked=0.9)
    row = [long_good, b("s" * 10, 0), b("s" * 30, 0), b("n" * 80, 0.15), long_bad, b("s", 0), b("t" * 90, 0.12)]
    extract.inherit(row)
    assert [x.label for x in row] == ["good", "good", "good", "bad", "bad", "bad", "bad"]
    alone = [b("s", 0), b("n" * 80, 0.15), b("x", 0, inside=True)]
    extract.inherit(alone)
    assert [x.label for x in alone] == ["bad", "good", "good"]
    apart = [long_bad, extract.Block("n" * 90, density=0.15, section=2), extract.Block("g" * 300, density=0.4, section=2)]
    extract.inherit(apart)
    assert [x.label for x in apart] == ["bad", "good", "good"]


def test_malformed_markup():
    m = extract.main_text
    assert m(f"<article><p><b>One.<br><p>{PROSE}<p>a < b &amp;amp; c > d &am &lt;p&gt;") == f"One.\n{PROSE}\na < b &amp; c > d &am <p>"
    assert m(f'<article><p title="a>b" data-x=\'</p>\'>{PROSE}</b></i></span></article></article>') == PROSE
    assert m("<article><p>a<br><br>b</p><script>never closed <p>c</p>") == "a\nb"
    assert m("<article><!-- never closed <p>c</p>") == "" and m("") == "" and m(None) == "" and m("plain words") == ""
    assert m(f"<ARTICLE><P>{PROSE}</P></ARTICLE>") == PROSE and m(f'<div role=navigation>{PROSE}</div>') == ""
    assert m(f'<article><div class="adventure headerless">{PROSE}</div></article>') == PROSE


def test_time_is_linear_in_the_page():
    for unit in ("<", "<a ", '<a "', "<a '\"", "<p>", "<div>", "</div>", "<a b=", "<!--", "<p>a</p>", "<i><p>", "x &", "<script>", "<article>x"):
        times = []
        for n in (20_000, 80_000):
            began = time.process_time()
            extract.main_text(unit * n)
            times.append(time.process_time() - began)
        assert times[1] < 12 * times[0] + 1, unit


def test_extraction_keeps_every_row(spark):
    rows = [(1, "u", f"<article><p>{PROSE}</p></article>"), (1, "u", f"<article><p>{PROSE}</p></article>"), (2, None, None), (3, "v", ""), (None, "w", "<p>x"), (4, "x", f"<article>{'<p>' + PROSE + '</p>'}" * 3000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("label", F.lit("z"))
    got = {(r.page_id, r.url, r.text) for r in extract.extract(frame).collect()}
    assert got == {(1, "u", PROSE), (2, None, ""), (3, "v", ""), (None, "w", ""), (4, "x", "\n".join([PROSE] * 3000))} and extract.extract(frame).count() == 6
    assert extract.extract(frame.limit(0)).collect() == []


# ---- fill in the middle ----


def brute_infill(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if out.startswith("<S>") else "psm", a, b - a, out


def test_infill_equals_brute_force_and_comes_back(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab\n <PSM>é🤦‍") for _ in range(rng.choice([0, 1, 2, 30, 200]))) for _ in range(400)]
    rows = [*enumerate(texts), (7, None), (None, "abc"), (None, "abc"), (1000, "é🤦" * 100_000), (1001, "<P>"), (1002, "<<P"), (-5, "x")]
    made = infill.transform(spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit(1)).withColumn("m", F.lit(2)))
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=key) == sorted(((i, *brute_infill(i, t), t or "") for i, t in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_matches_are_taken_lazily():
    """The second pass stops at the higher rank, and neither pass holds more than one match."""
    unit, text = re.compile(r"\w+\s*|\W+"), "one two, three  four"
    assert infill.count_units(text, unit) == 5
    assert [infill.cuts(text, unit, a, b) for a, b in ((0, 0), (0, 1), (1, 1), (2, 4), (5, 5))] == [(0, 0), (0, 4), (4, 4), (7, 16), (20, 20)]

    class Counted:
        taken = 0

        def finditer(self, text):
            for m in unit.finditer(text):
                Counted.taken += 1
                yield m

    assert infill.cuts(text, Counted(), 1, 3) == (4, 9) and Counted.taken == 3


def test_other_units(spark):
    rows = [(i, "a few words here and there, and some more.") for i in range(50)]
    made = infill.transform(spark.createDataFrame(rows, "doc_id long, text string"), unit=r"\S+\s*")
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.back == rows[0][1] and r.n == 9 for r in got)
    assert all(rows[0][1][: r.prefix_chars] in ("", rows[0][1]) or rows[0][1][r.prefix_chars - 1] == " " for r in got if r.form != "plain")
