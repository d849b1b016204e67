"""Small tests of the training-data operators: brute force, exact round trips, held-out accuracy, and odd input."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from codeloom.llm import brown, langid, mixing, neardup, packing, pii, quality, topk, warc, webp
from codeloom.llm.common import table

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeats, a long text, and clashing names."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n", "en", "a", 2), (4, "a b", "en", "a", 3), (4, "a b", "en", "a", 3), (None, "x y z", None, "b", 5), (5, "é ü " * 30_000, "fr", None, 120_000), (6, "12 34", "en", "b", 5)]
    return spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS uid", "2 AS token", "'x' AS key")


# ---- personal data ----


def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_fixed_patterns_equal_brute_force():
    rng = random.Random(1)
    parts = ["a@b.c", "@", ".", "x.y@z-1.com", "1.2.3.4", "300.1.1.1", "4111111111111111", "4111-1111 1111 1111", "+1 (234) 555-7777", " ", "-", "é", "9", "+", "@@", "a_b@c.d.e"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert sorted(pii.base_spans(text)) == sorted(brute_spans(text)), text


def test_long_runs_take_linear_time():
    for text in ("9" * 300_000, "a" * 300_000, "1." * 100_000, "@" * 100_000, "a@" * 100_000):
        pii.base_spans(text)
        pii.places(text[:0] + text)


def test_field_adds_spans_and_leaves_base(spark, odd):
    docs = table(spark, DATA, "documents")
    model = pii.fit(docs, rows=200, n_places=120)
    secret = "0123456789abcdef0123456789abcdef01234567"
    extra = frame(spark, [f'and the token = "{secret}" of it', "mail a@b.com now", "the year 2024 and 17 words", None])
    found = {r.doc_id: r.spans for r in pii.find(extra, model).collect()}
    assert found[0] == f"secret:17:{17 + len(secret)}" and found[1] == "email:5:12" and found[2] == "" and found[3] == ""
    masked = {r.doc_id: (r.text, r.n_chars) for r in pii.mask(extra, model).collect()}
    assert masked[1] == ("mail [EMAIL] now", 16) and masked[3] == (None, None)
    assert pii.find(odd, model).count() == odd.count() and pii.mask(odd, model).columns == odd.columns


# ---- media ----


def test_transforms_round_trip():
    rng = np.random.default_rng(0)
    for case in range(12):
        h, w = int(rng.integers(1, 30)), int(rng.integers(1, 30))
        px = rng.integers(0, [2, 17, 256][case % 3], (h, w, 4)).astype(np.uint32)
        px = px[..., 0] << 24 | px[..., 1] << 16 | px[..., 2] << 8 | px[..., 3]
        n = lambda b, w=w, h=h: ((w + (1 << b) - 1) >> b) * ((h + (1 << b) - 1) >> b)
        chains = [((), 0, None), ((("green",),), 5, None), ((("predictor", 2, rng.integers(0, 14, n(2))), ("cross", 3, rng.integers(0, 1 << 24, n(3))), ("green",)), 0, None), ((), 4, (2, rng.integers(0, 3, n(2))))]
        if len(np.unique(px)) <= 256:
            chains.append(((("palette",),), 0, None))
        for transforms, cache, groups in chains:
            assert np.array_equal(webp.decode(webp.encode(px, transforms, cache, groups)), px)


def test_payloads_round_trip(spark, odd):
    for data in (b"", b"a", bytes(range(256)) * 9, b"ab" * 5000, "é–𝄞".encode() * 700, bytes(1_200_000)):
        assert webp.load(webp.store(webp.padded(data))).tobytes() == webp.padded(data)
    rows = webp.features(webp.to_media(odd)).collect()
    texts = Counter((r.doc_id, r.text or "") for r in odd.collect())
    want = Counter()
    for (i, t), n in texts.items():
        p = t.encode() + b"\0" * (-len(t.encode()) % 64 or (0 if t else 64))
        want[i, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += n
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want


# ---- packing ----


def test_best_filling_equals_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        items, capacity = [k for k, n in counts.items() for _ in range(n)], rng.randint(1, 60)
        best = max(s for r in range(len(items) + 1) for c in itertools.combinations(items, r) if (s := sum(c)) <= capacity)
        got = packing.best_filling(counts, capacity)
        assert sum(k * n for k, n in got.items()) == best and all(n <= counts[k] for k, n in got.items())


def test_pieces_hold_each_id_once(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd_texts = frame(spark, ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|>  x", "<|endoftext|", "½ ②  \n\n 日本語 é\t", ""]).withColumn("doc_id", F.col("doc_id") - 10)
    docs = table(spark, DATA, "documents").limit(60).unionByName(odd_texts)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids, used = {i: {} for i in texts}, {}
    for p in packing.pack(docs).collect():
        own = np.frombuffer(p.ids, "<u4").tolist()
        assert len(own) == p.length
        ids[p.doc_id][p.start] = own
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, text in texts.items():
        assert [x for k in sorted(ids[i]) for x in ids[i][k]] == t.encode(text, add_special_tokens=False).ids + [0]
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    got = packing.pack(odd).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got}[1] == 1 and packing.pack(odd.limit(0)).count() == 0


# ---- mixing ----


def test_exponent_meets_both_goals(spark):
    sizes = [1000, 100, 50, 50, 50]
    sources = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate(sizes)], "mix_source string, docs long, tokens long")
    for target, most in ((0.95, 2.0), (0.95, 30.0), (0.8, 9.0), (1.0, 1e9)):
        a, scale, total = mixing.find_exponent(sources, target, most)
        shares = [t / sum(sizes) for t in sizes]
        meets = lambda a, shares=shares, target=target, most=most: mixing.spread(shares, a)[0] <= target * math.log(5) + 1e-9 and mixing.spread(shares, a)[1] <= most + 1e-9
        assert total == sum(sizes) and abs(scale - sum(s**a for s in shares)) < 1e-9
        assert meets(a) and (a == 0 or not meets(a - 1e-6))
    assert mixing.find_exponent(sources.limit(0))[0] == 1.0 and mixing.find_exponent(sources.limit(1))[0] == 1.0


def test_mix_realises_weights(spark, odd):
    docs = frame(spark, ["w " * (5 + i % 7) for i in range(3000)], ["big"] * 2400 + ["mid"] * 500 + [None] * 100)
    rows = mixing.mix(docs, target=0.95, max_passes=3.0, block_tokens=2000).collect()
    assert {r.doc_id for r in rows} == set(range(3000))
    sums, weights = Counter(), {r.source: r.mix_weight for r in rows}
    for r in rows:
        sums[r.source] += r.mix_tokens
    assert all(abs(sums[s] / sum(sums.values()) - w) < 0.01 for s, w in weights.items())
    assert max(Counter((r.doc_id) for r in rows).values()) <= 3
    again = mixing.mix(docs, target=0.95, max_passes=3.0, block_tokens=2000).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    part = mixing.mix(docs, budget=4000, max_passes=3.0).agg(F.sum("mix_tokens")).first()[0]
    assert 4000 <= part <= 4100
    assert mixing.mix(odd).count() >= odd.count() and mixing.mix(odd.limit(0)).count() == 0


# ---- top-k ----


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_top_k_equals_brute_force(spark, lists):
    rng = np.random.default_rng(lists)
    v = {i: rng.normal(size=6).round(1).tolist() for i in range(300)} | {i: [1.0] * 6 for i in range(300, 420)}
    rows = [(i, x, 0) for i, x in v.items()] + [(900, None, 0), (920, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (940, [float("nan")] * 6, 0), (960, [2.0, 1.0], 0), (961, [1.0, 1.0], 0)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, query int"), "vec_id % 20 = 0", k=5, lists=lists).collect()
    q = {i: [math.floor(64 * np.float32(c).astype(float)) for c in x] for i, x in v.items()}
    want = []
    for i in (i for i in q if i % 20 == 0):
        best = sorted(((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i))[:5]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == sorted([*want, (960, 1, 961, 128 * 64 + 64 * 64)])


def test_top_k_takes_large_components_and_repeated_ids(spark):
    big = {0: [1e6, 0.0], 1: [2e4, 3e4], 2: [3e4, 1.0], 3: [1e6, -1e6], 20: [3e6, 2.0], 21: [1.5, 2.5]}
    rows = [(i, v) for i, v in big.items()] + [(1, [3.0, 2.0]), (1, [3.0, 2.0]), (20, [3e6, 2.0]), (40, [1e17, 0.0]), (60, [1.5e7, 1.5e7]), (61, [1.5e7, 1.0]), (62, [-3e7, 2e7])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", k=6).collect()
    q = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = []
    for own, (i, a) in enumerate(q):
        if i % 20 == 0:
            best = sorted((-max(-(2**63), min(sum(x * y for x, y in zip(a, b, strict=True)), 2**63 - 1)), j) for n, (j, b) in enumerate(q) if n != own)[:6]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 20 = 0").count() == 0
    assert topk.top_k(spark.createDataFrame([(0, None), (20, [float("nan")])], "vec_id long, embedding array<float>"), "vec_id % 20 = 0").count() == 0


# ---- quality ----


def test_rules_learn_and_compile(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out()).collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows]) > 0.95
    assert len(model.rules) < 400
    assert quality.score(frame(spark, [None, ""]), model).where("score BETWEEN 0 AND 1").count() == 2
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).where("score BETWEEN 0 AND 1").count() == docs.count()


# ---- class bigrams ----


def test_counts_and_base_equal_brute_force(spark, odd):
    rows = odd.collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    got = brown.score(odd, n_classes=8, rounds=2).collect()
    want = sorted((str(r.doc_id), held(r.doc_id), len(tokens(r.text)), sum(c[w] > 0 for w in tokens(r.text)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r.text)), 6)) for r in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert brown.score(odd.limit(0)).count() == 0


def test_classes_beat_unigrams(spark):
    rows = brown.score(table(spark, DATA, "documents"), rounds=4).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


# ---- archives ----


def test_archives_round_trip(spark):
    big = "<p>" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big + "é"), (4, "u\r\nv", None), (5, "http://c", "small"), (6, "http://d", "small"), (2, "http://b", big)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        last = max(j for j, _, g in rows if (g or "") == (h or ""))
        again = len(data) >= 1000 and i < last
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- languages ----


def test_chain_equals_brute_force():
    rng = np.random.default_rng(3)
    e, step = rng.random((70, 3)), rng.random((3, 3))
    got = langid.chain(e, np.array([0, 4, 4]), np.array([4, 4, 70]), step)
    want = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        p = step[:, path[0]].sum() * np.prod([e[t, path[t]] for t in range(4)]) * np.prod([step[a, b] for a, b in zip(path, path[1:], strict=False)])
        for t, k in enumerate(path):
            want[t, k] += p
    assert np.allclose(got[:4], want / want.sum(axis=1, keepdims=True)) and np.allclose(got.sum(axis=1), 1)


def test_languages_held_out(spark, odd):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs.where(~langid.held_out()), per_lang=100)
    rows = langid.label(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    got = {(r.doc_id, r.lang_pred, round(r.score, 3)) for r in langid.label(odd, model).collect()}
    assert [r.lang_pred for r in langid.label(frame(spark, ["½ ② Ⅷ 12", "ª"]), model).orderBy("doc_id").collect()][0] == "und"
    assert {(1, "und", 0.0), (2, "und", 0.0), (6, "und", 0.0)} <= got and langid.label(odd, model).count() == odd.count()
    assert langid.label(odd, langid.fit(odd.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_unidentifiable_texts_go(spark):
    rng, docs = random.Random(6), table(spark, "/root/testdata/sf0.01", "documents")
    noise = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(n)) for n in (1, 5, 80, 900)]
    junk = [*noise, "qqq zzz xxx jjj", "x", "Привет мир", "12 34", "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyz+/") for _ in range(400))]
    rows = [(-1 - i, t, None, "s", len(t)) for i, t in enumerate(junk)]
    both = docs.unionByName(spark.createDataFrame(rows, DOC))
    kept = {r.doc_id for r in langid.keep_identified(both).collect()}
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not [i for i in kept if i < 0] and len(ids - kept) <= 0.002 * len(ids)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(unlabelled).count() == len(ids)
    only_held = docs.withColumn("lang", F.when(langid.held_out(), F.col("lang")))
    assert langid.keep_identified(only_held).count() == len(ids)


# ---- near duplicates ----


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 99)) for _ in range(120)] for _ in range(8)]
    texts = []
    for _ in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = "z" + str(rng.randint(0, 9999))
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    texts += ["a b", "A  b", "a b c", "", None, " \t", "one two three four five", "one two three four five"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: (*v, v[1] == i) for i, v in brute_components(rows).items()}


def test_near_duplicates_of_odd_rows(spark, odd):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.doc_id is None} == {None}
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1 and kept.count() == odd.count() - 1
    assert neardup.keep_one(odd.limit(0)).count() == 0


def kept_at(rows, percent):
    """Ids that stay, by comparing all pairs of shingle sets."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := (t or "").encode().lower().split())}
    label = {i: i for i, _ in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {i for i, k in label.items() if i == k}


def test_stage_links_from_080(spark):
    assert neardup.half_keys_at(85) == 10 and neardup.half_keys_at(80) == 14
    rng, rows = random.Random(5), []
    for i in range(40):  # a text, and a copy with one inner word changed: 5 of its shingles go, 5 come
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(34, 74))]
        c = list(w)
        c[len(c) // 2] = f"z{i}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(c))]
    docs = frame(spark, [t for _, t in rows])
    stage = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()}
    assert stage == kept_at(rows, 80) and stage < kept_at(rows, 85) and len(stage) > 40
    small = table(spark, DATA, "documents")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, small, DATA).collect()} == kept_at([(r.doc_id, r.text) for r in small.collect()], 80)


# ---- pipeline ----


def test_pipeline(spark):
    docs = table(spark, DATA, "documents")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA).cache()
        assert after.columns == docs.columns, name
        ids, before = {r.doc_id for r in after.select("doc_id").collect()}, {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "near_dedup":
            assert ids == kept_at([(r.doc_id, r.text) for r in docs.collect()], 80)
        else:
            assert ids == before, name  # every text here has a language, and no other stage drops any
        docs = after
    assert docs.count() <= 2 * n and corpus_pipeline.run(spark, DATA).count() > 0


# ---- queries by name ----


def test_pii_query_equals_brute_force(spark):
    kinds = ("email", "ip", "card", "phone")
    texts = {r.doc_id: r.text or "" for r in table(spark, DATA, "documents").collect()}
    rows = __spark_entry__.queries()["op1_semi_markov_pii"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = sorted(brute_spans(texts[r.doc_id]), key=lambda s: (kinds.index(s[0]), s[1]))
        assert tuple(r[f"n_{k}"] for k in kinds) == tuple(sum(s[0] == k for s in want) for k in kinds)
        lines = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(lines).encode()).hexdigest() and set(lines) <= set(r.spans.split(",")) | {""}


def test_mixing_query_keeps_its_budget(spark):
    rows = __spark_entry__.queries()["op4_temperature_mixing"](spark, DATA).collect()
    n, sums, weights = table(spark, DATA, "documents").count(), Counter(), {r.source: r.mix_weight for r in rows}
    for r in rows:
        sums[r.source] += r.mix_tokens
    assert len({(r.doc_id, r.mix_pass) for r in rows}) == len(rows) <= mixing.MAX_PASSES * n + n
    assert abs(sum(weights.values()) - 1) < 1e-9 and all(abs(sums[s] / sum(sums.values()) - w) < 0.1 for s, w in weights.items())
