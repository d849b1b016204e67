"""Language identification by a linear-chain conditional random field over words.

Each word has features: its affixes, its letter n-grams and its lexicon entries (languages in which the training sample
shows it often). Weights of features and transitions between the languages of neighbouring words are trained together
by gradient ascent on the log-likelihood, over slices of documents and of mixtures of two languages, so that the chain
learns how seldom a text switches. A document is labelled word by word with forward-backward over all its words; the
mean of the words' marginals is its share of each language, and the largest share decides.

Chains are run for many documents at once: blocks of words are multiplied out side by side, joined along each document,
and then swept forwards and backwards inside, which gives the exact marginals of the whole chain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASE, _BYTES, _INVERSE, _powers, chunks, mix64, quantile, remainder, stored

BUCKETS = 1 << 16
SAMPLE_PER_LANG = 300  # documents of each language that the model is fitted on, about
SAMPLE_CHARS = 8000  # of a text of the sample at most
SLICE = 60  # words of a training slice
STEPS = 40
LEXICON = 20_000  # words in the lexicon at most
BLOCK = 32
SEED = 11
LOWEST = 0.005  # share of the labelled held-out rows at which the thresholds are taken, with a margin below
MARGIN = 0.85
UNDETERMINED = "und"
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[97:123] = True
_WORD_BYTE[128:] = True
_LETTER = re.compile(r"[^\W\d_]")
_HEAD, _TAIL = 16, 4
_LABELLED = "doc_id long, uid long, lang_pred string, score double, n_words long, n_switches long"


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of a letter category; signs that stand for numbers are none."""
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, begin and end of each word (a run of letters or of bytes above 127), first word of each text. A run of
    more than ``_HEAD`` bytes is several words of the chain, so features see all of it."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = _WORD_BYTE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    begin, end = edges[0::2], edges[1::2]
    parts = -(-(end - begin) // _HEAD)
    if len(parts) and parts.max() > 1:
        number = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, end = np.repeat(begin, parts) + number * _HEAD, np.repeat(end, parts)
        end = np.minimum(end, begin + _HEAD)
    return raw, begin, end, np.searchsorted(begin, np.cumsum([0] + [len(t) + 1 for t in texts]))


def distinct_words(raw: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Hash of each distinct word, where it first stands, and the distinct word of each word."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw))[:-1], out=sums[1:])
    hashes = mix64((sums[end] - sums[begin]) * _powers(_INVERSE, len(raw))[begin] + (end - begin).astype(np.uint64))
    return np.unique(hashes, return_index=True, return_inverse=True)


def features(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """(words, features) of bucket numbers; bucket 0 stands for no feature and its weight stays 0."""
    n, size = len(begin), (end - begin)[:, None]
    place = np.arange(_HEAD)
    head = np.where(place < size, raw[np.minimum(begin[:, None] + place, len(raw) - 1)], 0).astype(np.uint64)
    tail_at = np.arange(-_TAIL, 0)
    tail = np.where(-tail_at <= size, raw[np.maximum(end[:, None] + tail_at, 0)], 0).astype(np.uint64)

    def bucket(kind: int, code: np.ndarray, there: np.ndarray) -> np.ndarray:
        at = mix64(code * np.uint64(64) + np.uint64(kind)) % np.uint64(BUCKETS - 1) + np.uint64(1)
        return np.where(there, at, 0).astype(np.int32)

    out, code = [], np.zeros((n, 1), np.uint64)
    for k in range(3):  # prefixes of 1 to 3 bytes
        code = code * np.uint64(256) + head[:, k : k + 1]
        out.append(bucket(1 + k, code, size > k))
    code = np.zeros((n, 1), np.uint64)
    for k in range(4):  # suffixes of 1 to 4
        code = code + (tail[:, _TAIL - 1 - k, None] << np.uint64(8 * k))
        out.append(bucket(5 + k, code, size > k))
    two = head[:, :-1] * np.uint64(256) + head[:, 1:]
    three = two[:, :-1] * np.uint64(256) + head[:, 2:]
    out.append(bucket(10, two, place[1:] < size))
    out.append(bucket(11, three, place[2:] < size))
    known, langs = lexicon
    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
    entry = langs[at].astype(np.uint64)[:, None] if len(known) else np.zeros((n, 1), np.uint64)
    out.append(bucket(12, entry, (known[at] == hashes)[:, None] if len(known) else np.zeros((n, 1), bool)))
    out.append(bucket(13, np.ones((n, 1), np.uint64), np.ones((n, 1), bool)))
    return np.concatenate(out, axis=1)


def scores(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros((len(at), weights.shape[1]))
    for k in range(at.shape[1]):
        total += weights[at[:, k]]
    return total


def chain(emission: np.ndarray, begin: np.ndarray, end: np.ndarray, step: np.ndarray, messages: bool = False):
    """Marginals (words, labels) of chains over words [begin, end): emission factors, transition factors ``step``. With
    ``messages`` also the forward and backward messages of each word, up to a factor."""
    n_labels = emission.shape[1]
    out, ahead, behind = np.zeros_like(emission), np.zeros_like(emission), np.zeros_like(emission)
    sizes = end - begin
    chains = np.flatnonzero(sizes > 0)
    chains = chains[np.argsort(-sizes[chains], kind="stable")]
    if not len(chains):
        return (out, ahead, behind) if messages else out
    begin, sizes = begin[chains], sizes[chains]
    n_blocks = -(-sizes // BLOCK)
    first = np.cumsum(n_blocks) - n_blocks
    total = int(n_blocks.sum())
    owner = np.repeat(np.arange(len(chains)), n_blocks)
    number = np.arange(total) - first[owner]
    place = (begin[owner] + number * BLOCK)[:, None] + np.arange(BLOCK)
    real = number[:, None] * BLOCK + np.arange(BLOCK) < sizes[owner][:, None]
    e = np.where(real[:, :, None], emission[np.minimum(place, len(emission) - 1)], 1.0)

    product = np.broadcast_to(np.eye(n_labels), (total, n_labels, n_labels)).copy()
    for t in range(BLOCK):
        after = (product @ step) * e[:, t, None, :]
        product = np.where(real[:, t, None, None], after / after.max(axis=(1, 2), keepdims=True), product)
    enter, leave = np.empty((total, n_labels)), np.empty((total, n_labels))
    longest = int(n_blocks[0])
    active = np.searchsorted(-n_blocks, -np.arange(longest), side="left")  # chains with more than k blocks, longest first
    state = np.full((len(chains), n_labels), 1.0 / n_labels)
    for k in range(longest):
        m = active[k]
        enter[first[:m] + k] = state[:m]
        state[:m] = np.einsum("bi,bij->bj", state[:m], product[first[:m] + k])
        state[:m] /= state[:m].sum(axis=1, keepdims=True)
    state = np.ones((len(chains), n_labels))
    for k in range(longest - 1, -1, -1):
        m = active[k]
        leave[first[:m] + k] = state[:m]
        state[:m] = np.einsum("bij,bj->bi", product[first[:m] + k], state[:m])
        state[:m] /= state[:m].max(axis=1, keepdims=True)
    forward = np.empty((total, BLOCK, n_labels))
    state = enter
    for t in range(BLOCK):
        after = (state @ step) * e[:, t]
        state = np.where(real[:, t, None], after / after.sum(axis=1, keepdims=True), state)
        forward[:, t] = state
    if messages:
        ahead[place[real]] = forward[real]
    backward = np.empty_like(forward) if messages else None
    state = leave
    for t in range(BLOCK - 1, -1, -1):
        if messages:
            backward[:, t] = state
        both = forward[:, t] * state
        forward[:, t] = both / both.sum(axis=1, keepdims=True)
        before = (e[:, t] * state) @ step.T
        state = np.where(real[:, t, None], before / before.max(axis=1, keepdims=True), state)
    out[place[real]] = forward[real]
    if messages:
        behind[place[real]] = backward[real]
        return out, ahead, behind
    return out


class Model:
    """Labels, feature weights, transition weights and the lexicon."""

    def __init__(self, labels: list[str], weights: np.ndarray, steps: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]):
        self.labels, self.weights, self.steps, self.lexicon = labels, weights, steps, lexicon
        self.seen = np.any(weights != 0, axis=1)

    def marginals(self, texts: list[bytes]):
        """Marginals of all words of some lower-case texts, the first word of each text, and the share of each word's
        features that the training sample has."""
        raw, begin, end, at = spans(texts)
        if not len(begin):
            return np.zeros((0, len(self.labels))), at, np.zeros(0)
        with np.errstate(over="ignore"):
            hashes, first, inverse = distinct_words(raw, begin, end)
            found = features(raw, begin[first], end[first], self.lexicon, hashes)
        s = scores(self.weights, found)
        factor = np.exp(np.maximum(s - s.max(axis=1, keepdims=True), -30.0))[inverse]
        own = found[:, :-1]  # the last one is there in every word
        known = np.count_nonzero(self.seen[own], axis=1) / np.count_nonzero(own, axis=1)
        return chain(factor, at[:-1], at[1:], np.exp(self.steps)), at, known[inverse]


def train(samples: list[tuple[str, str]], steps: int = STEPS, seed: int = SEED) -> Model:
    """Fit the field on (text, lang) pairs; the same samples in any order give the same model."""
    samples = sorted(samples)
    labels = sorted({lang for _, lang in samples})
    n_labels, rng = max(1, len(labels)), np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(labels)}
    raw, begin, end, at = spans([t.lower().encode("utf-8", "surrogatepass") for t, _ in samples] or [b""])
    if len(labels) < 2 or not len(begin):
        return Model(labels, np.zeros((BUCKETS, n_labels), np.float32), np.zeros((n_labels, n_labels)), (np.empty(0, np.uint64), np.empty(0, np.int64)))
    with np.errstate(over="ignore"):
        hashes, first, inverse = distinct_words(raw, begin, end)
    lang_of = np.repeat([number[lang] for _, lang in samples], np.diff(at)[: len(samples)])
    seen = np.bincount(inverse * n_labels + lang_of, minlength=len(hashes) * n_labels).reshape(-1, n_labels)
    clear = np.flatnonzero((seen.max(axis=1) >= 3) & (seen.max(axis=1) >= 0.9 * seen.sum(axis=1)))
    clear = np.sort(clear[np.argsort(-seen[clear].max(axis=1), kind="stable")[:LEXICON]])
    lexicon = (hashes[clear], seen[clear].argmax(axis=1))
    with np.errstate(over="ignore"):
        found = features(raw, begin[first], end[first], lexicon, hashes)

    # slices of one document, and slices that go on in a document of another language
    pieces, targets = [], []
    for i in rng.permutation(len(samples)).tolist():
        for j in (i, int(rng.integers(len(samples)))):
            lo, hi = at[i], at[i + 1]
            if hi <= lo:
                continue
            start = int(rng.integers(lo, max(lo + 1, hi - SLICE)))
            words = np.arange(start, min(hi, start + SLICE))
            if j != i and at[j + 1] > at[j]:
                other = np.arange(at[j], min(at[j + 1], at[j] + int(rng.integers(5, SLICE))))
                words = np.concatenate([words[: int(rng.integers(5, SLICE))], other])
            pieces.append(inverse[words])
            targets.append(lang_of[words])
    sizes = np.array([len(p) for p in pieces])
    stop = np.cumsum(sizes)
    word, target = np.concatenate(pieces), np.concatenate(targets)
    follows = np.ones(len(word), bool)
    follows[stop - sizes] = False
    pair = np.flatnonzero(follows)
    gold_steps = np.bincount(target[pair - 1] * n_labels + target[pair], minlength=n_labels**2).reshape(n_labels, n_labels)
    weights, between = np.zeros((BUCKETS, n_labels)), np.zeros((n_labels, n_labels))
    grown, grown_b = np.full_like(weights, 1e-8), np.full_like(between, 1e-8)
    one_hot = np.eye(n_labels)[target]
    for _ in range(steps):
        s = scores(weights, found)
        factor = np.exp(np.maximum(s - s.max(axis=1, keepdims=True), -30.0))[word]
        step = np.exp(between)
        m, ahead, behind = chain(factor, stop - sizes, stop, step, messages=True)
        joint = ahead[pair - 1][:, :, None] * step * (factor[pair] * behind[pair])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        by_word = np.stack([np.bincount(word, weights=(one_hot - m)[:, k], minlength=len(hashes)) for k in range(n_labels)], axis=1)
        gradient = np.stack([np.bincount(found.ravel(), weights=np.repeat(by_word[:, k], found.shape[1]), minlength=BUCKETS) for k in range(n_labels)], axis=1)
        gradient = gradient / len(word) - 1e-6 * weights
        gradient[0] = 0.0
        grown += gradient**2
        weights += 0.3 * gradient / np.sqrt(grown)
        gradient_b = (gold_steps - joint.sum(axis=0)) / len(pair) - 1e-4 * between
        grown_b += gradient_b**2
        between += 0.3 * gradient_b / np.sqrt(grown_b)
    return Model(labels, weights.astype(np.float32), between, lexicon)


def _sample(docs: DataFrame, per_lang: int) -> list[tuple[str, str]]:
    """(text, lang) of ``per_lang`` different texts of each language, those with the least hashes, from rows of ``docs``
    (text, lang) with neither null; of a long text a slice of ``SAMPLE_CHARS``. Both bounds are parameters of the fit;
    languages are labels, so few. Copies of a text count once, however many there are."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").withColumn("hash", F.xxhash64("text", F.lit(SEED)))
    first = Window.partitionBy("lang").orderBy("hash")
    drawn = rows.groupBy("lang", "hash").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(first)).where(f"place <= {per_lang}").select("lang", "hash")
    start = F.pmod("hash", F.greatest(F.length("text") - F.lit(SAMPLE_CHARS - 1), F.lit(1)).cast("long")).cast("int") + 1
    found = rows.join(F.broadcast(drawn), ["lang", "hash"])  # ``per_lang`` numbers of each language
    sample = found.select("lang", "hash", F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS)).alias("text")).groupBy("lang", "hash").agg(F.min("text").alias("text")).toPandas()
    return list(zip(sample["text"], sample["lang"], strict=True))


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Train on the sample of ``docs``."""
    return train(_sample(docs, per_lang))


def _labeller(model, with_known: bool = False):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for batch in batches:
            for first, texts in chunks(batch["text"], every_letter=True):
                marginals, at, known = m.marginals(texts)
                sums = np.concatenate([np.zeros((1, marginals.shape[1])), np.cumsum(marginals, axis=0)])
                shares = sums[at[1:]] - sums[at[:-1]]
                best = marginals.argmax(axis=1) if len(marginals) else np.empty(0, int)
                turn = np.concatenate([[0], np.cumsum(np.append(0, best[1:] != best[:-1]))]) if len(best) else np.zeros(1, int)
                part = batch.iloc[first : first + len(texts)]
                rows = []
                for i, text in enumerate(part["text"]):
                    n = int(at[i + 1] - at[i])
                    if not m.labels or not has_letter(text):
                        rows.append((UNDETERMINED, 0.0, n, 0))
                    elif not n:  # letters that no word of the model has: every language is as likely
                        rows.append((m.labels[0], 1.0 / len(m.labels), 0, 0))
                    else:
                        k = int(shares[i].argmax())
                        rows.append((m.labels[k], float(min(1.0, shares[i, k] / n)), n, int(turn[at[i + 1]] - turn[at[i] + 1])))
                out = pd.DataFrame(rows, columns=["lang_pred", "score", "n_words", "n_switches"])
                if with_known:
                    sums = np.concatenate([[0.0], np.cumsum(known)])
                    out["known"] = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, np.diff(at))
                out.insert(0, "uid", part["uid"].to_numpy())
                out.insert(0, "doc_id", part["doc_id"].astype("Int64").array)
                yield out

    return run


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, uid, lang_pred, score, n_words, n_switches of each row of ``docs`` (doc_id, text).

    A null text, or one without a letter, is ``und`` with score 0. A score is the share of the predicted language.
    Ties go to the first label in order. Repeated rows come back once each; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: labels * BUCKETS weights and LEXICON words
    return rows.mapInPandas(_labeller(shared), _LABELLED)


def held_out(column: str = "doc_id"):
    return remainder(column, 4) == 2


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows outside the held-out fold and label all rows."""
    model = fit(docs.where(~held_out()))
    return label(docs, model)


def thresholds(docs: DataFrame, model: Model) -> tuple[float, float]:
    """Least score, and least share of known features, of a text with a language: so far below what nearly all labelled
    held-out rows have that such texts pass. All these rows count, with their whole texts and as often as they are there. A
    score of a half is always enough. Zeros without labels."""
    if len(model.labels) < 2:
        return 0.0, 0.0
    rows = docs.where(held_out()).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.lit(0).cast("long").alias("uid"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = rows.mapInPandas(_labeller(shared, True), f"{_LABELLED}, known double").where(F.col("lang_pred") != UNDETERMINED)
    found = stored(found.select("score", "known"), "held-out")
    score, known = (quantile(found, c, LOWEST) for c in ("score", "known"))
    if score is None:
        return 0.0, 0.0
    chance = 1 / len(model.labels)
    return min(0.5, chance + (1 - MARGIN) * max(0.0, score - chance)), MARGIN * known


def _rejector(model, columns: list[str], least: float, least_known: float):
    inner = _labeller(model, True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            named = pd.DataFrame({"doc_id": batch["doc_id"], "text": batch["text"], "uid": 0})
            found = pd.concat(list(inner([named])), ignore_index=True) if len(named) else named.assign(lang_pred="", score=0.0, known=0.0)
            keep = (found["lang_pred"] != UNDETERMINED) & (found["score"] >= least) & (found["known"] >= least_known)
            yield batch[keep.to_numpy()][columns]

    return run


def keep_identified(docs: DataFrame, least: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is determined, with all columns unchanged: their score is at least ``least``, or
    else what the labelled held-out fold gives, and enough of their words' features are known. Without any label to learn
    from nothing can be decided, and all rows stay."""
    model = fit(docs.where(~held_out()))
    if not model.labels:
        return docs
    score, known = thresholds(docs, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInPandas(_rejector(shared, docs.columns, score if least is None else least, known), docs.schema)
