"""Language-model scoring with Brown class-based bigrams.

The exchange algorithm assigns units to classes: the frequent words, those of a given share of the training tokens, so at
most one over that share, and as many endings at most that stand for the other words for a start. In each round Spark
gathers every unit's counts with the classes around it, and units move, one after another, to the class that raises the
likelihood of the class bigrams most. Every other word that the training texts have at least twice then gets its own best
class, by the same gain to first order, from the classes that stand before and after it in the whole corpus. So the classes
that are learnt grow with the input; words seen once, and unseen ones, keep the class of their ending. A text's probability is the product of smoothed class transitions and word emissions.

Counts of all words are exact and stay distributed. Texts are turned into chunks that number their words locally; only the
chunks' vocabularies, not their tokens, are shuffled by word. A chunk's words that no other chunk has, and that have no
class of their own, need not come back. Each chunk then becomes its texts' classes and emissions, which are kept with the
counts of class pairs; a last pass adds the transitions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, remainder, word_hashes, words

CLASSES = 64
UNIT_SHARE = 1e-4  # of the training tokens that a frequent word has at least, so there are at most 1 / UNIT_SHARE
LEAST = 2  # training occurrences of a word with a class of its own
PRIOR = 1.0  # log10 odds for the class of a word's ending
ROUNDS = 8
CHUNK_TOKENS = 3_000_000
EMISSION = 0.5  # added to each word's count in its class, and kept for unseen words
TRANSITION = 20.0  # transitions' weight of the class distribution without context
_END, _RARE = 0, 1
_CHUNKED = "chunk long, doc_id long, held_out boolean, tokens binary, place int, word string, n_train long, around binary"
_CLASSED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary, a int, b int, n long"


class Units:
    """Unit numbers of frequent words by their hashes, and of other words by their last three bytes, or else ``_RARE``."""

    def __init__(self, hashes: list[int], endings: list[int]):
        self.hashes = np.sort(np.array(hashes, np.int64).view(np.uint64))
        self.endings = np.sort(np.array(endings, np.int64))
        self.first_ending = 2 + len(hashes)
        self.size = self.first_ending + len(endings)

    def of(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), _RARE, np.int64)
        if len(self.endings):
            at = np.minimum(np.searchsorted(self.endings, tails), len(self.endings) - 1)
            out = np.where(self.endings[at] == tails, at + self.first_ending, out)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == hashes, at + 2, out)
        return out

    def is_word(self, unit: np.ndarray) -> np.ndarray:
        return (unit > _RARE) & (unit < self.first_ending)


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and endings (the last three bytes as a number) of all words, and where each text's words begin."""
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(1, np.int64)
    with np.errstate(over="ignore"):
        hashes, at = word_hashes(texts)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = np.isin(raw, (9, 10, 11, 12, 13, 32))
    ends = np.flatnonzero(~space[:-1] & space[1:])  # last byte of each word
    tails, going = np.zeros(len(ends), np.int64), np.ones(len(ends), bool)
    for k in range(3):
        place = np.maximum(ends - k, 0)
        going &= (ends >= k) & ~space[place]
        tails += np.where(going, raw[place].astype(np.int64) << (8 * k), 0)
    return hashes, tails, at


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)


def _often(share: float):
    """Of each task's stretch of tokens the words with half the share of it, by hash, the endings with half the share,
    and the number of its tokens (null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        endings: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> pd.DataFrame:
            out: list[tuple] = [(None, False, total)]
            for ending, parts in ((False, held), (True, endings)):
                if parts:
                    codes, n = _merged(parts)
                    often = n >= share / 2 * total
                    out += zip(codes[often].view(np.int64).tolist(), itertools.repeat(ending), n[often].tolist(), strict=False)
            return pd.DataFrame(out, columns=["code", "ending", "n"]).astype({"code": "Int64"})

        for batch in batches:
            for _, texts in chunks(batch["text"]):
                hashes, tails, _ = _hashed(texts)
                total += len(hashes) + len(texts)
                held.append(np.unique(hashes, return_counts=True))
                endings.append(np.unique(tails, return_counts=True))
                if total >= CHUNK_TOKENS:
                    yield flush()
                    held, endings, total = [], [], 0
                elif len(held) > 8:
                    held, endings = [_merged(held)], [_merged(endings)]
        if total:
            yield flush()

    return run


def _pairs(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, texts in chunks(batch["text"]):
                hashes, tails, at = _hashed(texts)
                flow = np.concatenate([[_END], np.insert(units.of(hashes, tails), at[1:], _END)])  # each text's units and its end
                held.append(np.unique(flow[:-1] * units.size + flow[1:], return_counts=True))
                if sum(len(c) for c, _ in held) > 3_000_000 and len(held) > 1:
                    held = [_merged(held)]
        if held:
            codes, n = _merged(held)
            for low in range(0, len(codes), 100_000):
                part = codes[low : low + 100_000]
                yield pd.DataFrame({"a": part // units.size, "b": part % units.size, "n": n[low : low + 100_000]})

    return run


def _around(shared, n_classes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value
        for batch in batches:
            rows = []
            for unit, side, others, counts in zip(batch["unit"], batch["side"], batch["others"], batch["counts"], strict=True):
                others, counts = np.asarray(others), np.asarray(counts)
                apart = others != unit
                rows.append((unit, side, np.bincount(of[others[apart]], weights=counts[apart], minlength=n_classes).astype(np.int64), int(counts[~apart].sum())))
            yield pd.DataFrame(rows, columns=["unit", "side", "around", "self"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(after: np.ndarray, before: np.ndarray, own: np.ndarray, of: np.ndarray, order: np.ndarray, n_classes: int) -> int:
    """One round: each unit of ``order`` moves to its best class. ``after`` and ``before`` hold counts of the classes that
    follow and precede each unit, without the unit itself, ``own`` the counts of the unit after itself. Changes ``of``;
    returns the number of moves."""
    table = np.zeros((n_classes, n_classes))
    np.add.at(table, of, after)
    np.add.at(table, (of, of), own)
    moves = 0
    for w in order:
        r, c, s, home = after[w], before[w], own[w], of[w]
        table[home] -= r
        table[:, home] -= c
        table[home, home] -= s
        np.maximum(table, 0, out=table)  # counts of units that moved in this round are those of its start
        rows, columns = table.sum(axis=1), table.sum(axis=0)
        flat = _xlogx(table)
        by_row = _xlogx(table + r) - flat
        by_column = _xlogx(table + c[:, None]) - flat
        corner = np.diagonal(table)
        gain = by_row.sum(axis=1) - np.diagonal(by_row) + by_column.sum(axis=0) - np.diagonal(by_column)
        gain += _xlogx(corner + r + c + s) - _xlogx(corner)
        gain -= _xlogx(rows + r.sum() + s) - _xlogx(rows) + _xlogx(columns + c.sum() + s) - _xlogx(columns)
        gain[[_END, _RARE]] = -np.inf  # the end has a class of its own, and so has what has no unit
        best = int(gain.argmax())
        if gain[best] <= gain[home] + 1e-9:
            best = int(home)
        moves += best != home
        of[w] = best
        table[best] += r
        table[:, best] += c
        table[best, best] += s
    return moves


class Model:
    """Totals and sizes of classes for emissions, and of all training tokens for the base."""

    def __init__(self, totals: np.ndarray, sizes: np.ndarray, tokens: int, distinct: int):
        self.totals, self.sizes, self.tokens, self.distinct = totals, sizes, tokens, distinct

    def emission(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + EMISSION) / (self.totals[classes] + EMISSION * (self.sizes[classes] + 1)))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + 1 * (self.distinct + 1)))


def steps_of(table: np.ndarray) -> np.ndarray:
    """log10 of smoothed transitions from the counts of class pairs."""
    alone = (table.sum(axis=0) + 1.0) / (table.sum() + len(table))
    return np.log10((table + TRANSITION * alone) / (table.sum(axis=1, keepdims=True) + TRANSITION))


def cluster(pairs: DataFrame, n_units: int, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of units, the counts of class pairs, and the counts of units, from counts (a, b, n) of unit pairs. The driver holds a vector of
    class counts for each unit; units are bounded."""
    spark, scratch = pairs.sparkSession, Scratch(pairs.sparkSession)
    sides = [pairs.select(F.col(x).alias("unit"), F.lit(side).alias("side"), F.col(y).alias("other"), "n") for side, x, y in ((0, "a", "b"), (1, "b", "a"))]
    lists = sides[0].union(sides[1]).groupBy("unit", "side").agg(F.collect_list(F.struct("other", "n")).alias("l"))
    lists = scratch.put(lists.select("unit", "side", F.col("l.other").alias("others"), F.col("l.n").alias("counts")), "around")
    of = np.zeros(n_units, np.int64)
    of[_RARE] = _RARE
    of[2:] = 2 + np.arange(n_units - 2) % (n_classes - 2)
    table = np.zeros((n_classes, n_classes))
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(of.copy())
        found = lists.mapInPandas(_around(shared, n_classes), "unit long, side int, around array<long>, self long").toPandas()
        after, before, own = np.zeros((n_units, n_classes)), np.zeros((n_units, n_classes)), np.zeros(n_units)
        for unit, side, around, self_ in zip(found["unit"], found["side"], found["around"], found["self"], strict=True):
            (before if side else after)[unit] = around
            own[unit] = self_
        table = np.zeros((n_classes, n_classes))
        np.add.at(table, of, after)
        np.add.at(table, (of, of), own)
        if turn == rounds or n_units <= 2:
            break
        weight = after.sum(axis=1) + own
        order = np.argsort(-weight, kind="stable")
        if not exchange(after, before, own, of, order[(order > _RARE) & (weight[order] > 0)], n_classes):
            break
    scratch.drop(lists)
    return of, table, after.sum(axis=1) + own


def _around_words(docs: list[tuple], classes: np.ndarray, frequent: np.ndarray, n_classes: int) -> tuple[np.ndarray, list[bytes]]:
    """Training counts of a chunk's words, and of each that is not frequent a byte for each neighbour: its class before
    the word, and ``n_classes`` more after it."""
    flow = [np.array([-1])]
    for _, held, tokens in docs:
        if not held:
            flow += [np.frombuffer(tokens, "<i4"), np.array([-1])]
    flow = np.concatenate(flow)
    counts = np.bincount(flow[flow >= 0], minlength=len(classes))
    known = np.where(flow < 0, _END, np.append(classes, _END)[flow])
    at = np.flatnonzero(~np.append(frequent, True)[flow])
    word = np.concatenate([flow[at], flow[at]])
    keys = np.concatenate([known[at - 1], known[at + 1] + n_classes]).astype(np.uint8)
    keys = keys[np.argsort(word, kind="stable")].tobytes()
    ends = np.cumsum(np.bincount(word, minlength=len(classes))).tolist()
    return counts, [keys[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _number(shared, n_classes: int):
    """Chunks of rows: each document as local word numbers and their units' classes, then the chunk's words with their
    training counts and the classes around them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, of = shared.value
        task, serial = TaskContext.get().partitionId(), 0
        local: dict[bytes, int] = {}
        docs: list[tuple] = []
        total = 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal serial, local, docs, total
            chunk = task << 32 | serial
            names = list(local)
            unit = units.of(*_hashed(names)[:2])
            classes = of[unit]
            counts, around = _around_words(docs, classes, units.is_word(unit), n_classes)
            first = classes.astype(np.uint8)
            for low in range(0, len(docs), 2000):
                out = pd.DataFrame(docs[low : low + 2000], columns=["doc_id", "held_out", "tokens"])
                none = pd.array([None] * len(out), "Int64")
                start = [first[np.frombuffer(t, "<i4")].tobytes() for t in out["tokens"]]
                yield pd.DataFrame({"chunk": chunk, "doc_id": out["doc_id"].astype("Int64"), "held_out": out["held_out"].astype("boolean"), "tokens": out["tokens"], "place": none.astype("Int32"), "word": None, "n_train": none, "around": start})
            for low in range(0, len(names), 50_000):
                part = [w.decode("utf-8", "replace") for w in names[low : low + 50_000]]
                none = pd.array([None] * len(part), "Int64")
                yield pd.DataFrame({"chunk": chunk, "doc_id": none, "held_out": none.astype("boolean"), "tokens": None, "place": np.arange(low, low + len(part)), "word": part, "n_train": counts[low : low + len(part)], "around": around[low : low + len(part)]})
            serial, local, docs, total = serial + 1, {}, [], 0

        for batch in batches:
            for doc_id, held, text in zip(batch["doc_id"].astype("Int64"), batch["held_out"], batch["text"], strict=True):
                put = local.setdefault
                found = np.array([put(w, len(local)) for w in words(text)], "<i4")
                docs.append((doc_id, bool(held), found.tobytes()))
                total += len(found) + 1
                if total >= CHUNK_TOKENS:
                    yield from flush()
        if docs:
            yield from flush()

    return run


def _assign(shared, n_classes: int):
    """word, c, class, and whether that differs from its unit's, from rows (word, n_train, around) sorted by word: sums over a word's rows, and the class of the
    greatest gain for words that are not frequent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, of, gains = shared.value
        last = None  # word, count and neighbours of the word that the next batch may go on with
        for batch in batches:
            names = batch["word"].to_numpy()
            fresh = np.ones(len(names), bool)
            fresh[1:] = names[1:] != names[:-1]
            starts = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            c = np.add.reduceat(batch["n_train"].to_numpy(np.int64), starts)
            sizes = np.array([len(x) for x in batch["around"]])
            keys = np.frombuffer(b"".join(batch["around"]), np.uint8)
            seen = np.bincount(np.repeat(group, sizes) * 2 * n_classes + keys, minlength=len(starts) * 2 * n_classes).reshape(len(starts), -1)
            names = names[starts].tolist()
            if last and last[0] == names[0]:
                c[0] += last[1]
                seen[0] += last[2]
            elif last:
                names, c, seen = [last[0], *names], np.concatenate([[last[1]], c]), np.concatenate([last[2][None], seen])
            last = (names[-1], c[-1], seen[-1])
            if len(names) > 1:
                yield decided(names[:-1], c[:-1], seen[:-1], units, of, gains)
        if last:
            yield decided([last[0]], np.array([last[1]]), last[2][None], units, of, gains)

    return run


def decided(names: list[str], c: np.ndarray, seen: np.ndarray, units: Units, of: np.ndarray, gains: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    unit = units.of(*_hashed([n.encode("utf-8", "surrogatepass") for n in names])[:2])
    start = of[unit]
    by_neighbour, by_count = gains
    gain = seen @ by_neighbour - c[:, None] * by_count
    gain[:, [_END, _RARE]] = -np.inf  # classes of the end, and of what has no unit
    gain[np.arange(len(c)), start] += PRIOR
    best = np.where((c >= LEAST) & ~units.is_word(unit), gain.argmax(axis=1), start)
    return pd.DataFrame({"word": names, "c": c, "class": best, "moved": best != start})


def class_gains(table: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a neighbour of each class (before, then after) adds to the likelihood for each class that a word may get, to
    first order, and what an occurrence of the word takes from it: from the counts of class pairs. ``closed`` classes, those
    of frequent words, take no other words: so many together would change them beyond the first order."""
    steps = steps_of(table)
    return np.concatenate([steps, steps.T]), np.log10(table.sum(axis=0) + 1.0) + np.where(closed, 1e9, 0.0)


def _classed(shared, n_classes: int):
    """A chunk's documents as classes, with the sums of their emissions and base; and its counts of class pairs."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        m: Model = shared.value
        flows = [np.frombuffer(t, "<i4") for t in left["tokens"]]
        held = left["held_out"].to_numpy(bool)
        size = 1 + max((int(t.max()) for t in flows if len(t)), default=-1)
        trained = [t for t, h in zip(flows, held, strict=True) if not h]
        counts = np.bincount(np.concatenate(trained), minlength=size).astype(np.float64) if trained else np.zeros(size)
        classes = np.full(size, _RARE)
        for t, start in zip(flows, left["around"], strict=True):
            classes[t] = np.frombuffer(start, np.uint8)
        place = right["place"].to_numpy(np.int64)
        counts[place], classes[place] = right["c"].to_numpy(np.float64), right["class"].to_numpy(np.int64)
        emitted, base = m.emission(classes, counts), m.base(counts)
        ends = np.array([m.totals[_END]])
        end_emitted, end_base = m.emission(np.array([_END]), ends)[0], m.base(ends)[0]
        pairs, rows = np.zeros(n_classes * n_classes, np.int64), []
        for doc_id, h, t in zip(left["doc_id"], held, flows, strict=True):
            flow = np.concatenate([[_END], classes[t], [_END]])
            if not h:
                pairs += np.bincount(flow[:-1] * n_classes + flow[1:], minlength=len(pairs))
            rows.append((doc_id, bool(h), len(t) + 1, int((counts[t] > 0).sum()) + int(ends[0] > 0), float(base[t].sum() + end_base), float(emitted[t].sum() + end_emitted), classes[t].astype(np.uint8).tobytes(), None, None, None))
        rows += [(None, None, None, None, None, None, None, int(k) // n_classes, int(k) % n_classes, int(pairs[k])) for k in np.flatnonzero(pairs)]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _CLASSED.split(", ")])
        return out.astype({"doc_id": "Int64", "held_out": "boolean", "n_tokens": "Int64", "n_known": "Int64", "a": "Int32", "b": "Int32", "n": "Int64"})

    return run


def _stepped(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, tokens = shared.value
        for batch in batches:
            total = []
            for emitted, classes in zip(batch["emitted"], batch["classes"], strict=True):
                flow = np.concatenate([[_END], np.frombuffer(classes, np.uint8), [_END]]).astype(np.int64)
                total.append(emitted + float(steps[flow[:-1], flow[1:]].sum()))
            out = batch[["doc_id", "held_out", "n_tokens", "n_known"]].astype({"doc_id": "Int64"})
            yield out.assign(train_tokens=tokens, base_score=batch["base_score"], score=total)

    return run


def score(docs: DataFrame, n_classes: int = CLASSES, share: float = UNIT_SHARE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text).

    Rows of fold 2 of 7 are held out; the model is trained on the rest. A null or empty text is its end token alone.
    Repeated rows count and come back once each; a null id belongs to fold 0. Other columns are ignored, and an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    scratch, send = Scratch(spark), spark.sparkContext.broadcast
    rows = docs.select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    trained = rows.where("NOT held_out").select("text")
    often = scratch.put(trained.mapInPandas(_often(share), "code long, ending boolean, n long").groupBy("code", "ending").agg(F.sum("n").alias("n")), "often")
    whole = often.where("code IS NULL").first()
    least = max(LEAST, share * whole["n"]) if whole else LEAST
    frequent = often.where(F.col("code").isNotNull() & (F.col("n") >= least)).collect()  # at most 1 / share of each kind
    units = Units(*([r["code"] for r in frequent if r["ending"] == kind] for kind in (False, True)))
    pairs = trained.mapInPandas(_pairs(send(units)), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    of, table, weight = cluster(pairs, units.size, n_classes, rounds)
    by_ending = np.bincount(of[units.first_ending :], weights=weight[units.first_ending :], minlength=n_classes)
    closed = by_ending < 0.5 * np.bincount(of, weights=weight, minlength=n_classes)

    chunked = scratch.put(rows.mapInPandas(_number(send((units, of)), n_classes), _CHUNKED), "chunks")
    texts = chunked.where("word IS NULL").select("chunk", "doc_id", "held_out", "tokens", "around")
    local = chunked.where("word IS NOT NULL").select("chunk", "place", "word", "n_train", "around")
    sorted_ = local.where("n_train > 0").select("word", "n_train", "around").repartition("word").sortWithinPartitions("word")
    counts = scratch.put(sorted_.mapInPandas(_assign(send((units, of, class_gains(table, closed))), n_classes), "word string, c long, class int, moved boolean"), "words")
    by_class = counts.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    n_docs = texts.where("NOT held_out").count()
    totals, sizes = np.zeros(n_classes), np.zeros(n_classes)
    for r in by_class:
        totals[r["class"]], sizes[r["class"]] = r["c"], r["n"]
    tokens, distinct = int(totals.sum()) + n_docs, int(sizes.sum()) + (n_docs > 0)
    totals[_END], sizes[_END] = n_docs, 1

    # what a chunk does not know by itself: counts of words that other chunks have, and classes that are not the unit's
    known = local.select("chunk", "place", "word", "n_train").join(counts, "word").where("c <> n_train OR moved").select(F.col("chunk").alias("part"), "place", "c", "class")
    n = max(1, 2 * texts.select("chunk").distinct().count())
    both = texts.repartition(n, "chunk").groupBy("chunk").cogroup(known.repartition(n, "part").groupBy("part"))
    model = send(Model(totals, sizes, tokens, distinct))
    classed = scratch.put(both.applyInPandas(_classed(model, n_classes), _CLASSED), "classes")
    scratch.drop(chunked, counts)
    table = np.zeros((n_classes, n_classes))
    for r in classed.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # classes squared
        table[r["a"], r["b"]] = r["n"]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return classed.where("a IS NULL").mapInPandas(_stepped(send((steps_of(table), tokens))), schema)
