"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns find emails, addresses, cards and phones in linear time. Around each token with a digit or an at sign, a
semi-Markov field chooses segment boundaries and types together: every candidate segment of a bounded number of atoms
has features of the whole span (its shape, digit counts, checks such as Luhn's, and the words around it), label
transitions join segments, and dynamic programming over all segmentations gives the best one. Text between these places
has no digit and no at sign, where only the outside label is possible, so leaving it out changes nothing.

The field is trained here by gradient ascent on the segmentation likelihood, on places of a bounded sample of the rows,
marked by the patterns, and on made-up variants that the patterns miss: secrets, spelt-out emails, other phone forms.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
SAMPLE_ROWS = 4000  # rows from which places are taken for training, about
PLACES = 400  # places of them, and as many made-up ones
EPOCHS = 6
LONGEST = 16  # atoms of a segment
MOST_WORDS = 8  # of them without a digit or sign: no kind has more
MOST_DIGITS = 24  # of a segment of several atoms: no kind has more
BLOCK = 512  # atoms whose segments are held at once while a stretch is decoded
EXAMPLE_CHARS, EXAMPLE_ATOMS = 800, 150  # of a training example at most
BUCKETS = 1 << 13
MARGIN = 2.0  # log-odds over the best segmentation without the span
SEED = 5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[\[(]at[\])]")
_PLACE = re.compile(r"(?<!\S)(?:[^\s0-9@\[(]++|[\[(](?!at[\])]))*+(?:[0-9@]|[\[(]at[\])])\S*+")
_ATOM = re.compile(r"[A-Za-z0-9]+|[^\W_]+|\S|_")
_HEX = re.compile(r"[0-9a-fA-F]+")


def luhn(digits: str) -> bool:
    """Luhn's check sum over decimal digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost non-overlapping matches of each kind that pass its check."""
    if not text:
        return []
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def places(text: str) -> list[tuple[int, int]]:
    """Stretches around tokens with a digit or an at sign, with some words on both sides; near ones are joined."""
    out: list[list[int]] = []
    for m in _PLACE.finditer(text):
        low, high = max(0, m.start() - 40), min(len(text), m.end() + 40)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % BUCKETS


class Lattice:
    """Candidate segments of a stretch: (start atom, end atom) and the features of each. The outside label takes single
    atoms; other labels take segments of up to ``LONGEST`` atoms, ``MOST_WORDS`` words and ``MOST_DIGITS`` digits on one
    line with a digit or an at sign."""

    def __init__(self, text: str, whole: bool = True):
        self.text = text
        self.atoms = [(m.start(), m.end()) for m in _ATOM.finditer(text)]
        self.words = [text[a:b] for a, b in self.atoms]
        self.sign = [w in "@" or any("0" <= c <= "9" for c in w) for w in self.words]
        self.gap = [""] + [text[self.atoms[i - 1][1] : self.atoms[i][0]] for i in range(1, len(self.words))]
        self.segments, self.features = self.between(0, len(self.words)) if whole else ([], [])

    def between(self, low: int, high: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
        """The segments that start at atoms low to high, and their features."""
        segments, features, words, gap = [], [], self.words, self.gap
        for i in range(low, high):
            word, before, alpha, digits = words[i], (words[i - 1].lower() if i else "^"), 0, 0
            for j in range(i + 1, min(len(words), i + LONGEST) + 1):
                last = words[j - 1]
                if j > i + 1 and ("\n" in gap[j - 1] or len(gap[j - 1]) > 1):
                    break
                if last.isalpha():
                    alpha += 1
                    if alpha > MOST_WORDS:
                        break
                digits += len(_digits(last))
                if digits > MOST_DIGITS and j > i + 1:
                    break
                has = any(self.sign[i:j]) or "at" in words[i:j]
                ends = last[-1].isalnum() and (word[0].isalnum() or word in "+(")
                if j == i + 1 or (has and ends):
                    segments.append((i, j))
                    features.append(self._span(self.text, words, gap, i, j, before))
        return segments, features

    def _span(self, text: str, words: list[str], gap: list[str], i: int, j: int, before: str) -> list[int]:
        span = text[self.atoms[i][0] : self.atoms[j - 1][1]]
        digits = _digits(span)
        shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "0", span))
        sized = re.sub(r"[0-9]+", lambda m: f"<{min(len(m[0]), 20)}>", re.sub(r"[^\W\d_]+", "a", span))
        after = words[j].lower() if j < len(words) else "$"
        lone = words[i] if j == i + 1 else ""
        hexed = bool(lone) and len(lone) >= 16 and bool(_HEX.fullmatch(lone)) and not lone.isdigit()
        found = [
            "bias", f"n{j - i}", f"shape {shape[:40]}", f"sized {sized[:60]}", f"digits {min(len(digits), 25)}",
            f"card {13 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in span)}",
            f"ip {bool(_IP.fullmatch(span)) and all(len(p) <= 3 and int(p) <= 255 for p in span.split('.'))}",
            f"email {bool(re.fullmatch(r'[A-Za-z0-9._%+-]+(?:@| ?[\[(]at[\])] ?| at )[A-Za-z0-9-]+(?:(?:\.| dot )[A-Za-z0-9-]+)+', span))}",
            f"hex {hexed} {min(len(lone) // 8, 6) if hexed else 0}", f"plus {span[0] == '+'} {min(len(digits), 16)}",
            f"before {before}", f"before {before} n{min(len(digits), 16)}", f"after {after}", f"glued {i > 0 and not gap[i]} {j < len(words) and not gap[j]}",
            f"quoted {before in chr(34) + chr(39)} {after in chr(34) + chr(39)}", f"alpha {sum(w.isalpha() for w in words[i:j])}",
        ]
        return [_bucket(f) for f in found]


class Model:
    """Weights of span features (buckets, labels) and of label transitions; label 0 is outside."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def scores(self, segments: list[tuple[int, int]], features: list[list[int]]) -> np.ndarray:
        s = self.weights[np.array(features)].sum(axis=1)
        length = np.array([j - i for i, j in segments])
        s[length > 1, 0] = -1e9
        s[:, 1:] -= 1e-3 * length[:, None]
        return s

    def forward(self, lattice: Lattice, s: np.ndarray):
        """Sums of scores of the segmentations up to each atom, by the label of the last segment."""
        n, width = len(lattice.atoms), s.shape[1]
        upto = np.full((n + 1, width), -1e9)
        upto[0, 0] = 0.0
        through = np.full((n + 1, width), -1e9)
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j) in enumerate(lattice.segments):
            by_end[j].append(k)
        begins = np.array([i for i, _ in lattice.segments])
        through[0] = self.steps[0]
        for j in range(1, n + 1):
            ks = by_end[j]
            upto[j] = np.logaddexp.reduce(through[begins[ks]] + s[ks], axis=0)
            through[j] = np.logaddexp.reduce(upto[j][:, None] + self.steps, axis=0)
        return upto, through, by_end

    def decode(self, text: str) -> list[tuple[str, int, int]]:
        """The best segmentation's spans that beat the best outside reading of the same atoms by ``MARGIN``.

        Maxima are carried from atom to atom, and segments are made for some atoms at a time: of the whole text only a few
        numbers an atom are held, so a text of any length is decoded as one.
        """
        lattice = Lattice(text, whole=False)
        n, width = len(lattice.atoms), len(self.steps)
        if not n:
            return []
        upto = np.full((n + 1, width), -1e9)
        upto[0, 0] = 0.0
        taken = np.zeros((n + 1, width))  # the score of the segment that ends best here, and its length
        length = np.zeros((n + 1, width), np.int8)
        outside = np.zeros(n + 1)
        for low in range(0, n, BLOCK):
            segments, features = lattice.between(low, min(n, low + BLOCK))
            s = self.scores(segments, features)
            at = 0
            while at < len(segments):
                i, end = segments[at][0], at
                while end < len(segments) and segments[end][0] == i:
                    end += 1
                ends, own = np.array([j for _, j in segments[at:end]]), s[at:end]
                through = (upto[i][:, None] + self.steps).max(axis=0) if i else self.steps[0]
                better = through + own > upto[ends]
                upto[ends] = np.where(better, through + own, upto[ends])
                taken[ends] = np.where(better, own, taken[ends])
                length[ends] = np.where(better, (ends - i)[:, None], length[ends])
                outside[i + 1] = own[0, 0] + self.steps[0, 0]  # the first segment is the atom by itself
                at = end
        outside = np.cumsum(outside)
        out, j, label = [], n, int(upto[-1].argmax())
        while j > 0:
            i = j - int(length[j, label])
            before = int((upto[i] + self.steps[:, label]).argmax()) if i else 0
            if label and taken[j, label] + self.steps[before, label] + self.steps[label, 0] - self.steps[0, 0] - (outside[j] - outside[i]) >= MARGIN:
                out.append((KINDS[label - 1], lattice.atoms[i][0], lattice.atoms[j - 1][1]))
            j, label = i, before
        return out[::-1]


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit on (text, spans) by stochastic gradient ascent; spans that are not candidate segments are left out, and so are
    examples of more than ``EXAMPLE_ATOMS`` atoms."""
    width, rng = len(KINDS) + 1, np.random.default_rng(seed)
    model = Model(np.zeros((BUCKETS, width)), np.zeros((width, width)))
    grown, grown_s = np.full_like(model.weights, 1e-4), np.full_like(model.steps, 1e-2)
    ready = []
    for text, spans in examples:
        lattice = Lattice(text)
        if not lattice.atoms or len(lattice.atoms) > EXAMPLE_ATOMS:
            continue
        place = {(lattice.atoms[i][0], lattice.atoms[j - 1][1]): k for k, (i, j) in enumerate(lattice.segments)}
        single = {i: k for k, (i, j) in enumerate(lattice.segments) if j == i + 1}
        gold, i = [], 0
        starts = {lattice.segments[place[a, b]][0]: (place[a, b], KINDS.index(kind) + 1) for kind, a, b in spans if (a, b) in place}
        while i < len(lattice.atoms):
            k, label = starts.get(i, (single[i], 0))
            gold.append((k, label))
            i = lattice.segments[k][1]
        ready.append((lattice, gold))
    for _ in range(epochs):
        for at in rng.permutation(len(ready)).tolist():
            lattice, gold = ready[at]
            s = model.scores(lattice.segments, lattice.features)
            upto, through, by_end = model.forward(lattice, s)
            n = len(lattice.atoms)
            behind = np.full((n + 1, width), -1e9)  # what may follow, by the label before
            behind[n] = 0.0
            total = np.logaddexp.reduce(upto[n])
            after = np.full((n + 1, width), -1e9)  # what may follow from a start, by the label that starts
            marginal = np.zeros_like(s)
            by_start: list[list[int]] = [[] for _ in range(n)]
            for k, (i, _) in enumerate(lattice.segments):
                by_start[i].append(k)
            ends = np.array([j for _, j in lattice.segments])
            for i in range(n - 1, -1, -1):
                ks = by_start[i]
                onward = s[ks] + behind[ends[ks]]
                after[i] = np.logaddexp.reduce(onward, axis=0)
                behind[i] = np.logaddexp.reduce(self_steps(model, after[i]), axis=1)
                marginal[ks] = np.exp(np.minimum(0, through[i] + onward - total))
            expected = np.zeros_like(model.steps)
            for i in range(n):
                expected += np.exp(np.minimum(0, upto[i][:, None] + model.steps + after[i][None, :] - total))
            delta, taken = -marginal, np.zeros_like(model.steps)
            before = 0
            for k, label in gold:
                delta[k, label] += 1.0
                taken[before, label] += 1.0
                before = label
            gradient = np.zeros_like(model.weights)
            rows = np.array(lattice.features)
            np.add.at(gradient, rows.ravel(), np.repeat(delta, rows.shape[1], axis=0))
            used = np.unique(rows)
            g = gradient[used] - 1e-3 * model.weights[used]
            grown[used] += g**2
            model.weights[used] += 0.3 * g / np.sqrt(grown[used])
            g = taken - expected - 1e-3 * model.steps
            grown_s += g**2
            model.steps += 0.1 * g / np.sqrt(grown_s)
    return model


def self_steps(model: Model, after: np.ndarray) -> np.ndarray:
    return model.steps + after[None, :]


def _made_up(rng: random.Random, words: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """A stretch of given words around one made-up span, or around a number that is none."""
    pick = lambda: rng.choice(words)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    host = f"{pick().lower()}{rng.choice(['', num(1)])}.{rng.choice(['example', 'mail', 'net'])}.{rng.choice(['com', 'org', 'de', 'fr'])}"
    name = rng.choice([pick().lower(), pick().lower() + "." + pick().lower(), pick().lower() + num(2)])
    kind = rng.choice(["secret", "secret", "email", "email", "phone", "phone", "card", "ip", "none", "none", "none"])
    lead = ""
    if kind == "secret":
        value = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 32, 40, 48, 64])))
        lead = rng.choice(['token = "', 'api_key="', "secret: ", "password: ", "key = ", 'token: "'])
        body, close = value, '"' if lead.endswith('"') else ""
    elif kind == "email":
        body, close = rng.choice([f"{name}@{host}", f"{name} [at] {host}", f"{name} (at) {host}", f"{name}[at]{host}"]), ""
    elif kind == "phone":
        body, close = rng.choice([f"+{num(2)} {num(3)} {num(4)} {num(3)}", f"({num(3)}) 555-{num(4)}", f"+1 ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)}-{num(3)}-{num(6)}"]), ""
        lead = rng.choice(["", "call ", "phone: ", "tel. "]) if body[0] == "+" else rng.choice(["call ", "phone: ", "tel. ", "Tel: "])
    elif kind == "card":
        while not luhn(body := "4" + num(15)):
            pass
        body, close = rng.choice([body, " ".join(body[i : i + 4] for i in range(0, 16, 4)), "-".join(body[i : i + 4] for i in range(0, 16, 4))]), ""
    elif kind == "ip":
        body, close = ".".join(str(rng.randint(0, 255)) for _ in range(4)), ""
    else:
        while luhn(long := num(rng.choice([13, 16, 16, 19]))):
            pass
        body = rng.choice([long, f"20{num(2)}-0{num(1)}-1{num(1)}", f"{num(2)}:{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(2)}.{num(2)}", num(rng.randint(1, 8)), f"${num(3)}.{num(2)}", f"@{pick().lower()}", f"{num(1)},{num(3)},{num(3)}", f"300.{num(3)}.{num(2)}.999", f"/{pick().lower()}/{num(4)}"])
        close = ""
    left = " ".join(pick() for _ in range(rng.randint(1, 5))) + rng.choice([" ", " ", ": ", "\n", ", "]) + lead
    text = left + body + close + rng.choice([" ", " ", ". ", "\n", ", "]) + " ".join(pick() for _ in range(rng.randint(1, 4)))
    return text, [] if kind == "none" else [(kind, len(left), len(left) + len(body))]


_NAMED = re.compile(r"""(?:token|key|secret|password)["']?\s*[:=]\s*["']?([A-Za-z0-9]{16,})""")


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Some places of each text, with the spans that the fixed patterns and named secrets give."""
    for batch in batches:
        rows = []
        for key, text in zip(batch["hash"], batch["text"], strict=True):
            for number, (low, high) in enumerate(places(text)[:4]):
                while low and not text[low - 1].isspace():
                    low -= 1
                piece = text[low : min(high, low + EXAMPLE_CHARS)]
                spans = base_spans(piece) + [("secret", m.start(1), m.end(1)) for m in _NAMED.finditer(piece)]
                rows.append((key, number, piece, [{"kind": k, "start": a, "end": b} for k, a, b in spans]))
        yield pd.DataFrame(rows, columns=["hash", "number", "piece", "spans"])


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, n_places: int = PLACES, seed: int = SEED) -> Model:
    """Train on ``n_places`` places of about ``rows`` rows, chosen by a hash of their text, and on as many made-up
    stretches. Only the places come to the driver."""
    share = min(1.0, rows / max(1, docs.count()))
    hashed = docs.select("text", F.xxhash64("text", F.lit(seed)).alias("hash"))
    drawn = hashed.where(F.pmod("hash", F.lit(1_000_000)) < share * 1_000_000).where(F.col("text").rlike("[0-9@]"))
    found = drawn.mapInPandas(_examples, "hash long, number int, piece string, spans array<struct<kind:string,start:int,end:int>>")
    chosen = found.orderBy("hash", "number", "piece").limit(n_places).collect()
    examples, words = [], ["the", "of", "and", "mail", "contact", "order", "room"]
    for r in chosen:
        examples.append((r["piece"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]))
        words += re.findall(r"[^\W\d_]+", r["piece"])[:4]
    rng = random.Random(seed)
    return train(examples + [_made_up(rng, words) for _ in range(n_places)])


def all_spans(text: str | None, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the fixed patterns, and those that the field adds: none of them overlaps a fixed one."""
    base = base_spans(text)
    if not text or not _ANY.search(text):
        return base, []
    taken = sorted((a, b) for _, a, b in base)
    added, at, least = [], 0, 0
    for low, high in places(text):
        while low > least and not text[low - 1].isspace():  # from the start of a word
            low -= 1
        least = high
        for kind, a, b in model.decode(text[low:high]):
            a, b = a + low, b + low
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if not any(x < b and a < y for x, y in taken[max(0, at - 4) : at + 4]):
                added.append((kind, a, b))
    return base, added


def written(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _finder(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, added = all_spans(text, shared.value)
                spans = [{"kind": k, "start": a, "end": b, "fixed": fixed} for found, fixed in ((base, True), (added, False)) for k, a, b in found]
                rows.append((spans, written(base), written(base + added)))
            out = pd.DataFrame(rows, columns=["found", "base", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return run


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, found (array of kind, start, end, fixed), base and spans (written out) of each row of ``docs`` (doc_id,
    text). Offsets are code points, ends are exclusive. A null or empty text has no spans; repeated rows come back once
    each; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * labels numbers
    return docs.select("doc_id", "text").mapInPandas(_finder(shared), "doc_id long, found array<struct<kind:string,start:long,end:long,fixed:boolean>>, base string, spans string")


def masked_text(text: str | None, model: Model) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    if not text:
        return text
    base, added = all_spans(text, model)
    out, at = [], 0
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _masker(shared, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [masked_text(t, shared.value) for t in batch["text"]]
            if "n_chars" in columns:
                batch["n_chars"] = pd.array([None if t is None else len(t) for t in batch["text"]], "Int64")
            yield batch[columns]

    return run


def mask(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the spans of ``text`` masked and ``n_chars``, where there is one, counted again. Null and empty texts
    stay as they are (n_chars null and 0), repeated rows come back once each, an empty table gives an empty one, and other
    columns are unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInPandas(_masker(shared, docs.columns), docs.schema)
