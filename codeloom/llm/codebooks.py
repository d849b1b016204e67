"""Vector codes by weighted Lloyd over distinct parts.

Vectors become integers and are cut into equal parts. Equal parts of one position become a single row with a weight, so
each round reads what is distinct, once; a round's sums are a few numbers an entry. At the end each distinct part has its
code and error, and both are joined back to the vectors: frequent parts by a broadcast of at most 1 / ``HOT_SHARE`` of
them for each position, all others by a shuffle in which no key is frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
HOT_SHARE = 1 / 1024  # of all rows: a key from there on is joined without a shuffle
MOST = (1 << 63) - 1
_CHUNK = 4096  # parts whose distances are held at once


def quantised(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, label, q (floor(scale * x)); rows whose vector is null, or holds a null or non-finite component, are left
    out. A product beyond a long becomes the nearest long."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & fine).select("vec_id", "label", x.alias("q"))


def _parsed(keys) -> tuple[np.ndarray, np.ndarray]:
    """Part numbers and values of keys such as ``3:-12,5``."""
    heads, tails = zip(*(k.split(":") for k in keys), strict=True)
    if not tails[0]:
        return np.array(heads, np.int64), np.zeros((len(tails), 0), np.int64)
    return np.array(heads, np.int64), np.array(",".join(tails).split(","), dtype=np.int64).reshape(len(tails), -1)


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the lowest entry at the least squared distance, and that distance: in doubles where they are exact,
    else in Python's integers."""
    reach = max((max(abs(int(x.min())), abs(int(x.max()))) for x in (values, book) if x.size), default=0)
    kind = np.float64 if reach * reach * max(1, values.shape[1]) < 1 << 50 else object
    codes, errors = [], []
    b = book.astype(kind)
    size = (b * b).sum(axis=1)
    for low in range(0, len(values), _CHUNK):
        v = values[low : low + _CHUNK].astype(kind)
        score = size[None, :] - 2 * (v @ b.T) if v.shape[1] else np.zeros((len(v), len(b)), kind)
        code = score.argmin(axis=1)
        codes.append(code)
        errors.append(score[np.arange(len(v)), code] + (v * v).sum(axis=1))
    return np.concatenate(codes), np.concatenate(errors)


def _summed(books: dict[int, np.ndarray]):
    """Sums and weights of what each entry of each part gets, a few rows a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {p: np.zeros(b.shape, object) for p, b in books.items()}
        counts = {p: np.zeros(len(b), object) for p, b in books.items()}
        for batch in batches:
            if not len(batch):
                continue
            numbers, values = _parsed(batch["key"])
            weights = batch["n"].to_numpy(np.int64)
            for p in np.unique(numbers):
                of = numbers == p
                v, w = values[of], weights[of]
                code, _ = nearest(v, books[p])
                reach = max(abs(int(v.min(initial=0))), abs(int(v.max(initial=0))))
                v = v.astype(np.int64 if reach * int(w.sum()) < 1 << 62 else object) * w[:, None]
                order = np.argsort(code, kind="stable")
                met, begin = np.unique(code[order], return_index=True)
                sums[p][met] += np.add.reduceat(v[order], begin, axis=0)
                counts[p][met] += np.add.reduceat(w[order], begin)
        rows = [(p, e, i, str(t), int(counts[p][e])) for p in books for e in np.flatnonzero(counts[p]).tolist() for i, t in enumerate([0, *sums[p][e]])]
        yield pd.DataFrame(rows, columns=["part", "entry", "place", "total", "n"])

    return run


def _coded(books: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            numbers, values = _parsed(batch["key"])
            batch["code"], batch["error"] = 0, 0
            for p in np.unique(numbers):
                of = np.flatnonzero(numbers == p)
                code, error = nearest(values[of], books[p])
                batch.iloc[of, batch.columns.get_loc("code")] = code
                batch.iloc[of, batch.columns.get_loc("error")] = np.array([min(int(e), MOST) for e in error], np.int64)
            yield batch[["key", "n", "code", "error"]]

    return run


def _matched(rows: DataFrame, table: DataFrame, key: str, least: float) -> DataFrame:
    """``rows`` with the columns of ``table`` (key, n and others) by equal keys, nulls together. Keys with ``least`` rows or
    more are few, so they come by broadcast; the others meet in a shuffle."""
    table = table.withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    hot = F.broadcast(table.where(F.col("n") >= least))
    often = rows.join(hot, same)
    rare = rows.join(F.broadcast(hot.select("_key")), same, "left_anti").join(table.where(F.col("n") < least), same)
    return often.unionByName(rare).drop("_key", "n")


def digest(books: dict[int, np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, as decimals with commas."""
    return hashlib.sha256(",".join(str(int(x)) for p in sorted(books) for x in books[p].ravel()).encode()).hexdigest()


def fit(parts: DataFrame, books: dict[int, np.ndarray], rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Codebooks after some rounds over ``parts`` (key, n): each part goes to its nearest entry, each entry becomes the
    floor of its parts' mean, and entries that get none stay. The driver receives sums only, entries times dimension."""
    for _ in range(rounds):
        sums = parts.mapInPandas(_summed(books), "part int, entry int, place int, total string, n long")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        books = {p: b.copy() for p, b in books.items()}
        for r in sums.where("place > 0").collect():
            books[r["part"]][r["entry"], r["place"] - 1] = int(r["total"]) // r["n"]
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, hot_share: float = HOT_SHARE) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(vec_id, code, error, label_error of ``vectors`` (vec_id, embedding, label); the codebooks by part).

    Rows whose vector is null, or holds a null or non-finite component, are left out. The most frequent length is the
    table's dimension, padded with zeros to a multiple of ``parts``; a vector of another length keeps its row with a null
    code and error. Codebooks start with the smallest vec_ids, null last, and among rows of one id with the smaller parts.
    Repeated rows are rows of their own; fewer vectors than entries give smaller codebooks, an empty table an empty one.
    Errors beyond a long become the largest long. Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    whole = quantised(vectors.select("vec_id", "embedding", "label"), scale)
    lengths = whole.groupBy(F.size("q").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).first()
    dim = lengths["dim"] if lengths else 0
    width = -(-dim // parts)
    padded = F.concat("q", F.array_repeat(F.lit(0).cast("long"), width * parts - dim))
    keys = F.array(*(F.concat(F.lit(f"{p}:"), F.array_join(F.slice(padded, 1 + p * width, width), ",")) for p in range(parts)))
    rows = scratch.put(whole.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.when(F.size("q") == dim, keys).alias("keys")), "vectors")
    coded = rows.where("keys IS NOT NULL")
    distinct = scratch.put(coded.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")), "parts")
    first = coded.orderBy(F.asc_nulls_last("vec_id"), "keys").limit(entries).select("keys").collect()
    books = {p: np.stack([_parsed([r["keys"][p]])[1][0] for r in first]) if first else np.zeros((0, width), np.int64) for p in range(parts)}
    books = fit(distinct, books, rounds)
    least = rows.count() * hot_share
    of_part = scratch.put(distinct.mapInPandas(_coded(books), "key string, n long, code int, error long"), "codes")
    found = _matched(coded.select("rid", F.posexplode("keys").alias("part", "key")), of_part, "key", least)
    found = found.select("rid", F.struct("part", "code").alias("at"), F.col("error").cast("decimal(38,0)").alias("error"))
    every = found.unionByName(rows.select("rid", "vec_id", "label"), allowMissingColumns=True)  # a row's id and label come with its parts
    text = F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda a: F.lpad(F.lower(F.hex(a["code"])), 2, "0")), "")
    held = lambda total: F.when(total > MOST, MOST).otherwise(total).cast("long")
    out = every.groupBy("rid").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), text.alias("code"), F.sum("error").alias("error"))
    out = scratch.put(out.withColumn("code", F.when(F.col("error").isNotNull(), F.col("code"))), "coded")
    scratch.drop(rows, distinct, of_part)
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    labelled = _matched(out, sums, "label", least)
    return labelled.select("vec_id", "code", held(F.col("error")).alias("error"), held(F.col("label_error")).alias("label_error")), books
