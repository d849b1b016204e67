"""Exact top-k by inner product with the three-phase uniform threshold algorithm.

The components of the vectors are split into lists: a list holds each candidate's partial score over its components.
Phase 1 gathers the best entries of each list and only their totals; the k-th best total among what was gathered bounds the k-th of all from
below. Phase 2 sends every query its cutoff: a candidate that can reach the bound has at least one list where its score
over the list's least is the bound's share, and only such entries are collected. Phase 3 resolves their totals exactly,
in the block that collected them, and those that reach the bound are ranked.

Equal vectors are scored once: a class keeps its k + 1 smallest rows, which are all that ties can ask for, and a query
takes its own row out at the end. Queries and classes meet in blocks of bounded size. Products are taken in doubles where
they are exact; vectors of large components get exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

K = 20
LISTS = 2
QUERY_BLOCK = 2048
CLASS_BLOCK = 16384
STRIP = 256  # queries of a block whose scores are held at once
MOST = 1 << 60  # of a product of narrow vectors; sums of a few stay 64-bit numbers
LEAST_LONG, LARGEST_LONG = -(1 << 63), (1 << 63) - 1
_GATHERED = "query long, class long, list int, score long, least long, total long"
_RESOLVED = "query long, class long, score long"


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, rid (a number of the row) and q, the components as floor(scale * x); rows with a null or non-finite
    component, or a null, take no part."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select("vec_id", F.monotonically_increasing_id().alias("rid"), x.alias("q"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.empty((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices of narrow vectors. Rows that could take a sum of doubles beyond
    2**53 are multiplied as Python's integers."""
    safe = 2.0 ** 26 / max(1.0, a.shape[1]) ** 0.5
    wide_a, wide_b = (np.abs(x.astype(np.float64)).max(axis=1, initial=0.0) >= safe for x in (a, b))
    narrow = [np.where(w[:, None], 0, x).astype(np.float64) for x, w in ((a, wide_a), (b, wide_b))]
    out = (narrow[0] @ narrow[1].T).astype(np.int64)
    exact = lambda x, y: (x.astype(object) @ y.astype(object).T).astype(np.int64)
    if wide_a.any():
        out[wide_a] = exact(a[wide_a], b)
    if wide_b.any():
        out[:, wide_b] = exact(a, b[wide_b])
    return out


def _strips(queries: pd.DataFrame, classes: pd.DataFrame, lists: int):
    """Some queries at a time: their rows, and the partial scores of each list, (queries, classes)."""
    a, b = _matrix(queries["q"]), _matrix(classes["q"])
    parts = np.array_split(np.arange(a.shape[1]), lists)
    for low in range(0, len(a), STRIP):
        yield queries.iloc[low : low + STRIP], [products(a[low : low + STRIP, part], b[:, part]) for part in parts]


def _gather(k: int, lists: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["query", "class", "list", "score", "least", "total"])]
        if len(left) and len(right):
            names = right["class"].to_numpy()
            for asked, parts in _strips(left, right, lists):
                for i, s in enumerate(parts):
                    n = min(k, s.shape[1])
                    top = np.argpartition(s, s.shape[1] - n, axis=1)[:, -n:]
                    took = lambda x, top=top: np.take_along_axis(x, top, 1).ravel()
                    out.append(pd.DataFrame({"query": np.repeat(asked["query"].to_numpy(), n), "class": names[top].ravel(), "list": i, "score": took(s), "least": np.repeat(s.min(axis=1), n), "total": sum(took(x) for x in parts)}))
        return pd.concat(out[1:] or out)

    return run


def _resolve(lists: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["query", "class", "score"])]
        if len(left) and len(right):
            names = right["class"].to_numpy()
            for asked, parts in _strips(left, right, lists):
                least = np.stack(asked["least"].to_numpy()).astype(np.int64)
                # an entry is collected where one list's score alone, over that list's least, is its share of the cutoff
                reached = np.zeros(parts[0].shape, bool)
                for i, s in enumerate(parts):
                    reached |= s >= (least[:, i] + asked["share"].to_numpy())[:, None]
                row, col = np.nonzero(reached)
                total = sum(s[row, col] for s in parts)
                stays = total - least.sum(axis=1)[row] >= asked["reach"].to_numpy()[row]
                out.append(pd.DataFrame({"query": asked["query"].to_numpy()[row[stays]], "class": names[col[stays]], "score": total[stays]}))
        return pd.concat(out[1:] or out)

    return run


def _all_products(k: int):
    """The k best classes of each query of a block, and all that tie with the last of them, by Python's integers."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            a, b, names = _matrix(left["q"]).astype(object), _matrix(right["q"]).astype(object), right["class"].to_numpy()
            for query, x in zip(left["query"], a, strict=True):
                scores = [min(max(int(v), LEAST_LONG), LARGEST_LONG) for v in b @ x]
                least = sorted(scores)[-min(k, len(scores))]
                rows += [(query, name, v) for name, v in zip(names, scores, strict=True) if v >= least]
        return pd.DataFrame(rows, columns=["query", "class", "score"])

    return run


def _wide(q):
    """Whether products with a vector of this kind could leave ``MOST``."""
    reach = F.greatest(F.array_max(q).cast("double"), -F.array_min(q).cast("double"))
    return F.coalesce(reach > (F.lit(float(MOST)) / F.greatest(F.size(q), F.lit(1))) ** 0.5, F.lit(False))


def _bounds(sums: DataFrame, k: int) -> DataFrame:
    """(query, bound): the k-th best ``s`` of each query, null if it has fewer."""
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s")))).where(f"rank <= {k}")
    return ranked.groupBy("query").agg(F.when(F.count("*") >= k, F.min("s")).alias("bound"))


def top_k(vectors: DataFrame, queries, k: int = K, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) that fulfils ``queries`` the k other
    rows of the highest scores, ties to the smaller vec_id.

    Vectors meet those of their own length only. Rows that repeat an id are rows of their own, as candidates and as
    queries. A table without fitting rows gives no rows, and a query with fewer candidates returns all of them. Scores are
    exact: wide vectors, whose products could be too large for the lists, are multiplied with all others in Python's
    integers; a component or score beyond a long becomes the nearest long. Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.put(quantised(vectors.select("vec_id", "embedding")), "vectors")
    # of each distinct vector the k + 1 smallest rows; the window drops the rest before it shuffles
    small = rows.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("vec_id", "rid"))).where(f"n <= {k + 1}")
    members = F.sort_array(F.collect_list(F.struct("vec_id", "rid"))).alias("members")
    classes = scratch.put(small.groupBy("q").agg(F.min("rid").alias("class"), members).withColumns({"dim": F.size("q"), "wide": _wide(F.col("q"))}), "classes")
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), F.col("rid").alias("own"), F.xxhash64("q").alias("hash"), "q")
    # one query for equal vectors: the class is scored, and each of its rows takes itself out
    named = asked.join(classes.select(F.xxhash64("q").alias("hash"), F.col("q").alias("same"), F.col("class").alias("query")), "hash")
    named = scratch.put(named.where("q = same").select("query_id", "own", "query"), "named")
    wanted = classes.join(named.select("query").distinct(), F.col("class") == F.col("query"), "left_semi").select(F.col("class").alias("query"), "q", "dim", "wide")
    wanted = scratch.put(wanted, "wanted")
    n_query = max(1, -(-wanted.count() // QUERY_BLOCK))
    n_class = max(1, -(-classes.count() // CLASS_BLOCK))
    need = k + 1  # the class of the query itself may be one of the best

    def blocks(df: DataFrame, key: str, mine: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))

    def meet(asking: DataFrame, how, schema: str, others: str = "NOT wide"):
        left = blocks(asking, "query", "qb", n_query, "cb", n_class)
        right = blocks(classes.where(others).select("class", "q", "dim"), "class", "cb", n_class, "qb", n_query)
        return left.groupBy("qb", "cb", "dim").cogroup(right.groupBy("qb", "cb", "dim")).applyInPandas(how, schema)

    narrow = wanted.where("NOT wide").select("query", "q", "dim")
    local = scratch.put(meet(narrow, _gather(need, lists), _GATHERED), "local")
    floor = local.groupBy("query", "list").agg(F.min("least").alias("low"))
    lows = floor.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("list", "low"))), lambda s: s["low"]).alias("least"), F.sum("low").alias("base"))
    cutoff = _bounds(local.select("query", "class", F.col("total").alias("s")).distinct(), need)
    # over the lists' least scores; a query with too few candidates takes them all
    asking = narrow.join(lows, "query").join(cutoff, "query").withColumn("reach", F.greatest(F.coalesce(F.col("bound") - F.col("base"), F.lit(0)), F.lit(0)))
    asking = asking.select("query", "q", "dim", "least", "reach", F.expr(f"reach div {lists}").alias("share"))
    scored = meet(asking, _resolve(lists), _RESOLVED)
    if not classes.where("wide").isEmpty():
        scored = scored.unionByName(meet(narrow, _all_products(need), _RESOLVED, "wide"))
        scored = scored.unionByName(meet(wanted.where("wide").select("query", "q", "dim"), _all_products(need), _RESOLVED, "true"))
    # the best k + 1 classes are enough, ties to that of the smallest row; they are opened into rows
    ranked = scored.join(classes.select("class", "members"), "class")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.get("members", F.lit(0)))
    ranked = ranked.withColumn("n", F.row_number().over(best)).where(f"n <= {need}")
    opened = ranked.select("query", "score", F.explode("members").alias("m")).select("query", "score", "m.*")
    opened = opened.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rid"))).where(f"n <= {need}")
    out = named.join(opened.select("query", "score", "vec_id", "rid"), "query").where("own <> rid")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "rid"))).where(f"rank <= {k}")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
