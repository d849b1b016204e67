"""MinHash near-duplicate detection with tensored banding.

Classic banding needs ``tables * rows`` minhashes a document. Here two small collections of half-keys are
sketched, and every pair of one half-key from each collection names a table: ``half * half`` tables come from
only ``2 * half * rows`` minhashes, about the square root of the work. A pair of documents meets in some table
exactly when it shares a half-key in both collections. There are as many half-keys of three minhashes each as make that
fail with a probability of at most 1.5e-4 at the threshold, and much less for closer pairs: 10 + 10 at 0.85, 14 + 14 at
0.80. Half-keys that one document has alone are left out before they are paired, so only documents that resemble another
open tables.

Candidates must agree in a number of minhashes that is six standard deviations below what the threshold predicts,
which a pair at the threshold misses with a probability below 1e-7, and are then verified on the full shingle sets.
The members of a table are first compared with its smallest member only, which joins most groups at once. Members that
stay apart meet a few landmarks of their table's largest component, where it has several members there. What is even then in different components, among
members of like size, is joined by the prefixes of the shingle sets where it shares a table, so no link of the tables
is lost and no table is opened into its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks, mix64, word_hashes

SHINGLE = 5
HALF_KEYS = 10  # of each collection, at least
MISS = 1.5e-4  # probability that a pair at the threshold shares no table, at most
ROWS = 3
HEAD = 16  # rarest shingles of a set that its later ones carry, so that most pairs come once; pairs are distinct in any case
LANDMARKS = 4  # of a component that has as many members in a table at least
_FACTORS = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def half_keys_at(percent: int) -> int:
    """Half-keys of a collection that miss a pair at the threshold with a probability of at most ``MISS``."""
    count = HALF_KEYS
    while 2 * (1 - (percent / 100) ** ROWS) ** count > MISS:
        count += 1
    return count


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Of each lower-case text the sorted distinct 64-bit hashes of its five-word shingles: of a shorter one the hash of
    all its words, and none without words."""
    codes, at = word_hashes(texts)
    total = np.zeros(max(0, len(codes) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        total += _FACTORS[i] * codes[i : i + len(total)]
    total = mix64(total)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= SHINGLE:
            s = np.sort(total[lo : hi - SHINGLE + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif hi > lo:
            out.append(mix64(np.sum(_FACTORS[: hi - lo] * codes[lo:hi], keepdims=True) + np.uint64(hi - lo)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def half_keys(sets: list[np.ndarray], count: int = HALF_KEYS) -> tuple[np.ndarray, np.ndarray]:
    """Half-keys of non-empty sets, one row each, first those of collection A and then of B: ``ROWS`` minhashes, hashed
    with their place; and the low 16 bits of each minhash. The minhashes are minima of random linear permutations of
    32-bit codes."""
    codes = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    begin = np.cumsum([0] + [len(s) for s in sets])[:-1]
    step = np.empty_like(codes)
    seeds = mix64(np.arange(1000, 1000 + 2 * count * ROWS, dtype=np.uint64)) | np.uint64(1)
    keys = np.tile(np.arange(2 * count, dtype=np.uint64), (len(sets), 1))
    low = np.empty((len(sets), 2 * count * ROWS), np.uint16)
    for place in range(2 * count):
        for row in range(ROWS):
            seed = seeds[place * ROWS + row]
            np.multiply(codes, np.uint32(seed & np.uint64(0xFFFFFFFF)) | np.uint32(1), out=step)
            np.bitwise_xor(step, np.uint32(seed >> np.uint64(32)), out=step)
            least = np.minimum.reduceat(step, begin)
            low[:, place * ROWS + row] = least & np.uint32(0xFFFF)
            keys[:, place] = mix64(keys[:, place] * np.uint64(0x9E3779B97F4A7C15) + least)
    return keys.view(np.int64), low


def _sketch(count: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, texts in chunks(batch["text"]):
                with np.errstate(over="ignore"):
                    sets = shingle_sets(texts)
                    full = [s for s in sets if len(s)]
                    keys = iter(zip(*half_keys(full, count), strict=True) if full else ())
                rows = []
                for s in sets:
                    k, low = next(keys) if len(s) else (np.empty(0, np.int64), np.empty(0, np.uint16))
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), k, low.tobytes()))
                out = pd.DataFrame(rows, columns=["n_shingles", "fp", "half", "low"])
                part = batch.iloc[first : first + len(texts)]
                out.insert(0, "uid", part["uid"].to_numpy())
                out.insert(0, "doc_id", part["doc_id"].astype("Int64").array)
                yield out

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for first, texts in chunks(batch["text"]):
            with np.errstate(over="ignore"):
                sets = shingle_sets(texts)
            yield pd.DataFrame({"cid": batch["cid"].to_numpy()[first : first + len(texts)], "items": [s.tobytes() for s in sets]})


def _agreeing(percent: int):
    n, p = 2 * half_keys_at(percent) * ROWS, percent / 100
    least = max(0, int(n * p - 6 * (n * p * (1 - p)) ** 0.5))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, n) for c in ("low_a", "low_b"))
            yield batch.loc[(a == b).sum(axis=1) >= least, ["a", "b"]]

    return run


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (one, two) in enumerate(zip(batch["items_a"], batch["items_b"], strict=True)):
                s, t = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                both = int(np.count_nonzero(t[np.minimum(at, len(t) - 1)] == s))
                keep[i] = 100 * both >= percent * (len(s) + len(t) - both)
            yield batch.loc[keep, ["a", "b"]]

    return run


def linked(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: those of like size whose minhashes agree often enough are compared by their full
    sets. b may be one centre of very many pairs: the joins meet exchanges on both sides, so Spark can split that key."""
    one, two = (classes.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("low").alias(f"low_{x}")) for x in ("a", "b"))
    like = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    near = pairs.join(one, "a").join(two.withColumnRenamed("b", "other"), (F.col("b") == F.col("other")) & like)
    near = near.select("a", "b", "low_a", "low_b").mapInPandas(_agreeing(percent), "a long, b long")
    for x in ("a", "b"):
        near = near.join(sets.select(F.col("cid").alias(x), F.col("items").alias(f"items_{x}")), x)
    return near.mapInPandas(_verify(percent), "a long, b long")


def components(links: DataFrame, scratch: Scratch, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) of each node of the links (a, b) and of the former ``labels``, which the links join further.

    In each round a node and its neighbours are contracted into the least of them, in an order that changes with the
    round, so long chains shrink by a constant factor; links inside one node go, and no links end the rounds."""
    edges = links
    if labels is not None:
        for side in ("a", "b"):
            name = labels.select(F.col("node").alias(side), "label")
            edges = edges.join(name, side, "left").withColumn(side, F.coalesce("label", side)).drop("label")
    merged, turn = None, 0
    while True:
        order = F.lit(int(mix64(np.array([turn], np.uint64))[0] >> np.uint64(1)))
        ends = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.min(F.col("b").bitwiseXOR(order)), F.col("a").bitwiseXOR(order)).bitwiseXOR(order)
        round_ = scratch.put(ends.groupBy("a").agg(least.alias("label")).select(F.col("a").alias("node"), "label"), "round")
        for side in ("a", "b"):
            edges = edges.join(round_.select(F.col("node").alias(side), F.col("label").alias(f"to_{side}")), side)
        edges = edges.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        edges = scratch.put(edges, "edges")
        merged, turn = round_ if merged is None else _after(merged, round_), turn + 1
        if edges.isEmpty():
            break
    if labels is not None:
        merged = _after(labels, merged).unionByName(merged.join(labels.select("node"), "node", "left_anti"))
    return scratch.put(merged, "labels")


def _after(labels: DataFrame, moved: DataFrame) -> DataFrame:
    to = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def _mixed(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """key, cid of the tables (key, cid, n) whose members lie in several components. Tables are divided by size: each
    member goes to two neighbouring classes of sizes, so that any two whose sizes allow a link meet in one."""
    found = _labelled(members, labels)
    open_ = found.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    like = F.floor(F.log("n") / (np.log(100 / percent) * 1.000001)) if percent < 100 else F.col("n")
    sized = members.join(open_, "key").withColumn("size", F.explode(F.array(like, like + 1)))
    return sized.select(F.xxhash64("key", "size").alias("key"), "cid")


def _placed(mixed: DataFrame, labels: DataFrame) -> DataFrame:
    """key, cid, label, and the most frequent label (main) with its members (held) of the tables with several labels."""
    found = _labelled(mixed, labels)
    counts = found.groupBy("key", "label").agg(F.count("*").alias("n"))
    mains = counts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1")
    return found.join(mains.select("key", F.col("m.label").alias("main"), F.col("m.n").alias("held")), "key")


def _explode_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 200):
            part = batch.iloc[at : at + 200]
            sets = [np.frombuffer(s, np.int64) for s in part["items"]]
            sizes = np.array([len(s) for s in sets])
            repeat = lambda column, part=part, sizes=sizes: np.repeat(part[column].to_numpy(), sizes)
            yield pd.DataFrame({"cid": repeat("cid"), "label": repeat("label"), "size": np.repeat(sizes, sizes), "token": np.concatenate(sets)})


def _prefix_pairs(apart: DataFrame, classes: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among ``apart`` (cid, label) that share a table and can be linked.

    A shingle that lies in one component only cannot be in two sets that are still apart; ``own`` counts those of a set.
    With shingles in one order, here these first and then the rarest, two sets that are similar enough share one of the
    first ``n - ceil(n * percent / 100) + 1``, at places after which enough shingles are left. A set whose own shingles
    fill that prefix is linked with nothing, and without it more shingles lie in one component, so that is done twice.
    Of each shingle only those outside its most frequent component are paired."""
    tokens = scratch.put(sets.join(apart, "cid").select("cid", "label", "items").mapInPandas(_explode_sets, "cid long, label long, size long, token long"), "tokens")
    prefix = f"size - ceil(size * {percent} / 100.0) + 1"
    for _ in range(2):  # what the second round left out cannot be linked, so its counts stay good for the rest
        seen = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token", "df")
        shared = scratch.put(tokens.select("cid", "label", "size", "token").join(seen, "token"), "shared")
        scratch.drop(tokens)
        own = shared.groupBy("cid", "size").agg((F.col("size") - F.count("*")).alias("own")).where(f"own < {prefix}").select("cid", "own")
        tokens = scratch.put(shared.join(own, "cid"), "tokens")
        scratch.drop(shared)
    # shingles of one passage lie in the same sets; the first of them in the order stands for all, and is in every prefix that
    # has one of them, so a pair meets once for a passage
    lists = tokens.groupBy("token").agg(F.min("df").alias("df"), F.count("*").alias("m"), *(F.bit_xor(F.xxhash64("cid", F.lit(i))).alias(f"x{i}") for i in range(2)))
    stands = lists.groupBy("m", "x0", "x1").agg(F.min(F.struct("df", "token")).alias("t")).select("t.token")
    order = Window.partitionBy("cid").orderBy("df", "token")
    first = tokens.withColumn("n", F.row_number().over(order) + F.col("own")).where(f"n <= {prefix}").select("cid", "label", "size", "own", "token", "n")
    first = scratch.put(first.join(stands, "token", "left_semi"), "first")
    scratch.drop(tokens)
    counts = first.groupBy("token", "label").agg(F.count("*").alias("m"))
    mains = counts.groupBy("token").agg(F.max(F.struct("m", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1")
    met = scratch.put(first.join(mains.select("token", F.col("m.label").alias("main")), "token"), "met")
    scratch.drop(first)
    # what a set has before a shingle: a pair that meets in one of those need not meet here
    heads = met.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "token"))), 1, HEAD).alias("head"))
    narrow = classes.select("cid", F.transform("half", lambda k: F.pmod(k, F.lit((1 << 31) - 1)).cast("int")).alias("half"))  # a coarser key only adds candidates
    half = F.size("half") / 2
    narrow = narrow.select("cid", F.slice("half", F.lit(1), half.cast("int")).alias("half_a"), F.slice("half", (half + 1).cast("int"), half.cast("int")).alias("half_b"))
    within = met.join(heads, "cid").withColumn("head", F.transform(F.filter("head", lambda h: h["n"] < F.col("n")), lambda h: h["token"])).join(narrow, "cid")
    columns = ("cid", "label", "size", "own", "n", "head", "half_a", "half_b")
    left = within.where("label <> main").select("token", *(F.col(c).alias(f"{c}_l") for c in columns))
    right = within.select("token", *(F.col(c).alias(f"{c}_r") for c in columns), (F.col("label") == F.col("main")).alias("inner"))
    can = (
        f"label_l <> label_r AND (inner OR cid_l < cid_r) AND 100 * least(size_l, size_r) >= {percent} * greatest(size_l, size_r)"
        f" AND {100 + percent} * (least(n_l - own_l, n_r - own_r) + least(size_l - n_l, size_r - n_r)) >= {percent} * (size_l + size_r)"
        " AND NOT arrays_overlap(head_l, head_r) AND arrays_overlap(half_a_l, half_a_r) AND arrays_overlap(half_b_l, half_b_r)"
    )
    return left.join(right, "token").where(can).select(F.col("cid_l").alias("a"), F.col("cid_r").alias("b")).distinct()


def _with_uid(docs: DataFrame) -> DataFrame:
    """Rows with the same uid, a 128-bit digest, are repeats of one row (same id and text)."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return docs.withColumn("uid", F.unhex(F.md5(F.concat(part(F.col("doc_id").cast("string")), F.lit(":"), part(F.col("text"))).cast("binary"))))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, uid, n_shingles, component_id, kept.

    Null or empty texts have no shingles and are linked with nothing. Texts with equal sets are one class. Repeated
    rows (same id and text) each come back with the same values. A row with a null id has a null component_id and is
    kept; it links no others' ids. Other columns are ignored.
    """
    scratch, count = Scratch(docs.sparkSession, measured=True), half_keys_at(percent)
    named = _with_uid(docs.select("doc_id", "text"))
    rows = scratch.put(named.mapInPandas(_sketch(count), "doc_id long, uid binary, n_shingles long, fp binary, half array<long>, low binary"), "rows")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("fp").agg(F.min(F.struct("doc_id", "uid", "n_shingles", "half", "low")).alias("c"))
    classes = scratch.put(classes.select(F.monotonically_increasing_id().alias("cid"), "fp", "c.*"), "classes")

    keys = classes.select("cid", F.col("n_shingles").alias("n"), F.posexplode("half").alias("place", "key"))
    shared = keys.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi").select("key")
    side = lambda cond: F.collect_list(F.when(cond, F.col("key")))  # noqa: E731  at most ``count`` keys
    live = keys.join(shared, "key").groupBy("cid", "n").agg(side(F.col("place") < count).alias("one"), side(F.col("place") >= count).alias("two"))
    live = scratch.put(live.where("size(one) > 0 AND size(two) > 0"), "live")
    keyed = live.select("cid", "n", F.explode("one").alias("a"), "two").select("cid", "n", "a", F.explode("two").alias("b")).select("cid", "n", F.xxhash64("a", "b").alias("key"))
    centres = keyed.groupBy("key").agg(F.min("cid").alias("centre"), F.max("cid").alias("last")).where("centre < last").select("key", "centre")
    members = scratch.put(keyed.join(centres, "key"), "members")
    scratch.drop(live)

    ends = members.select("cid").distinct().join(classes.select("cid", "uid"), "cid")
    texts = named.groupBy("uid").agg(F.first("text").alias("text")).join(ends, "uid")
    sets = scratch.put(texts.select("cid", "text").mapInPandas(_sets, "cid long, items binary"), "sets", "uncompressed")
    stars = members.where("cid <> centre").select(F.col("cid").alias("a"), F.col("centre").alias("b")).distinct()
    labels = components(scratch.put(linked(stars, classes, sets, percent), "links"), scratch)

    # tables whose members are not all in one component: their outer members meet some landmarks of the largest
    mixed = scratch.put(_mixed(members, labels, percent), "mixed")
    scratch.drop(members)
    placed = scratch.put(_placed(mixed, labels), "placed")
    if not placed.isEmpty():
        marks = Window.partitionBy("key").orderBy("hash", "cid")
        large = placed.where(f"held >= {LANDMARKS}")
        landmarks = large.where("label = main").withColumn("hash", F.xxhash64("cid")).withColumn("n", F.row_number().over(marks)).where(f"n <= {LANDMARKS}")
        more = large.where("label <> main").select("key", F.col("cid").alias("a")).join(landmarks.select("key", F.col("cid").alias("b")), "key").select("a", "b").distinct()
        extra = scratch.put(linked(more, classes, sets, percent), "links")
        if not extra.isEmpty():
            labels = components(extra, scratch, labels)
            placed = _placed(mixed, labels)
        # what is then still apart is joined by prefixes of the sets
        apart = scratch.put(placed.select("cid", "label").distinct(), "apart")
        if not apart.isEmpty():
            extra = scratch.put(linked(_prefix_pairs(apart, classes, sets, scratch, percent), classes, sets, percent), "links")
            if not extra.isEmpty():
                labels = components(extra, scratch, labels)
    scratch.drop(sets, mixed)

    ids = _labelled(classes.select("cid", "doc_id", "fp"), labels)
    lowest = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_fp = scratch.put(ids.join(lowest, "label").select("fp", "component_id"), "ids")
    scratch.drop(classes)
    out = rows.select("doc_id", "uid", "n_shingles", "fp").join(by_fp, "fp", "left")
    component: Column = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "uid", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` with one document of each component; of repeated rows one stays. Columns are unchanged."""
    found = near_duplicates(docs, percent).where("kept").groupBy("uid").agg(F.count("*").alias("n"))
    found = Scratch(docs.sparkSession).put(found, "kept")
    named = _with_uid(docs)
    kept = named.join(found.select("uid"), "uid", "left_semi")
    repeated = found.where("n > 1").select("uid")
    if not repeated.isEmpty():
        once = named.join(repeated, "uid", "left_semi").dropDuplicates(["uid"])
        kept = kept.join(repeated, "uid", "left_anti").unionByName(once)
    return kept.select(*docs.columns)
