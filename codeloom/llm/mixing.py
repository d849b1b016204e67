"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent between 0 and 1 and normalised. Bisection finds the smallest
exponent, that is the flattest mix, whose entropy stays at or below a target and which repeats no source more often than
a limit. The weights are then realised: with a budget of tokens each source gets its quota as whole passes and a part of
one more pass, each pass in a seeded random order of its own, and the mix is dealt into blocks that all hold the sources
in the target weights, shuffled within.

Orders are hashes, so nothing is collected: a pass of a source is split into buckets by the leading part of the hash, and
running token sums are taken within buckets and over bucket totals. A hot source only has more buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch
from .packing import encoder

TARGET_ENTROPY = 0.97  # of the logarithm of the number of sources
MAX_PASSES = 2.0
BUCKET_ROWS = 200
SPAN = 4096  # buckets whose running sums one task takes
SECTIONS, ROUNDS = 32, 6  # of the search for the exponent: to 2**-30
BLOCK_TOKENS = 4_000_000
SEED = 20_240_601


def _measurer(columns: list[str], path: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            counts = [len(encode(t)) + 1 if t else 1 for t in batch["text"]]
            yield batch[columns].assign(mix_tokens=np.array(counts, np.int64))

    return run


def with_tokens(docs: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """The ``columns`` of ``docs`` and mix_tokens: the ids of ``text`` and one that closes it, as the packing counts them.
    A null text is empty."""
    schema = StructType([docs.schema[c] for c in columns]).add("mix_tokens", "long")
    return docs.mapInPandas(_measurer(columns, path), schema)


def spread(shares: list[float], exponent: float) -> tuple[float, float]:
    """Of shares to the exponent, normalised: the entropy, and the passes over the most repeated source when the least
    repeated is passed once."""
    powers = [s**exponent for s in shares]
    scale = math.fsum(powers)
    return -math.fsum(p / scale * math.log(p / scale) for p in powers), (max(shares) / min(shares)) ** (1 - exponent)


def _sum(values: Column) -> Column:
    """A sum that does not depend on the order of its terms."""
    return F.sum(values.cast("decimal(38,20)")).cast("double")


def find_exponent(sources: DataFrame, target: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES) -> tuple[float, float, float]:
    """(exponent, scale, total) for sources (tokens, one row each): the smallest exponent in [0, 1] with an entropy of at
    most ``target * log(sources)`` and at most ``max_passes``; 1, the shares as they are, if none meets both. scale is the
    sum of the powers, total that of the tokens.

    The interval is cut into ``SECTIONS`` parts instead of two: all their ends are tried in one aggregate over the sources,
    which stay distributed, however many there are."""
    ends = sources.agg(F.sum("tokens").alias("total"), F.count("*").alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if not ends["n"]:
        return 1.0, 1.0, 1.0
    total, n = float(ends["total"]), ends["n"]
    share = F.col("tokens") / F.lit(total)

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        aggregates = [x for i, a in enumerate(exponents) for x in (_sum(F.pow(share, F.lit(a))).alias(f"s{i}"), _sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"l{i}"))]
        row = sources.agg(*aggregates).first()
        return [(row[f"s{i}"], row[f"l{i}"]) for i in range(len(exponents))]

    def fits(a: float, s: float, weighted: float) -> bool:
        entropy = math.log(s) - a * weighted / s
        return entropy <= target * math.log(n) + 1e-12 and (ends["most"] / ends["least"]) ** (1 - a) <= max_passes

    low, high = 0.0, 1.0
    if n > 1:
        for _ in range(ROUNDS):
            tried = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            good = next((i for i, (a, (s, w)) in enumerate(zip(tried, sums(tried), strict=True)) if fits(a, s, w)), None)
            if good is None or not good:  # none but the upper end that is known already, or the lower end itself
                high = high if good is None else low
                break
            low, high = tried[good - 1], tried[good]
    return high, sums([high])[0][0], total


def weights(sources: DataFrame, target: float, max_passes: float, budget: int | None, budget_share: float | None = None) -> DataFrame:
    """(mix_source, docs, tokens, exponent, weight, quota) from (mix_source, docs, tokens), one row a source."""
    exponent, scale, total = find_exponent(sources, target, max_passes)
    if budget is None and budget_share is not None:
        budget = round(budget_share * total)
    weight = F.pow(F.col("tokens") / F.lit(total), F.lit(exponent)) / F.lit(scale)
    out = sources.withColumn("exponent", F.lit(exponent)).withColumn("weight", weight)
    if budget is not None:
        return out.withColumn("quota", F.round(F.col("weight") * F.lit(float(budget))).cast("long"))
    # without a budget, the least repeated source is passed once
    most = sources.agg(F.max("tokens")).first()[0] or 0
    size = most * scale / (most / total) ** exponent if most else 0.0
    return out.withColumn("quota", F.greatest(F.round(F.col("weight") * F.lit(size)).cast("long"), "tokens"))


def mix(
    docs: DataFrame, target: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES, budget: int | None = None, seed: int = SEED,
    block_tokens: int = BLOCK_TOKENS, budget_share: float | None = None, columns: list[str] | None = None, path: str | None = None,
) -> DataFrame:
    """The mix of all rows of ``docs`` (doc_id, text, source, ...): its ``columns``, or all, and mix_tokens, mix_weight,
    mix_pass (from 0), mix_block and mix_order (their order within a block).

    The budget is a number of tokens, or a share of all there are. Without one each source is passed at least once, so
    every row stays and small sources repeat. A null source is a source of its own. Repeated rows are drawn separately, as
    are rows with a null id; an empty table gives an empty mix, and clashing names of other columns do not matter: work
    columns are prefixed. A pass takes rows in its order until the quota is reached, so the last row may go over it.
    """
    scratch, columns = Scratch(docs.sparkSession), columns or docs.columns
    needed = [*columns, *(c for c in ("doc_id", "source") if c not in columns)]
    rows = scratch.put(with_tokens(docs, needed, path).withColumn("mix_row", F.monotonically_increasing_id()), "measured")
    sources = scratch.put(rows.groupBy(F.col("source").alias("mix_source")).agg(F.count("*").alias("docs"), F.sum("mix_tokens").alias("tokens")), "sources")
    goals = scratch.put(weights(sources, target, max_passes, budget, budget_share), "goals")
    total = goals.agg(F.sum("quota")).first()[0] or 0
    blocks = max(1, round(total / block_tokens))

    goal = goals.select("mix_source", F.col("weight").alias("mix_weight"), F.col("quota").alias("mix_quota"), F.col("tokens").alias("mix_of"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET_ROWS)).alias("mix_buckets"))
    light = rows.select("doc_id", "source", "mix_tokens", "mix_row")  # places are found without the texts
    drawn = light.join(goal, light["source"].eqNullSafe(goal["mix_source"])).drop("mix_source")
    last = F.floor((F.col("mix_quota") - 1) / F.col("mix_of"))  # the last pass may be a part
    drawn = drawn.withColumn("mix_pass", F.explode(F.when(F.col("mix_quota") > 0, F.sequence(F.lit(0), last.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))))
    drawn = drawn.withColumn("mix_hash", F.xxhash64(F.lit(seed), "mix_pass", "doc_id", F.when(F.col("doc_id").isNull(), F.col("mix_row"))))
    unit = F.pmod("mix_hash", F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = drawn.withColumn("mix_bucket", F.floor(unit * F.col("mix_buckets")).cast("long"))

    # running sums over a source's buckets in two levels, so that no task has all of them
    counted = drawn.select(F.col("source").alias("sum_source"), F.col("mix_pass").alias("sum_pass"), F.col("mix_bucket").alias("sum_bucket"), "mix_tokens")
    sums = scratch.put(counted.groupBy("sum_source", "sum_pass", "sum_bucket").agg(F.sum("mix_tokens").alias("held")).withColumn("span", F.floor(F.col("sum_bucket") / SPAN)), "buckets")
    spans = sums.groupBy("sum_source", "sum_pass", "span").agg(F.sum("held").alias("held"))
    running = lambda keys, order: F.coalesce(F.sum("held").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outer = spans.select(F.col("sum_source").alias("o_source"), F.col("sum_pass").alias("o_pass"), F.col("span").alias("o_span"), running(("sum_source", "sum_pass"), "span").alias("outer"))
    inner = sums.select("sum_source", "sum_pass", "sum_bucket", "span", running(("sum_source", "sum_pass", "span"), "sum_bucket").alias("inner"))
    of_span = F.col("sum_source").eqNullSafe(F.col("o_source")) & (F.col("sum_pass") == F.col("o_pass")) & (F.col("span") == F.col("o_span"))
    before = inner.join(outer, of_span).select("sum_source", "sum_pass", "sum_bucket", (F.col("inner") + F.col("outer")).alias("mix_before"))
    same = F.col("source").eqNullSafe(F.col("sum_source")) & (F.col("mix_pass") == F.col("sum_pass")) & (F.col("mix_bucket") == F.col("sum_bucket"))
    # whole buckets beyond the quota go before anything is moved
    near = drawn.join(before, same)
    near = near.withColumn("mix_at", F.col("mix_before") + F.col("mix_pass") * F.col("mix_of")).where("mix_at < mix_quota")
    within = Window.partitionBy("source", "mix_pass", "mix_bucket").orderBy("mix_hash", "mix_tokens", "mix_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = near.withColumn("mix_at", F.col("mix_at") + F.coalesce(F.sum("mix_tokens").over(within), F.lit(0))).where("mix_at < mix_quota")
    block = F.floor(F.col("mix_at") / F.col("mix_quota") * blocks).cast("long")
    place = F.struct("mix_weight", "mix_pass", block.alias("mix_block"), F.xxhash64(F.lit(seed + 1), "mix_hash").alias("mix_order"))
    places = placed.groupBy("mix_row").agg(F.collect_list(place).alias("mix_places"))  # one for each pass
    out = rows.join(places, "mix_row").select(*columns, "mix_tokens", F.explode("mix_places").alias("mix_place"))
    return out.select(*columns, "mix_tokens", "mix_place.*")
