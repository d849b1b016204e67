"""What holds at a time: the last value at or before each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, key: str, order: list[str], value: Column, bucket: Column, name: str, before_only: bool = False) -> DataFrame:
    """``rows`` with ``name``: the last non-null ``value`` of their key up to themselves, or before themselves, in ``order`` (ends
    in a unique column; ``bucket`` never falls in it).

    Rows of a key are numbered within buckets, and buckets among each other, so a key with a third of all rows is
    spread over its buckets. Keys are not null.
    """
    rows = rows.withColumn("_carry_bucket", bucket).withColumn("_carry_value", value)
    inside = Window.partitionBy(key, "_carry_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before_only else 0)
    within = rows.withColumn("_carry_within", F.last("_carry_value", True).over(inside))
    sums = rows.groupBy(key, "_carry_bucket").agg(F.max(F.when(F.col("_carry_value").isNotNull(), F.struct(*order, F.col("_carry_value").alias("v")))).alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_carry_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_carry_bucket", F.last("_last.v", True).over(earlier).alias("_carry_before"))
    out = within.join(sums, [key, "_carry_bucket"])
    return out.withColumn(name, F.coalesce("_carry_within", "_carry_before")).drop("_carry_bucket", "_carry_value", "_carry_within", "_carry_before")


def at_times(requests: DataFrame, facts: DataFrame, key: str, value: Column, bucket: str, name: str) -> DataFrame:
    """``requests`` (request_id, moment, key) with the value of the last of ``facts`` (fact_id, moment, key) at or before each; of two
    facts at one time that of the larger id holds. Requests without a key have none."""
    asked = requests.where(F.col(key).isNotNull()).select(key, "moment", F.lit(1).alias("_side"), F.col("request_id").alias("_id"), F.struct("*").alias("_row"))
    known = facts.where(F.col(key).isNotNull()).select(key, "moment", F.lit(0).alias("_side"), F.col("fact_id").alias("_id"), F.struct(value.alias("v")).alias("_fact"))
    both = asked.unionByName(known, allowMissingColumns=True)
    out = carried(both, key, ["moment", "_side", "_id"], F.col("_fact"), F.date_trunc(bucket, "moment"), "_held").where("_side = 1")
    found = out.select("_row.*", F.col("_held.v").alias(name))
    return found.unionByName(requests.where(F.col(key).isNull()), allowMissingColumns=True)
