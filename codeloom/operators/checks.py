"""Validation of artifact tables: statistics, absolute and comparative checks, reproducibility, preference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import fold, relative_change

DEVIATION, CATASTROPHIC = 0.25, 0.80  # fixed: both strict


def assembly_statistics(artifacts: DataFrame, ignore_case: bool) -> DataFrame:
    """Per assembly, by its name as it is or without case: files, bytes, and sums with missing counts as zero."""
    name = fold(F.col("assembly_name")) if ignore_case else F.col("assembly_name")
    return artifacts.groupBy(name.alias("assembly")).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("type_count").alias("types"), F.sum(F.coalesce("method_count", F.lit(0))).alias("methods"), F.countDistinct("sha256").alias("distinct_hashes")
    )


#: What a set of artifacts must have at least.
POLICY = {"required": ("Assembly-CSharp",), "assemblies": 1, "types": 1, "methods": 1, "bytes": 1_048_576}
GLOBAL = {"ManagedAssemblyCount": "files", "TypeDefinitionCount": "types", "MethodDefinitionCount": "methods", "TotalManagedBytes": "bytes"}
PER_ASSEMBLY = ("TypeDefinitionCount", "MethodDefinitionCount")


def _sums(managed: DataFrame, *keys) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return managed.groupBy(*keys).agg(F.count("*").alias("files"), zero("size").alias("bytes"), zero("type_count").alias("types"), zero("method_count").alias("methods"), F.countDistinct("sha256").alias("contents"))


def absolute(candidates: DataFrame, artifacts: DataFrame, policy: dict = POLICY) -> DataFrame:
    """candidate_id, severity, code, detail, blocking: issues of each of ``candidates`` (candidate_id) by themselves.

    ``artifacts`` has candidate_id, relative_path, size, sha256, and of managed ones assembly_name, type_count, method_count;
    ``invalid`` marks what should be managed and cannot be read. Minimum counts are asked of candidates that have managed artifacts.
    """
    error = lambda code, detail: F.struct(F.lit("Error").alias("severity"), F.lit(code).alias("code"), detail.alias("detail"), F.lit(True).alias("blocking"))
    none = F.lit(None).cast("string")
    managed = artifacts.where("assembly_name IS NOT NULL")
    every = artifacts.groupBy("candidate_id").agg(F.count("*").alias("artifacts"))
    names = {f"has_{i}": F.coalesce(F.max((fold(F.col("assembly_name")) == name.lower()).cast("int")), F.lit(0)) for i, name in enumerate(policy["required"])}
    required = managed.groupBy("candidate_id").agg(*(c.alias(n) for n, c in names.items()))
    sums = candidates.join(every, "candidate_id", "left").join(_sums(managed, "candidate_id"), "candidate_id", "left").join(required, "candidate_id", "left").na.fill(0)
    some = F.col("files") > 0
    rules = [("NoArtifactsProduced", none, F.col("artifacts") == 0), ("NoManagedAssembliesProduced", none, (F.col("artifacts") > 0) & ~some)]
    rules += [("RequiredAssemblyMissing", F.lit(name), F.col(f"has_{i}") == 0) for i, name in enumerate(policy["required"])]
    rules += [(f"Insufficient{what}", none, some & (F.col(of) < policy[limit])) for what, of, limit in (
        ("ManagedAssemblyCount", "files", "assemblies"), ("TypeDefinitionCount", "types", "types"), ("MethodDefinitionCount", "methods", "methods"), ("ManagedBytes", "bytes", "bytes"))]
    found = sums.select("candidate_id", F.explode(F.array_compact(F.array(*(F.when(rule, error(code, detail)) for code, detail, rule in rules)))).alias("i"))
    own = F.array(F.when(F.col("size") == 0, error("EmptyArtifact", F.col("relative_path"))), F.when(F.col("invalid"), error("InvalidManagedAssembly", F.col("relative_path"))))
    single = artifacts.select("candidate_id", F.explode(F.array_compact(own)).alias("i"))
    twice = _sums(managed, "candidate_id", fold(F.col("assembly_name")).alias("detail")).where("files > 1")
    differ = F.col("contents") > 1
    twice = twice.select("candidate_id", F.struct(F.when(differ, "Error").otherwise("Information").alias("severity"), F.lit("DuplicateAssemblyIdentity").alias("code"), "detail", differ.alias("blocking")).alias("i"))
    return found.unionByName(single).unionByName(twice).select("candidate_id", "i.*")


def comparative(before: DataFrame, after: DataFrame) -> DataFrame:
    """candidate_id, metric, assembly, baseline, value, change, classification, severity: four metrics of a whole candidate
    (assembly is null) and two of each assembly, by its name without case, against its baseline; sides may lack an assembly.

    A decrease by more than ``CATASTROPHIC`` is an error and blocks preference; a change by more than ``DEVIATION``, and any
    from zero, are warnings.
    """

    def longs(artifacts: DataFrame, name: str) -> DataFrame:
        managed = artifacts.where("assembly_name IS NOT NULL").withColumn("assembly", fold(F.col("assembly_name")))
        parts = managed.groupBy("candidate_id", "assembly").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("bytes", "size"), ("types", "type_count"), ("methods", "method_count"))), F.count("*").alias("files"))
        whole = parts.groupBy("candidate_id").agg(*(F.sum(c).alias(c) for c in ("bytes", "types", "methods", "files"))).withColumn("assembly", F.lit(None).cast("string"))
        stack = lambda metrics: f"stack({len(metrics)}, {', '.join(f'{chr(39)}{m}{chr(39)}, {GLOBAL[m]}' for m in metrics)}) AS (metric, {name})"
        return whole.selectExpr("candidate_id", "assembly", stack(tuple(GLOBAL))).unionByName(parts.selectExpr("candidate_id", "assembly", stack(PER_ASSEMBLY)))

    keyed = lambda rows: rows.withColumn("_assembly", F.coalesce(F.concat(F.lit("="), "assembly"), F.lit("")))
    both = keyed(longs(before, "baseline")).drop("assembly").join(keyed(longs(after, "value")).drop("assembly"), ["candidate_id", "_assembly", "metric"], "full_outer").na.fill(0, ["baseline", "value"])
    both = both.withColumn("assembly", F.when(F.col("_assembly") != "", F.substring("_assembly", 2, 1_000_000)))
    change = relative_change(F.col("baseline"), F.col("value"))
    grade = (
        F.when((F.col("baseline") == 0) & (F.col("value") != 0), "BaselineZeroChanged").when(F.col("baseline") == 0, "WithinTolerance").when((F.col("value") < F.col("baseline")) & (change > CATASTROPHIC), "CatastrophicSanityDeviation")
        .when(change > DEVIATION, "ComparativeSanityDeviation").otherwise("WithinTolerance")
    )
    both = both.withColumn("change", change).withColumn("classification", grade)
    severity = F.when(F.col("classification") == "CatastrophicSanityDeviation", "Error").when(F.col("classification") != "WithinTolerance", "Warning")
    return both.select("candidate_id", "metric", "assembly", "baseline", "value", "change", "classification", severity.alias("severity"))


def reproducibility(extractions: DataFrame) -> DataFrame:
    """Per recipe whether its runs agree."""
    sums = extractions.groupBy("recipe_id").agg(F.count("*").alias("runs"), F.countDistinct("manifest_digest").alias("digests"))
    return sums.withColumn("outcome", F.when(F.col("runs") < 2, "NotTested").when(F.col("digests") == 1, "Reproducible").otherwise("Divergent"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
