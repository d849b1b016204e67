"""A portal's rows: pages of symbols, bounded evidence, derived statements, and the search index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.canonical import member_anchor, slug
from codeloom.functions.text import CALL_LIKE, count_text
from codeloom.operators.lookup import completeness_notice

SHOWN = 128  # fixed: rows of a list of evidence
LISTS = ("references", "callers", "callees")
OWN_PAGE = ("Type", "Method", "Constructor")


def pages(symbols: DataFrame) -> DataFrame:
    """``symbols`` (symbol_id, canonical_key, kind, ...) with codebase, channel, page_path, anchor, href. Types and callables have
    pages of their own; other members stand on their type's page, if it is there."""
    key = F.split("canonical_key", ":", 4)
    stem = slug(F.col("canonical_key"))
    rows = symbols.withColumns({"codebase": key[0], "channel": key[1], "_owner": F.substring_index(key[3], "::", 1), "_stem": stem, "anchor": member_anchor(F.col("canonical_key"))})
    place = F.concat(F.lit("code/"), F.lower("codebase"), F.lit("/"), F.lower("channel"), F.lit("/symbols/"), F.substring(F.substring_index("_stem", "-", -1), 1, 2), F.lit("/"), "_stem", F.lit(".html"))
    rows = rows.withColumn("page_path", place)
    types = rows.where("kind = 'Type'").select("codebase", "channel", F.substring_index(key[3], "::", 1).alias("_owner"), F.col("page_path").alias("_page"))
    members = rows.where(~F.col("kind").isin(*OWN_PAGE)).join(types, ["codebase", "channel", "_owner"], "left").withColumn("page_path", F.coalesce("_page", "page_path")).drop("_page")
    both = rows.where(F.col("kind").isin(*OWN_PAGE)).unionByName(members)
    return both.withColumn("href", F.concat("page_path", F.lit("#"), "anchor")).drop("_owner", "_stem")


def _sides(relationships: DataFrame) -> DataFrame:
    """Each edge from both its ends: symbol_id, relationship_id, direction, and the lists that it belongs to. A self-loop is one
    reference, taken as outgoing, but both a caller and a callee; so each (edge, direction) is there once."""
    call = F.col("relationship_kind").isin(*CALL_LIKE)
    own = F.col("source_symbol_id").eqNullSafe(F.col("target_symbol_id"))
    out = relationships.select(F.col("source_symbol_id").alias("symbol_id"), "relationship_id", F.lit("Outgoing").alias("direction"), F.array_compact(F.array(F.lit("references"), F.when(call, "callees"))).alias("lists"))
    into = relationships.where("target_symbol_id IS NOT NULL").select(F.col("target_symbol_id").alias("symbol_id"), "relationship_id", F.lit("Incoming").alias("direction"), F.array_compact(F.array(F.when(~own, "references"), F.when(call, "callers"))).alias("lists"))
    return out.unionByName(into)


def evidence(relationships: DataFrame, shown: int = SHOWN) -> DataFrame:
    """symbol_id, list, place, relationship_id, direction: the first rows of each list by id. Tasks keep no more than that of a
    symbol before the shuffle, so a symbol that a third of all edges reach is no load."""
    rows = _sides(relationships).select("symbol_id", "relationship_id", "direction", F.explode("lists").alias("list"))
    order = Window.partitionBy("symbol_id", "list").orderBy("relationship_id", "direction")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= shown)


def totals(relationships: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol_id, references, callers, callees of all symbols, from all edges."""
    has = lambda name: F.count(F.when(F.array_contains("lists", name), 1)).alias(name)
    sums = _sides(relationships).groupBy("symbol_id").agg(*map(has, LISTS))
    return symbols.select("symbol_id").join(sums, "symbol_id", "left").na.fill(0)


def statements(counted: DataFrame, source_state: Column) -> DataFrame:
    """symbol_id, place, statement: what can be said from the totals, and what is said of a source that is not there."""
    said = lambda name: count_text(F.col(name), name[:-1], name)
    overview = [F.concat(F.lit("DERIVED: "), said(name), F.lit(" in this index.")) for name in ("callers", "callees", "references")]
    relevance = F.concat(F.lit("DERIVED: Modder relevance signal: "), said("callers"), F.lit(" and "), said("callees"), F.lit(" are measured in this index."))
    absent = F.when(source_state != "Resolved", F.concat(F.lit("DERIVED: "), source_state))
    return counted.select("symbol_id", F.posexplode(F.array_compact(F.array(*overview, relevance, absent))).alias("place", "statement"))


def model(symbols: DataFrame, relationships: DataFrame, product: str, shown: int = SHOWN) -> DataFrame:
    """One nested row for each symbol: its page, and of types and callables totals, notices and bounded lists of evidence."""
    placed = pages(symbols)
    listed = evidence(relationships, shown).groupBy("symbol_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("place", "relationship_id", "direction")))).alias(f"{name}_shown") for name in LISTS))
    notes = [completeness_notice(F.col("kind"), F.col("body_recovery_status"), callers, product).alias(f"{name}_notice") for name, callers in (("callers", True), ("callees", False))]
    facts = totals(relationships, symbols).join(listed, "symbol_id", "left").join(symbols.select("symbol_id", *notes), "symbol_id")
    facts = facts.select("symbol_id", F.struct(*(c for c in facts.columns if c != "symbol_id")).alias("evidence"))
    return placed.join(facts, "symbol_id", "left").withColumn("evidence", F.when(F.col("kind").isin(*OWN_PAGE), F.col("evidence")))


def search_index(placed: DataFrame) -> DataFrame:
    """line: a JSON object for each symbol, in the order of seven fields, over all partitions."""
    fields = {"codebase": "codebase", "channel": "channel", "qualifiedName": "qualified_name", "signature": "signature", "kind": "kind", "symbolId": "symbol_id", "exactKey": "canonical_key", "href": "href"}
    ordered = placed.orderBy("codebase", "channel", "qualified_name", "signature", "kind", "symbol_id", "href")
    return ordered.select(F.to_json(F.struct(*(F.col(c).alias(n) for n, c in fields.items()))).alias("line"))
