"""Search, selector resolution, neighbourhoods, and diffs of symbol graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import CALL_LIKE, CALLABLE, fold, match_rank
from codeloom.operators.pages import numbered
from codeloom.sources.cuts import cut

RELATED_REFS = 500  # references that related types are taken from
CLASSES = ("Added", "Removed", "MethodBodyChanged", "RelationshipsChanged", "Unchanged")  # fixed: in this priority


def completed(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of snapshots that have a completed run."""
    return rows.join(runs.where("status = 'Completed'").select("snapshot_id").distinct(), "snapshot_id", "left_semi")


def search(symbols: DataFrame, query: str, limit: int | None = None, kind: str | None = None) -> DataFrame:
    """Ranked matches; with a limit a top-k, so no full sort."""
    found = symbols.withColumn("rank", match_rank(F.col("qualified_name"), F.col("signature"), query)).where("rank IS NOT NULL")
    found = found if kind is None else found.where(F.col("kind") == kind)
    return found if limit is None else found.orderBy("rank", "qualified_name", "signature", "symbol_id").limit(limit)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with the exact total and whether more follows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def _tiers(symbols: DataFrame, selectors: DataFrame, prefix: str) -> DataFrame:
    """selector, symbol_id, tier of all matches. Tiers are equi-joins, so no pairs form."""
    symbols = cut(symbols.select("symbol_id", "canonical_key", "qualified_name", "signature"))  # read six times below
    selectors = cut(selectors.select("selector"))
    s = selectors.select("selector", fold(F.col("selector")).alias("folded"))
    tiers = [("symbol_id", "selector", F.col("symbol_id")), ("canonical_key", "selector", F.col("canonical_key")), ("signature", "folded", fold(F.col("signature"))), ("name", "folded", fold(F.col("qualified_name")))]
    out = None
    for i, (_, key, value) in enumerate(tiers):
        hit = s.join(symbols.select(value.alias(key), "symbol_id"), key).select("selector", "symbol_id", F.lit(i).alias("tier"))
        out = hit if out is None else out.union(hit)
    out = cut(out)
    # then match ranks: names, signatures and last parts of names by their text, the other ranks by pieces of it
    rest = s.join(out.select("selector").distinct(), "selector", "left_anti").select("selector", fold(bare(F.col("selector"), prefix)).alias("query"))
    name = fold(F.col("qualified_name"))
    parts = F.split(name, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    texts = symbols.select("symbol_id", name.alias("name"), F.explode(F.array_distinct(F.concat(tails, F.array(fold(F.col("signature")))))).alias("query"))
    near = rest.join(texts, "query")
    exact = (F.col("name") == F.col("query")) | ~F.col("name").endswith(F.concat(F.lit("."), F.col("query")))
    near = cut(near.select("selector", "symbol_id", F.when(exact, 0).otherwise(1).alias("rank")))
    far = partial_matches(symbols, rest.join(near.select("selector").distinct(), "selector", "left_anti"))
    return out.union(near.union(far.select(*near.columns)).select("selector", "symbol_id", (F.col("rank") + len(tiers)).alias("tier")))


def resolve(symbols: DataFrame, selectors: DataFrame, prefix: str = "game:installed:") -> DataFrame:
    """selector, status, symbol_id for many selectors at once.

    An id comes first, then an exact canonical key, then signature, then name, ignoring ASCII case, then the best match
    rank of what the selector names; equal matches on the first tier that has any are ambiguous, and nothing is chosen
    among them. ``prefix`` names the codebase and channel of the symbols: a selector that begins with it is taken
    without it and its kind, and others stay whole.
    """
    out = _tiers(symbols, selectors, prefix)
    best = out.groupBy("selector", "tier").agg(F.min("symbol_id").alias("symbol_id"), F.countDistinct("symbol_id").alias("n"))
    best = best.groupBy("selector").agg(F.min(F.struct("tier", "symbol_id", "n")).alias("b"))
    joined = selectors.select("selector").join(best, "selector", "left")
    status = F.when(F.col("b").isNull(), "NotFound").when(F.col("b.n") > 1, "Ambiguous").otherwise("Resolved")
    return joined.select("selector", status.alias("status"), F.when(status == "Resolved", F.col("b.symbol_id")).alias("symbol_id"))


def candidates(symbols: DataFrame, selectors: DataFrame, prefix: str = "game:installed:") -> DataFrame:
    """selector, place, symbol_id, qualified_name, signature: what each ambiguous selector could mean, by name, signature and id."""
    out = cut(_tiers(symbols, selectors, prefix))
    best = out.groupBy("selector", "tier").agg(F.countDistinct("symbol_id").alias("n")).groupBy("selector").agg(F.min(F.struct("tier", "n")).alias("b"))
    several = best.where("b.n > 1").select("selector", F.col("b.tier").alias("tier"))
    found = out.join(several, ["selector", "tier"], "left_semi").select("selector", "symbol_id").distinct()
    named = found.join(symbols.select("symbol_id", "qualified_name", "signature"), "symbol_id")
    placed = numbered(named, "selector", ["qualified_name", "signature", "symbol_id"], "place")  # a broad selector has very many
    return placed.select("selector", "place", "symbol_id", "qualified_name", "signature")


def bare(selector: Column, prefix: str) -> Column:
    """A canonical key of the index whose codebase and channel are ``prefix``, without them and its kind; others as they are."""
    rest = F.substr(selector, F.lit(len(prefix) + 1))
    name = F.substr(rest, F.locate(":", rest) + 1)
    return F.when(selector.startswith(prefix) & rest.contains(":") & (name != ""), name).otherwise(selector)


def grams(text: Column, size: Column) -> Column:
    """Distinct pieces of some characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, size)))


def partial_matches(symbols: DataFrame, selectors: DataFrame) -> DataFrame:
    """selector, symbol_id, rank of all matches of ``selectors`` (selector, query). Symbols and selectors meet in the
    selector's rarest piece of at most three characters; what contains the selector contains that piece."""
    asked = selectors.where("query <> ''").withColumn("size", F.least(F.length("query"), F.lit(3)))
    sizes = F.broadcast(asked.select("size").distinct())  # three at most
    name, signature = fold(F.col("qualified_name")), fold(F.col("signature"))
    text = F.when(name == signature, name).otherwise(F.concat_ws("\n", name, signature))
    texts = symbols.crossJoin(sizes).select("symbol_id", "qualified_name", "signature", F.explode(grams(text, F.col("size"))).alias("gram"))
    count = texts.groupBy("gram").agg(F.count("*").alias("n"))
    own = asked.select("selector", "query", F.explode(grams(F.col("query"), F.col("size"))).alias("gram"))
    rarest = own.join(count, "gram", "left").groupBy("selector", "query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    met = texts.join(rarest.select("selector", "query", F.col("m.gram").alias("gram")), "gram")
    found = met.select("selector", "symbol_id", match_rank(F.col("qualified_name"), F.col("signature"), F.col("query")).alias("rank"))
    return found.where("rank IS NOT NULL")


def edges(relationships: DataFrame, symbol_id: str | DataFrame, direction: str) -> DataFrame:
    """``callers``, ``callees`` or ``refs`` of a symbol, which may be given as a frame of one row; a self-loop is one reference,
    taken as outgoing."""
    if isinstance(symbol_id, DataFrame):
        relationships = relationships.crossJoin(F.broadcast(symbol_id.toDF("_asked")))  # one row
        symbol_id = F.col("_asked")
    else:
        symbol_id = F.lit(symbol_id)
    incoming = relationships.where(F.col("target_symbol_id") == symbol_id).withColumn("direction", F.lit("Incoming"))
    outgoing = relationships.where(F.col("source_symbol_id") == symbol_id).withColumn("direction", F.lit("Outgoing"))
    if direction == "callers":
        return incoming.where(F.col("relationship_kind").isin(*CALL_LIKE))
    if direction == "callees":
        return outgoing.where(F.col("relationship_kind").isin(*CALL_LIKE))
    return outgoing.union(incoming.where(~F.col("source_symbol_id").eqNullSafe(symbol_id)))


def with_endpoints(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names of both ends; an unresolved target keeps its text."""
    name = lambda end: symbols.select(F.col("symbol_id").alias(f"{end}_symbol_id"), F.col("qualified_name").alias(f"{end}_name"))
    out = found.join(name("source"), "source_symbol_id", "left").join(name("target"), "target_symbol_id", "left")
    return out.withColumn("target_name", F.coalesce("target_name", "target_text"))


def related_types(relationships: DataFrame, symbol_id: str, kinds: list[str], limit: int) -> DataFrame:
    """The first references by id, then those of the kinds, then the limit, in this order."""
    first = edges(relationships, symbol_id, "refs").orderBy("relationship_id").limit(RELATED_REFS)
    return first.where(F.col("relationship_kind").isin(*kinds)).orderBy("relationship_id").limit(limit)


def evidence_totals(relationships: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per symbol the number of references, callers and callees; sets at a time instead of query by query."""
    call = F.col("relationship_kind").isin(*CALL_LIKE)
    out = relationships.groupBy(F.col("source_symbol_id").alias("symbol_id")).agg(F.count("*").alias("n_out"), F.count(F.when(call, 1)).alias("callees"))
    own = F.col("source_symbol_id") == F.col("target_symbol_id")
    into = relationships.where("target_symbol_id IS NOT NULL").groupBy(F.col("target_symbol_id").alias("symbol_id")).agg(F.count(F.when(~own, 1)).alias("n_in"), F.count(F.when(call, 1)).alias("callers"))
    joined = symbols.select("symbol_id").join(out, "symbol_id", "left").join(into, "symbol_id", "left").na.fill(0)
    return joined.select("symbol_id", (F.col("n_out") + F.col("n_in")).alias("refs"), "callers", "callees")


def edge_hash(relationships: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per source the hash of its sorted edges as text: kind, and the canonical key of a resolved target, or else its text,
    empty if there is none. Keys stay the same from build to build where ids do not."""
    keys = symbols.select(F.col("symbol_id").alias("target_symbol_id"), F.col("canonical_key").alias("target_key"))
    line = F.concat("relationship_kind", F.lit("\n"), F.coalesce("target_key", "target_text", F.lit("")))
    return relationships.join(keys, "target_symbol_id", "left").groupBy(F.col("source_symbol_id").alias("symbol_id")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n\n"), 256).alias("edge_hash"))


def fingerprint_pivot(fingerprints: DataFrame, kinds: list[str]) -> DataFrame:
    """One row a symbol with a column for each kind."""
    return fingerprints.groupBy("symbol_id").pivot("fingerprint_kind", kinds).agg(F.first("fingerprint"))


def diff(symbols: DataFrame, prints: DataFrame, relationships: DataFrame, before: int, after: int, keep_signatures: bool = False) -> DataFrame:
    """Classify every canonical key of two indexes, which are rows of the same tables by ``k``.

    Both sides are read together: bodies and edge hashes join by symbol id, then each key's two sides meet in one aggregate. A
    body that only one side has counts as changed only if the side without it says that it was recovered; no edges at
    all hash to the empty text. Signatures are shown of what is added or removed, or of all rows.
    """
    both = F.col("k").isin(before, after)
    here = symbols.where(both)
    body = prints.where(both & (F.col("fingerprint_kind") == "method-body")).select("symbol_id", F.col("fingerprint").alias("body"))
    rows = here.join(body, "symbol_id", "left").join(edge_hash(relationships.where(both), here), "symbol_id", "left")
    side = F.struct(F.col("qualified_name").alias("name"), "kind", "signature", F.col("body_recovery_status").alias("status"), "body", F.coalesce("edge_hash", F.lit("")).alias("edges"))
    met = rows.groupBy("canonical_key").agg(*(F.max(F.when(F.col("k") == k, side)).alias(s) for s, k in (("a", before), ("b", after))))
    return classified(met, keep_signatures)


def classified(met: DataFrame, keep_signatures: bool = False) -> DataFrame:
    """The classes of ``diff`` from canonical_key and the sides a and b (name, kind, signature, status, body, edges), each null where the
    key is not there. Bodies and edges are whatever is equal where they are."""
    one_sided = F.col("a.body").isNull() != F.col("b.body").isNull()
    missing_recovered = F.when(F.col("a.body").isNull(), F.col("a.status") == "Recovered").otherwise(F.col("b.status") == "Recovered")
    body = F.when(one_sided, F.coalesce(missing_recovered, F.lit(False))).otherwise(F.coalesce(F.col("a.body") != F.col("b.body"), F.lit(False)))
    body = body & F.col("a.kind").isin(*CALLABLE)  # only these have bodies
    kind = F.when(F.col("a").isNull(), CLASSES[0]).when(F.col("b").isNull(), CLASSES[1]).when(body, CLASSES[2]).when(F.col("a.edges") != F.col("b.edges"), CLASSES[3]).otherwise(CLASSES[4])
    met = met.withColumn("classification", kind)
    shown = F.lit(True) if keep_signatures else F.col("classification").isin(*CLASSES[:2])
    return met.select("canonical_key", F.coalesce("b.name", "a.name").alias("name"), F.coalesce("b.kind", "a.kind").alias("kind"), "classification", F.when(shown, F.col("a.signature")).alias("before"), F.when(shown, F.col("b.signature")).alias("after"))


def diff_order() -> list[Column]:
    """Changes by their class first, then by name; the key makes the order total."""
    place = F.array_position(F.array(*(F.lit(c) for c in CLASSES)), F.col("classification"))
    return [place, F.col("name"), F.col("canonical_key")]


def diff_counts(found: DataFrame) -> DataFrame:
    """A count for every class, zero where none."""
    classes = found.sparkSession.createDataFrame([(c,) for c in CLASSES], "classification string")
    counts = found.groupBy("classification").agg(F.count("*").alias("n"))
    return classes.join(counts, "classification", "left").na.fill(0, ["n"])
