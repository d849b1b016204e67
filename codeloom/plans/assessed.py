"""Queries over channels, sources, diffs of single symbols, validation policy and lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import checks, graph, lookup, policy
from codeloom.plans.registry import query

_LIVE = "channel IN (SELECT channel FROM channel_runs WHERE status = 'Completed')"


@query(f"""SELECT symbol_id, channel, CAST(rank AS INTEGER) AS rank, count(*) OVER () AS total FROM (SELECT *, CASE WHEN lower(qualified_name) = 'part1' OR lower(signature) = 'part1' THEN 0 WHEN ends_with(lower(qualified_name), '.part1') THEN 1
 WHEN starts_with(lower(qualified_name), 'part1') THEN 2 WHEN contains(lower(qualified_name), 'part1') THEN 3 WHEN contains(lower(signature), 'part1') THEN 4 END AS rank FROM channel_symbols WHERE {_LIVE})
 WHERE rank IS NOT NULL ORDER BY rank, qualified_name, signature, channel, symbol_id LIMIT 20""", "channel_symbols channel_runs")  # fmt: skip
def search_all_channels(g):
    return lookup.search_channels(g.channel_symbols, g.channel_runs, "Part1", 20).select("symbol_id", "channel", "rank", "total")


@query(f"""SELECT selector, CASE count(symbol_id) WHEN 0 THEN 'NotFound' WHEN 1 THEN 'Resolved' ELSE 'Ambiguous' END AS status, CASE WHEN count(symbol_id) = 1 THEN min(symbol_id) END AS symbol_id
 FROM (SELECT qualified_name AS selector FROM symbols WHERE k = 0 UNION ALL SELECT concat('Gone#', p_partkey) FROM part) LEFT JOIN channel_symbols ON qualified_name = selector AND {_LIVE} GROUP BY selector""", "symbols channel_symbols channel_runs")  # fmt: skip
def resolve_across_channels(g):
    gone = g.base("part").selectExpr("concat('Gone#', p_partkey)")
    selectors = g.symbols.where("k = 0").select(F.col("qualified_name").alias("selector")).union(gone)
    return lookup.resolve_channels(g.channel_symbols, g.channel_runs, selectors, ["installed", "upstream", "nightly"])


@query("""SELECT s.symbol_id, relative_path, start_line, end_line FROM symbols s JOIN (SELECT *, row_number() OVER (PARTITION BY qualified_name, kind ORDER BY start_line, end_line, relative_path) AS n FROM declared_spans) d
 ON s.canonical_key = concat('game:installed:', d.kind, ':', d.qualified_name) AND n = 1 WHERE s.k = 0""", "symbols declared_spans")
def source_spans(g):
    return lookup.source_spans(g.declared_spans, g.symbols.where("k = 0"), "game:installed:")


_LINES = "string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10))"


@query(f"""SELECT s.symbol_id, CASE WHEN l.doc_id IS NULL THEN 'NoSource' WHEN text IS NULL THEN 'FileMissing' WHEN end_line > len({_LINES}) THEN 'SpanOutside' ELSE 'Resolved' END AS status,
 CASE WHEN end_line <= len({_LINES}) THEN array_to_string(list_slice({_LINES}, start_line, end_line), chr(10)) END AS snippet
 FROM (SELECT symbol_id FROM symbols WHERE k = 0 AND kind = 'Type') s LEFT JOIN text_locations l ON l.symbol_id = s.symbol_id LEFT JOIN documents t ON t.doc_id = l.doc_id""", "symbols text_locations")  # fmt: skip
def focused_source(g):
    return lookup.focused_source(g.symbols.where("k = 0 AND kind = 'Type'"), g.text_locations, g.base("documents"))


_EVIDENCE = "(SELECT symbol_id, concat(l_returnflag, ':', l_partkey) AS line FROM lineitem JOIN method_of ON o_orderkey = l_orderkey WHERE k = 0)"


@query(f"""SELECT symbol_id, 'declaration' AS fingerprint_kind, sha256(signature) AS fingerprint FROM symbols WHERE k = 0 UNION ALL SELECT symbol_id, 'structural', sha256(kind || chr(10) || qualified_name || chr(10) || signature) FROM symbols WHERE k = 0
 UNION ALL SELECT symbol_id, 'method-body', sha256(string_agg(line, chr(10) ORDER BY line)) FROM {_EVIDENCE} GROUP BY symbol_id""", "symbols method_of")
def fingerprints(g):
    lines = g.base("lineitem").join(g.method_of.where("k = 0"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lookup.fingerprints(g.symbols.where("k = 0"), lines.select("symbol_id", F.concat("l_returnflag", F.lit(":"), F.col("l_partkey").cast("string")).alias("line")))


_NOTE = """CASE WHEN kind = 'Type' THEN 'Call completeness is not applicable to a non-callable symbol.' WHEN body_recovery_status = 'Recovered' THEN 'The index has affirmative recovered-body evidence.'
 WHEN body_recovery_status = 'StubOrUnavailable' THEN 'The body is stubbed or unavailable; zero call results are not definitive.' ELSE 'Body recovery is unknown; zero call results are not definitive.' END"""


@query(f"SELECT symbol_id, {_NOTE} AS callees, {_NOTE} || ' Incoming callers are limited to call sites whose target resolved to the selected symbol.' AS callers FROM symbols", "symbols")
def completeness_notice(g):
    note = lambda callers: lookup.completeness_notice(F.col("kind"), F.col("body_recovery_status"), callers)
    return g.symbols.select("symbol_id", note(False).alias("callees"), note(True).alias("callers"))


_OUT = """(SELECT v.*, CASE WHEN NOT containment_passed OR coalesce(e, false) THEN 'Invalid' WHEN coalesce(w, false) THEN 'ValidWithWarnings' ELSE 'Valid' END AS outcome,
 containment_passed AND NOT coalesce(e, false) AND input_integrity_passed AND process_integrity_passed AND NOT coalesce(b, false) AS preference_eligible
 FROM validations v LEFT JOIN (SELECT attempt_id, bool_or(severity = 'Error') AS e, bool_or(severity = 'Warning') AS w, bool_or(preference_blocking) AS b FROM issues GROUP BY 1) i ON i.attempt_id = v.attempt_id)"""


@query(f"SELECT attempt_id, outcome, preference_eligible FROM {_OUT}", "validations issues")
def overall_outcome(g):
    return policy.outcomes(g.validations, g.issues).select("attempt_id", "outcome", "preference_eligible")


@query(f"""SELECT attempt_id, CASE WHEN trust <> 'ManagedPinned' OR NOT preference_eligible THEN NULL WHEN preferred_id IS NULL THEN 'ManagedAutomatic' WHEN preferred_id = candidate_id OR preferred_reason = 'ManualPromotion' THEN NULL
 WHEN preferred_tool_id <> tool_id THEN 'ReplacementAfterToolUpgrade' END AS reason FROM {_OUT}""", "validations issues")
def preference_decision(g):
    results = policy.outcomes(g.validations, g.issues)
    return results.select("attempt_id", policy.preference(results).alias("reason"))


_OPEN = "('Created', 'Preparing', 'Running', 'ProcessCompleted', 'Validating')"


@query(f"""SELECT attempt_id, CASE WHEN attempt_id % 17 = 0 THEN 'Refused' ELSE 'Recovered' END AS action, CASE WHEN attempt_id % 17 = 0 THEN status ELSE 'Abandoned' END AS status,
 CASE WHEN attempt_id % 17 = 0 THEN 0 ELSE attempt_id % 4 END AS discarded FROM attempts WHERE status IN {_OPEN}""", "attempts")
def interrupted_recovery(g):
    seen = g.attempts.selectExpr("attempt_id", "status", "attempt_id % 17 = 0 AS owner_alive", "CAST(NULL AS BOOLEAN) AS child_alive", "attempt_id % 4 AS files")
    return policy.recover(seen, keep_artifacts=False)


@query(f"SELECT attempt_id, status FROM attempts WHERE status IN {_OPEN} ORDER BY changed_at, attempt_id", "attempts")
def non_terminal_attempts(g):
    return g.attempts.where(F.col("status").isin(*policy.INTERRUPTIBLE)).orderBy("changed_at", "attempt_id").select("attempt_id", "status")


@query("SELECT user_id, attempt_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY changed_at DESC, attempt_id DESC) AS n FROM attempts) WHERE n = 1", "attempts")
def latest_validation(g):
    return lookup.latest(g.attempts, ["user_id"], ["changed_at", "attempt_id"]).select("user_id", "attempt_id", "status")


@query("SELECT assembly, files, bytes FROM (SELECT assembly_name AS assembly, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM artifacts WHERE k = 1 GROUP BY 1) EXCEPT SELECT assembly_name, count(*), CAST(sum(size) AS BIGINT) FROM artifacts WHERE k = 0 GROUP BY 1", "artifacts")
def statistics_mismatch(g):
    stats = lambda k: checks.assembly_statistics(g.artifacts.where(f"k = {k}"), False).select("assembly", "files", "bytes")
    return stats(1).exceptAll(stats(0))


@query("SELECT k, relative_path, size FROM artifacts ORDER BY k, relative_path", "artifacts")
def extraction_artifacts(g):
    return g.artifacts.orderBy("k", "relative_path").select("k", "relative_path", "size")


@query("SELECT symbol_id, canonical_key FROM symbols WHERE contains(lower(concat(qualified_name, ' ', signature, ' ', canonical_key)), 'order7') ORDER BY qualified_name, kind, canonical_key, symbol_id LIMIT 200", "symbols")
def site_search(g):
    text = F.lower(F.concat_ws(" ", "qualified_name", "signature", "canonical_key"))
    return g.symbols.where(text.contains("order7")).orderBy("qualified_name", "kind", "canonical_key", "symbol_id").limit(200).select("symbol_id", "canonical_key")
