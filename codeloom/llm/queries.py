"""The queries of the training-data operators over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, codebooks, extract, infill, langid, mixing, neardup, packing, pii, quality, topk, warc, webp
from . import pipeline as stages
from .common import stored, table


def _fixed_of(spans: str, kind: str) -> Column:
    """How many of the spans were found by the fixed pattern of a kind."""
    return F.size(F.filter(spans, lambda s: s["fixed"] & (s["kind"] == kind))).cast("long")


def op1_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    counts = [_fixed_of("found", k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(webp.to_media(table(spark, sf_dir, "documents")), "media", "uncompressed")
    return webp.features(media)


def op3_min_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), budget_share=1.0, columns=["doc_id", "source"])
    return mixed.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_pass", "mix_block", "mix_order")


def op5_uniform_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op6_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_brown_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op11_weighted_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.compress(table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(codebooks.digest(books)))


def op12_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op13_streaming_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir).drop("ids")


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM q
"""


_PARTS_NEAR = """(SELECT i, v, any_value(n) AS n, min({{'d': d, 'e': e}}) AS m FROM (SELECT c.i, c.v, c.n, b.e, coalesce(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(c.v, b.v)]), 0) AS d FROM c JOIN {} b ON b.i = c.i) GROUP BY i, v)"""


def _round_sql(book: str) -> str:
    sums = f"SELECT i, m.e AS e, j, CAST(floor(CAST(sum(n * v[j]) AS DOUBLE) / sum(n)) AS BIGINT) AS x FROM {_PARTS_NEAR.format(book)}, (SELECT unnest(range(1, (SELECT w + 1 FROM width))) AS j) GROUP BY 1, 2, 3"
    return f"SELECT o.i, o.e, coalesce(s.v, o.v) AS v FROM {book} o LEFT JOIN (SELECT i, e, list(x ORDER BY j) AS v FROM ({sums}) GROUP BY i, e) s ON s.i = o.i AND s.e = o.e"


# Whole vectors times 16 * 64 entries: small tables only.
_CODEBOOKS_SQL = f"""
WITH k AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
width AS (SELECT max(len(q)) // 16 AS w FROM k),
p AS (SELECT vec_id, i, q[i * w + 1 : i * w + w] AS v FROM k, width, (SELECT unnest(range(16)) AS i)),
c AS (SELECT i, v, count(*) AS n FROM p GROUP BY i, v),
b0 AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY vec_id) - 1 AS e, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
b1 AS ({_round_sql("b0")}), b2 AS ({_round_sql("b1")}),
coded AS (SELECT p.vec_id, string_agg(lpad(lower(hex(m.e)), 2, '0'), '' ORDER BY p.i) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM p JOIN {_PARTS_NEAR.format("b2")} a ON a.i = p.i AND a.v = p.v GROUP BY p.vec_id)
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY i, e)) FROM b2) AS codebooks_sha256 FROM coded JOIN k USING (vec_id)
"""

# What the rules must find in the given pages, whose texts all stand in an article of headings and paragraphs.
_EXTRACT_SQL = """
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(p|h1)>', chr(10), 'g') AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(body, '<b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS body FROM a),
t AS (SELECT page_id, url, array_to_string([x for x in [trim(regexp_replace(y, '\\s+', ' ', 'g')) for y in string_split(body, chr(10))] if x <> ''], chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""

_INFILL_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
r AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_semi_markov_pii, op2_lossless_webp, op3_min_bin_slack_packing, op4_temperature_mixing, op5_uniform_threshold_topk,
        op6_rule_ensemble_quality, op7_brown_class_bigrams, op8_warc_transactions, op9_crf_language, op10_tensored_minhash,
        op11_weighted_codebooks, op12_block_rules, op13_streaming_infill, pipeline,
    )}


def oracle_sql() -> dict[str, str]:
    out = {"op8_warc_transactions": _WARC_SQL, "op11_weighted_codebooks": _CODEBOOKS_SQL, "op12_block_rules": _EXTRACT_SQL, "op13_streaming_infill": _INFILL_SQL}
    if stages.ORACLE_SQL:
        out["pipeline"] = stages.ORACLE_SQL
    return out
