"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs. All but the last return the columns of ``documents``; the last returns packed pieces.

1. language_id: rows without a determined language go, by thresholds from the labelled held-out fold.
2. near_dedup: of each group of near-duplicates, linked by a Jaccard similarity of at least 0.80, one document stays.
3. pii: spans of personal data are replaced by their kind.
4. mixing: sources are mixed by temperature; every row stays, and rows of small sources come once for each pass.
5. packing: the texts, as ids, placed in sequences without padding.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, neardup, packing, pii
from .common import shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a determined language. Null and empty texts, and those without a letter, have none and go; repeated rows are
    judged alike; an empty table stays empty."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; of repeated rows one stays. Texts without words, and rows without an id, are groups of their
    own; an empty table stays empty."""
    return neardup.keep_one(docs, percent=80)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with spans of ``text`` masked and ``n_chars`` counted again. Null and empty texts stay as they are."""
    return pii.mask(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once at least, rows of small sources once for each pass. Rows without a source are one source."""
    return mixing.mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows; a null or empty text is the single closing id. An empty table gives no pieces."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", mask_pii), ("mixing", mix_sources), ("packing", pack)]

# Classifiers, hash permutations and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
