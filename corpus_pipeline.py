"""A training-data pipeline: language ID, quality classifier, near duplicates, secret scans, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept and returns a DataFrame that
is written as Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestay.llm import langid, quality, secrets
from lodestay.llm.common import keep_keys, quoted, table
from lodestay.llm.ngram_join import near_duplicates
from lodestay.llm.packing import pack
from lodestay.llm.queries import tokenizer_path
from lodestay.storage import Scratch

#: A document goes if it has no letter or no language is as likely as this, or if its quality score is below that.
LEAST_LANGUAGE, LEAST_QUALITY = 0.3, 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the byte tagger (trained on ``docs``) calls ``und`` or is unsure of.

    Null and empty texts go, rows that repeat an id are judged one by one, an empty table stays empty.
    """
    return langid.keep_known(docs, LEAST_LANGUAGE)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the factorisation machine (trained on the labels of ``docs``) scores as poor.

    Null texts are scored as empty ones; without any label all scores are near one half.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), LEAST_QUALITY)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest doc_id of each group of near duplicates (five words, similarity 0.8).

    Rows that repeat a doc_id are one document to the join, and all stay if it does; so do rows without one and
    texts without words.
    """
    groups = near_duplicates(docs, size=5, num=4, den=5)
    with Scratch(spark) as scratch:
        kept = scratch.keep(groups.where("doc_id = component_id").select("doc_id").distinct(), "kept-ids")
    return keep_keys(docs, kept, "doc_id").select(*quoted(docs.columns)).unionByName(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in a text by a mark; the number of characters follows. Null texts stay."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences that hold all documents which are left; a null text is the end id alone."""
    pieces = pack(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicate_join", near_duplicate_join),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL can state neither a trained network nor a packing, so the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written in the shared folder and read again.

    Every table but the last is deleted at the end.
    """
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return scratch.keep(stage(spark, docs, sf_dir), name)
