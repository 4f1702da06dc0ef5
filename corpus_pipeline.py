"""A training corpus from the documents table: five stages, each written as Parquet and read by the next.

Every stage but the last returns the columns of ``documents``; the last one
returns a row for each document kept: doc_id, n_tokens, ids_sha256 and
decoded_sha256.  The near-duplicate stage links texts that share at least 0.8
of their 5-word shingles.

Defined results: a null text is not toxic, has no lines to cut and no benchmark
item; all null and wordless texts are copies of each other, of which one row
stays, and it has no tokens.  Rows that repeat a doc_id and a text are one document:
one of them stays.  Rows of one doc_id with different texts are documents of their own.  A null doc_id
comes after all others where an order decides.  Empty tables of labels or benchmark reject nothing; an empty table
of documents gives an empty result.  More columns, whatever their names and types, are handed on; n_chars is
brought up to date where there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, lines, pieces, simhash, toxicity
from tidemark.llm.queries import piece_model
from tidemark.llm.shared import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels, scores below 0.5."""
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of repeated runs of words; n_chars follows the text."""
    cut = lines.dedup(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of texts that share at least 0.8 of their 5-word shingles."""
    return simhash.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's piece ids and of the text decoded from them."""
    return pieces.digests(docs, piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: The learned lexicon, connected components and piece encoding are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
