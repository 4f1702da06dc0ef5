"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, decontam, html, lines, pieces, pii, quality, simhash, toxicity, urls
from tidemark.llm.shared import table


def piece_model() -> bytes:
    import public_tokenizers

    return pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.tidemark.piiKey", None)  # a secret of the deployment
    if not key:  # without one, nobody shall be able to draw the surrogates again
        key = secrets.token_hex(32)
        spark.conf.set("spark.tidemark.piiKey", key)
    return pii.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), piece_model())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    every = chat.examples(turns.unionAll(spark.createDataFrame(chat.PROBE, turns.schema)))
    return chat.read_back(chat.written_out(every))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_html_extraction": op3_html_extraction,
    "op4_url_filter": op4_url_filter,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {"op7_chat_format": chat.ORACLE_SQL, "op8_decontamination": decontam.ORACLE_SQL}
