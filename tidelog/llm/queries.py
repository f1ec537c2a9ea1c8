"""The operators' registered queries over the tables, and their SQL."""

from __future__ import annotations

import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe_count, decontam, html_main, langid, ngram_join, pieces, pseudonyms, quality, secret_scan, urls
from tidelog.llm.common import table

#: The vocabulary files; they are read where they are and never copied.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def pseudonym_key(spark: SparkSession) -> str:
    """The session's key; a session without one gets a random one, kept for its life."""
    name = "spark.tidelog.pseudonym.secret"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(16))
    return spark.conf.get(name)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("NOT held_out"))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECES, keep=["doc_id"])


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pseudonym_key(spark), count_col="n_found")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, sf_dir, "documents"), BYTES)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_main_text, op2_langid, op3_url_filters, op4_ngram_join, op5_sentencepiece,
        op6_pseudonyms, op7_token_counts, op8_secrets, op9_decontamination, op10_quality,
    )
}
ORACLE_SQL: dict[str, str] = {}
