"""From raw documents to token pieces: five stages, each a table that the next one reads.

Stage | kept | changed
- language: documents whose language is known (score of ``MIN_SCORE`` or more)
- near_copies: one document, the smallest id, of each class of near copies
- leaks: documents that hold no benchmark item
- private: all; personal data in their texts replaced, n_chars counted anew
- pieces: all; their texts as token pieces, with doc_id, lang and source

Null, empty and blank texts and texts without a letter have no language and go in the first stage; a stage that gets them
nevertheless keeps them as they are (pieces: null identifiers for a null text, none for an empty one).  Rows that repeat
(equal id and text) are one document from the second stage on; the other stages treat each alike.  A null id is kept, and is
the last choice among near copies.  Texts may have any length.  Columns of any name pass all stages but the last.  An empty table gives an
empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontam, langid, ngram_join, pieces, pseudonyms
from tidelog.llm.common import fresh, name, table, written
from tidelog.llm.queries import PIECES, pseudonym_key

MIN_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~langid.held_out()))
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    judged = langid.predict(docs, model, names=(lang, score))
    return judged.where((F.col(lang) != "und") & (F.col(score) >= MIN_SCORE)).select(*map(name, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(docs, key=pseudonym_key(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*map(name, docs.columns))


def token_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, PIECES, keep=["doc_id", "lang", "source"])


STAGES = [("language", language), ("near_copies", near_copies), ("leaks", leaks), ("private", private), ("pieces", token_pieces)]
#: Trained models and Viterbi searches have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for stage, f in STAGES:
        docs = written(f(spark, docs, sf_dir), stage)
    return docs
