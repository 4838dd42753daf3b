"""The corpus pipeline: documents in, tokenised clean documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last keep the
columns that they get, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import decontam, langid, ngram_join, pii, sentence_pieces, shared


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; the others go.

    Null and empty texts and those without a letter have no language and go.
    Texts are read in whole, however long; equal texts fare alike, so repeated
    rows all stay or all go. Without a row to learn from nothing is accepted.
    """
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id.

    Rows without a word, null texts among them, are like no other and stay.
    Rows of one id and text are one; a null id comes after all others. Of rows
    that tie in all of that one stays, whichever.
    """
    return ngram_join.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; a benchmark without items takes
    none away. Long texts are searched in whole, repeated rows fare alike.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars, if there is such a column, follows.

    A null text stays null, with a null n_chars. Every row stays, repeated ones too.
    """
    columns, spans = docs.columns, shared.fresh(docs, "pii_spans")
    found = pii.with_spans(docs, out=spans)
    found = found.withColumn("text", pii.redact(F.col("text"), F.col(spans)))
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token_ids, which decode to their texts, and n_tokens; null and empty texts have none.

    Columns of these names that came in are kept as token_ids_input and n_tokens_input.
    """
    return sentence_pieces.tokenized(docs).drop("text")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Language ID and near duplicates are beyond SQL; tests hold the stages against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
