"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindle.llm import centroids, chat, decontam, langid, ngram_join, pii, secrets, sentence_pieces, suffix_dedup, timestamps, topk, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_decontamination": lambda s, d: decontam.report(table(s, d, "documents"), table(s, d, "benchmark")),
    "op2_url_filter": lambda s, d: url_filter.report(table(s, d, "pages")),
    "op3_pii": lambda s, d: pii.report(table(s, d, "documents")),
    "op4_toxicity": lambda s, d: toxicity.report(table(s, d, "documents"), table(s, d, "labels")),
    "op5_ngram_jaccard": lambda s, d: ngram_join.report(table(s, d, "documents")),
    "op6_secrets": lambda s, d: secrets.report(table(s, d, "documents")),
    "op7_language_id": lambda s, d: langid.report(table(s, d, "documents")),
    "op8_sentencepiece": lambda s, d: sentence_pieces.report(table(s, d, "documents")),
    "op9_chat_format": lambda s, d: chat.report(table(s, d, "conversations")),
    "op10_exact_topk": lambda s, d: topk.report(table(s, d, "embeddings")),
    "op11_centroids": lambda s, d: centroids.report(table(s, d, "embeddings")),
    "op12_suffix_dedup": lambda s, d: suffix_dedup.report(table(s, d, "documents")),
    "op13_timestamps": lambda s, d: timestamps.report(table(s, d, "stamps")),
}


def oracles() -> dict[str, str]:
    """DuckDB SQL by query; op2's holds its trained weights, so it is made when asked for."""
    return {
        "op2_url_filter": url_filter.oracle(),
        "op5_ngram_jaccard": ngram_join.ORACLE,
        "op9_chat_format": chat.ORACLE,
        "op10_exact_topk": topk.ORACLE,
        "op11_centroids": centroids.ORACLE,
        "op13_timestamps": timestamps.ORACLE,
    }
