"""The operators' queries over the synthetic tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm import chat_format, collocations, ctw_lm, decontaminate, embed_dedup, filter_audit, license_scan, mixing, ngram_join, packing, token_output, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_read(spark, sf_dir, "documents"))[0]


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_read(spark, sf_dir, "conversations"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_read(spark, sf_dir, "pages")).drop("decided_by")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    crf = toxicity.learn(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, crf).select(
        "doc_id", "held_out", "score", "predicted", F.size("span_starts").alias("n_spans")
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "component_id", "n_links", "kept")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_lm.score_corpus(_read(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokens_written_and_read(_read(spark, sf_dir, "documents"), tokenizer_path())


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_dedup(_read(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents").select("doc_id", "source")).drop("row")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(_read(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_read(spark, sf_dir, "documents"), tokenizer_path())


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_chat_formatting, op3_benchmark_decontamination, op4_url_filter, op5_toxicity, op6_ngram_jaccard_join, op7_lm_scoring, op8_token_output, op9_embedding_dedup, op10_source_mixing,
            op11_phrase_collocations, op12_best_fit_packing, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.license_sql(),
        "op4_url_filter": url_filter.url_sql(),
        "op9_embedding_dedup": embed_dedup.DEDUP_SQL,
        "op11_phrase_collocations": collocations.COLLOCATION_SQL,
        "op13_filter_audit": filter_audit.AUDIT_SQL,
    }
