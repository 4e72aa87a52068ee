"""A pipeline over documents: toxicity, near-duplicates, benchmark leaks, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lorekiln.llm import decontaminate, mixing, ngram_join, registry, token_output, toxicity

#: SQL has no conditional random field; the tests hold run() against its stages' brute-force versions.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.keep_one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, in files that hold them in the order of the mixture."""
    return mixing.in_mixed_order(docs)


def file_order(docs: DataFrame) -> list:
    """The place of a row in the files that docs was read from; by doc_id if it was not read from Parquet files."""
    place = [
        F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"),
        F.col("_metadata.file_name"),
        F.col("_metadata.row_index"),
    ]
    try:
        docs.select(*place)
    except AnalysisException:
        return [F.col("doc_id")]
    return place


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the token files, which follow the order of the mixture."""
    return token_output.tokens_written_and_read(docs, registry.tokenizer_path(), file_order(docs))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", leaks),
    ("mixing", mixed),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = token_output.shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
