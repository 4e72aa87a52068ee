"""Sources: documents, inventories, candidates, packages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.sources import packages

INVENTORY = (
    "batch_group string, batch_reason string, extraction_priority string, publisher_or_brand_guess string, authority_level_guess string, "
    "document_kind_guess string, equipment_scope_guess string, page_count string, text_quality string, recommended_extraction_mode string, "
    "size_mb string, path string"
)
EXTENSIONS = ("pdf", "docx", "doc", "xlsx")


def scan_files(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS, content: bool = False) -> DataFrame:
    """path, length, file_ext (and content) of files below root; without content only metadata are read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    )
    keep = ["path", "length", "modificationTime", *(["content"] if content else [])]
    return files.select(*keep, F.lower(F.substring_index("path", ".", -1)).alias("file_ext"))


def file_hashes(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    return scan_files(spark, root, extensions, content=True).select("path", "length", F.sha2("content", 256).alias("file_hash"))


def inventory(spark: SparkSession, path: str, text_quality: str | None = None) -> DataFrame:
    """An inventory CSV, all columns strings."""
    rows = spark.read.schema(INVENTORY).option("header", True).csv(path)
    return rows if text_quality is None else rows.where(F.trim("text_quality") == text_quality)


def paths_of(inventory_rows: DataFrame, files: DataFrame) -> DataFrame:
    return inventory_rows.select("path").union(files.select("path")).distinct()


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def json_objects(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a file, with the file's name."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).json(path)
    return rows.withColumn("file_name", F.col("_metadata.file_name"))


def review_packs(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    packs = json_objects(spark, path)
    return packs if mode is None else packs.where(F.col("review_mode") == mode)


def latest_candidates(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """Candidates of many runs, the last of each key."""
    rows = json_lines(spark, path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def text_pages(files: DataFrame) -> DataFrame:
    """path, page_no, text of text files with their content; a form feed ends a page, NULs are dropped."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\\x00", "")
    return files.select("path", F.posexplode(F.split(text, "\f")).alias("at", "text")).select("path", (F.col("at") + 1).alias("page_no"), "text")


def package(spark: SparkSession, path: str) -> DataFrame:
    """A YAML domain package as (key, value) rows, values as JSON text."""
    return packages.entries(packages.yaml_documents(spark, path, "*")).select("key", F.to_json("value").alias("value"))
