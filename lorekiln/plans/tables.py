"""The knowledge tables as projections of the star-schema and text tables, in Spark and (as SQL) in DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.operators.components import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents: doc_id, chunk_index (from 1), chunk_id, text."""
    return (
        read(spark, sf_dir, "documents")
        .select("doc_id", "lang", "source", F.posexplode(F.split("text", r"\. ")).alias("pos", "text"))
        .where(F.trim("text") != "")
        .select(
            "doc_id", "lang", "source",
            (F.col("pos") + 1).cast("long").alias("chunk_index"),
            F.concat_ws("-", "doc_id", (F.col("pos") + 1).cast("string")).alias("chunk_id"),
            "text",
        )
    )


CHUNKS_SQL = """chunks AS (
  SELECT doc_id, lang, source, chunk_index::BIGINT AS chunk_index, doc_id || '-' || chunk_index AS chunk_id, text FROM (
    SELECT doc_id, lang, source, unnest(string_split(text, '. ')) AS text, generate_subscripts(string_split(text, '. '), 1) AS chunk_index FROM documents)
  WHERE trim(text) <> '')"""


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One knowledge object for each part."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("ko_id"),
        F.col("p_type").alias("class_id"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("L"), (1 + F.col("p_size") % 4).cast("string")).alias("trust_level"),
        F.bround(F.col("p_retailprice") / 3000, 4).alias("confidence"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("brand"),
        F.col("p_size").cast("long").alias("size"),
    )


CONCEPTS_SQL = """ko AS (
  SELECT p_partkey AS ko_id, p_type AS class_id, p_name AS title, 'L' || (1 + p_size % 4) AS trust_level,
    round_even(p_retailprice / 3000, 4) AS confidence, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand, p_size::BIGINT AS size FROM part)"""

LEVELS = (
    "field_observation", "industry_standard", "regulatory_code", "oem_manual",
    "vendor_application_note", "academic_reference", "internal_sop", "unspecified",
)


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One authority layer for each line item, of the concept that its order is."""
    li = read(spark, sf_dir, "lineitem")
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("l_suppkey") % 8 + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("concept_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("publisher_id"),
        F.col("l_discount").alias("value"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").alias("shipped"),
        level.alias("authority_level"),
        F.year("l_shipdate").alias("publication_year"),
    )


#: The order of a concept's layers.
LAYER_ORDER = ("line", "part_id", "publisher_id", "price", "shipped")
LAYERS_SQL = f"""layers AS (
  SELECT l_orderkey AS concept_id, l_partkey AS part_id, l_suppkey AS publisher_id, l_discount AS value, l_extendedprice AS price,
    l_linenumber AS line, l_shipdate AS shipped, ([{", ".join(repr(x) for x in LEVELS)}])[l_suppkey % 8 + 1] AS authority_level,
    year(l_shipdate) AS publication_year FROM lineitem)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback events with their idempotency key."""
    e = read(spark, sf_dir, "events")
    return e.withColumn("event_key", F.concat_ws("|", "event_type", "user_id", F.to_date("ts").cast("string")))


FEEDBACK_SQL = """feedback AS (SELECT *, event_type || '|' || user_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) AS event_key FROM events)"""
