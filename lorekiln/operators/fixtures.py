"""Nested fixtures as the rows of several tables, from one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.text import let

FIXTURE = (
    "struct<doc_id:string, file_hash:string, title:string, pages:array<struct<page_no:bigint, chunks:array<struct<chunk_index:bigint, text:string, "
    "objects:array<struct<key:string, title:string, role:string>>>>>>>"
)
TABLES = ("documents", "pages", "chunks", "objects", "evidence")


def tagged(fixtures: DataFrame, content: str = "content") -> DataFrame:
    """(table, doc_id, key, parent, payload) for every row that a fixture stands for; content is its JSON, payload that of the row's own fields.

    A fixture is read and exploded once: its documents, pages, chunks, objects and the evidence of an object in a chunk are elements of one array. Fixtures that are no JSON or
    have no doc_id give no rows; missing lists are empty.
    """
    row = lambda table, key, parent, payload: F.struct(F.lit(table).alias("table"), key.alias("key"), parent.alias("parent"), F.to_json(payload).alias("payload"))
    listed = lambda a: F.filter(a, lambda x: x.isNotNull())

    def rows(f):
        doc = f["doc_id"]
        page_key = lambda p: F.concat_ws("/", doc, p["page_no"].cast("string"))
        chunk_key = lambda p, c: F.concat_ws("/", page_key(p), c["chunk_index"].cast("string"))
        over = lambda make: F.flatten(listed(F.transform(listed(f["pages"]), lambda p: F.transform(listed(p["chunks"]), lambda c: make(p, c)))))
        deep = lambda make: F.flatten(listed(over(lambda p, c: F.transform(listed(c["objects"]), lambda o: make(p, c, o)))))
        parts = (
            F.array(row("documents", doc, F.lit(None).cast("string"), F.struct(f["title"].alias("title"), f["file_hash"].alias("file_hash")))),
            F.transform(listed(f["pages"]), lambda p: row("pages", page_key(p), doc, F.struct(p["page_no"].alias("page_no")))),
            over(lambda p, c: row("chunks", chunk_key(p, c), page_key(p), F.struct(c["chunk_index"].alias("chunk_index"), c["text"].alias("text")))),
            deep(lambda p, c, o: row("objects", o["key"], F.lit(None).cast("string"), F.struct(o["title"].alias("title")))),
            deep(lambda p, c, o: row("evidence", F.concat(o["key"], F.lit("@"), chunk_key(p, c)), o["key"], F.struct(chunk_key(p, c).alias("chunk"), o["role"].alias("role")))),
        )
        # a list that is missing makes its part null, which is no row
        return F.struct(doc.alias("doc_id"), F.flatten(F.array_compact(F.array(*parts))).alias("rows"))

    read = fixtures.select(let(F.from_json(content, FIXTURE), rows).alias("r")).where("r.doc_id IS NOT NULL")
    return read.select("r.doc_id", F.inline("r.rows")).where("key IS NOT NULL").select("table", "doc_id", "key", "parent", "payload")


def expand(fixtures: DataFrame, folder: str, content: str = "content") -> dict[str, DataFrame]:
    """The tables of all fixtures, written by one pass to folder and each read from its own part; of rows that share a key the first by payload stays."""
    tagged(fixtures, content).write.mode("overwrite").partitionBy("table").parquet(folder)
    spark = fixtures.sparkSession
    every = spark.read.schema("doc_id string, key string, parent string, payload string, table string").parquet(folder)
    kept = lambda t: every.where(F.col("table") == t).groupBy("key").agg(F.min(F.struct("doc_id", "payload", "parent")).alias("_r")).select("key", "_r.doc_id", "_r.parent", "_r.payload")
    return {t: kept(t) for t in TABLES}


def remapped(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows of a table whose documents exist under another id, with that id in doc_id, key and parent: known(doc_id, stored_id)."""
    moved = rows.join(known, "doc_id", "left")
    tail = lambda c: F.substr(c, F.length("doc_id") + 1)
    of_doc = lambda c: (F.col(c) == F.col("doc_id")) | F.startswith(c, F.concat("doc_id", F.lit("/")))
    again = lambda c: F.when(F.col("stored_id").isNotNull() & of_doc(c), F.concat("stored_id", tail(F.col(c)))).otherwise(F.col(c))
    return moved.select(F.coalesce("stored_id", "doc_id").alias("doc_id"), again("key").alias("key"), again("parent").alias("parent"), "payload")
