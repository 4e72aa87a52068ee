"""Serving: filters, ranking, evidence and display of knowledge objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions import values as V


def search_chunks(chunks: DataFrame, query: str, limit: int = 20, doc_id=None) -> DataFrame:
    """Chunks whose text contains the query by ILIKE (its % and _ are wildcards), as trace rows, the first `limit` in order."""
    hits = chunks.where(F.col("text").ilike(f"%{query}%"))
    if doc_id is not None:
        hits = hits.where(F.col("doc_id") == doc_id)
    return (
        hits.select("chunk_id", "doc_id", "chunk_index", F.substring("text", 1, 200).alias("evidence_text"), F.lit(1.0).alias("relevance_score"))
        .orderBy("doc_id", "chunk_index")
        .limit(limit)
    )


def wildcard_equal(column: Column, wanted) -> Column:
    """Rows without a value fit every wish, and no wish fits every row."""
    return F.lit(True) if wanted is None else column.isNull() | (column == wanted)


def filter_objects(
    objects: DataFrame, *, min_trust: str = "L4", min_confidence: float | None = None, brand: str | None = None, classes: Sequence[str] | None = None
) -> DataFrame:
    """The common filters; a null confidence counts as 0."""
    keep = V.least_trust(F.col("trust_level"), min_trust) & wildcard_equal(F.col("brand"), brand)
    if min_confidence is not None:
        keep &= F.coalesce("confidence", F.lit(0.0)) >= min_confidence
    if classes is not None:
        keep &= F.col("class_id").isin(*classes)
    return objects.where(keep)


def rank_objects(objects: DataFrame) -> list[Column]:
    return [F.desc(V.trust_rank(F.col("trust_level"))), F.desc(F.coalesce("confidence", F.lit(0.0))), F.asc("class_id"), F.asc("title"), F.asc("ko_id")]


def page_of_objects(objects: DataFrame, limit: int) -> DataFrame:
    """The first `limit` objects with total_count and has_more; the count is an aggregate of its own, the page a top-k."""
    total = objects.agg(F.count("*").alias("total_count"))
    top = objects.orderBy(*rank_objects(objects)).limit(limit)
    return top.join(F.broadcast(total)).withColumn("has_more", F.col("total_count") > limit)


def attach_evidence(page: DataFrame, evidence: DataFrame, documents: DataFrame, show_restricted: bool = False) -> DataFrame:
    """Evidence of each object of a page; objects without any are dropped after the limit, as the service does.

    Text of documents that may not be redistributed is masked unless asked for.
    """
    shown = F.when(F.col("redistributable") | F.lit(show_restricted), F.col("evidence_text")).otherwise(
        F.format_string("[restricted: document %d]", "doc_id")
    )
    rows = evidence.join(F.broadcast(page.select("ko_id")), "ko_id").join(documents, "doc_id")
    grouped = rows.groupBy("ko_id").agg(
        F.count("*").alias("n_evidence"),
        F.sum((~F.col("redistributable")).cast("long")).alias("n_restricted"),
        F.min_by(shown, F.struct("ord", "doc_id")).alias("first_text"),
    )
    return page.join(grouped, "ko_id")


def language_candidates(wanted: str) -> list[str]:
    """The wanted language, its base language, English."""
    tag = wanted.strip().lower()
    return list(dict.fromkeys([tag, tag.split("-")[0], "en"]))


def localized(display: Column, stored: Column, wanted: str) -> Column:
    """The first display in the wanted languages, else the stored text."""
    return F.coalesce(*(F.try_element_at(display, F.lit(x)) for x in language_candidates(wanted)), stored)


def public_payload(payload: Column) -> Column:
    """A map without the keys that start with _."""
    return F.map_filter(payload, lambda k, v: ~F.startswith(k, F.lit("_")))


def grouped_aliases(aliases: DataFrame) -> DataFrame:
    """class_id, n_aliases, aliases in the order of preference, then text."""
    return aliases.groupBy("class_id").agg(
        F.count("*").alias("n_aliases"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct((~F.col("is_preferred")).alias("o"), "alias"))), lambda x: x["alias"]), ","
        ).alias("aliases"),
    )


def hidden_when_disputed(state: Column, rule: Column, value: Column) -> Column:
    """The value, or null where sources disagree and only their rank decided."""
    return F.when((state == "value_disagreement") & (rule == "fallback_highest_rank"), None).otherwise(value)


def related(objects: DataFrame, n: int = 4) -> DataFrame:
    """Up to n other objects of each object's class: the first of the class's order that are not itself.

    Only the first n + 1 objects of a class can be anyone's, so these alone meet its objects.
    """
    at = F.row_number().over(Window.partitionBy("class_id").orderBy("ko_id"))
    heads = objects.select("class_id", "ko_id", at.alias("at")).where(F.col("at") <= n + 1)
    heads = heads.groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ko_id"))), lambda x: x["ko_id"]).alias("heads"))
    mine = objects.select("class_id", "ko_id").join(heads, "class_id")
    others = F.slice(F.filter("heads", lambda x: x != F.col("ko_id")), 1, n)
    return mine.select("ko_id", F.posexplode(others).alias("pos", "related_id")).select("ko_id", (F.col("pos") + 1).alias("step"), "related_id")


def object_filter(
    *,
    min_trust: str = "L4",
    min_authority: str | None = None,
    consensus: Sequence[str] | None = None,
    min_confidence: float | None = None,
    brand: Sequence[str] | None = None,
    model_family: Sequence[str] | None = None,
    fault_code: str | None = None,
) -> Column:
    """The predicate of the knowledge queries: every arm that is asked for holds; objects without brand or family fit all.

    A fault code is the object's key or one of its fault_codes.
    """
    keep = V.least_trust(F.col("trust_level"), min_trust)
    if min_authority is not None:
        keep &= V.least_authority(F.col("highest_authority"), min_authority)
    if consensus is not None:
        keep &= F.col("consensus_state").isin(*consensus)
    if min_confidence is not None:
        keep &= F.coalesce("confidence", F.lit(0.0)) >= min_confidence
    for column, wanted in (("brand", brand), ("model_family", model_family)):
        if wanted is not None:
            keep &= F.col(column).isNull() | F.col(column).isin(*wanted)
    if fault_code is not None:
        keep &= (F.col("canonical_key") == fault_code) | F.coalesce(F.array_contains("fault_codes", fault_code), F.lit(False))
    return keep


def pages_of_specs(rows: DataFrame, key: str, spec: str) -> DataFrame:
    """key, kind, chunk, page_no of every page that a spec ("1,3-5:table:2") names, once each."""
    parts = F.split(spec, ":")
    spans = rows.select(key, F.get(parts, F.lit(1)).alias("kind"), F.get(parts, F.lit(2)).alias("chunk"), F.explode(F.split(F.get(parts, F.lit(0)), ",")).alias("span"))
    ends = F.split(F.trim("span"), "-")
    return spans.select(key, "kind", "chunk", F.explode(F.sequence(F.get(ends, F.lit(0)).cast("long"), F.element_at(ends, -1).cast("long"))).alias("page_no")).distinct()
