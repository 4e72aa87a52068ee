"""Applying reviewed candidates: their evidence as rows, what the merge takes, conditional updates, states of packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.operators.components import cut

#: What a candidate has that names nothing else.
VISUAL_ROLE, TEXT_ROLE, CONFIDENCE, TRUST, AUTHORITY = "primary_visual", "primary", 0.85, "L3", "unspecified"


def _said(*columns: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def visual_rows(refs: DataFrame, role: str = VISUAL_ROLE, model: str | None = None) -> DataFrame:
    """refs(ko_id, page_image_id, visual_evidence_id, doc_id, page_id, page_no, role, model) as rows of visual evidence, one for each (object, image, role).

    The image is the one named or else the older id; a reference without either has no row. Of equal references the one that sorts first by (doc, page, number, model), nulls first, stays.
    """
    image, as_role = _said("page_image_id", "visual_evidence_id"), F.coalesce(F.nullif("role", F.lit("")), F.lit(role))
    named = refs.withColumns({"image": image, "as_role": as_role}).where("image IS NOT NULL")
    vid = F.concat(F.lit("vev_"), F.substring(F.sha1(F.concat_ws(":", F.col("ko_id").cast("string"), "image", "as_role")), 1, 14))
    rest = F.struct(
        F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("page_id", F.lit("")).alias("page_id"), F.coalesce("page_no", F.lit(0)).cast("long").alias("page_no"),
        F.coalesce(F.nullif("model", F.lit("")), F.lit(model)).alias("model"),
    )
    return named.groupBy(vid.alias("evidence_id"), "ko_id", F.col("image").alias("page_image_id"), F.col("as_role").alias("role")).agg(F.min(rest).alias("r")).select("evidence_id", "ko_id", "page_image_id", "role", "r.*")


def merger_rows(candidates: DataFrame) -> DataFrame:
    """What the merge takes of candidates, evidence first by how it is nested.

    candidates(candidate_id, key, title, summary, payload, draft, confidence, trust_level, publisher, layers: array<struct<authority_level, publisher, citation>>,
    chain: struct<chunk_id, doc_id, page_id, page_no, text, role>, evidence: array of such structs, own: such a struct). A chain with a chunk is the only evidence; else the list counts, null items left out;
    else the candidate's own chunk. Authority is the first layer's.
    """
    first = F.get("layers", F.lit(0))
    has = lambda c: F.coalesce(F.col(c)["chunk_id"], F.lit("")) != ""
    listed = F.filter(F.coalesce("evidence", F.array().cast(candidates.schema["evidence"].dataType)), lambda e: e.isNotNull())
    chosen = F.when(has("chain"), F.array("chain")).when(F.size(F.coalesce("evidence", F.array().cast(candidates.schema["evidence"].dataType))) > 0, listed).when(has("own"), F.array("own")).otherwise(F.slice(listed, 1, 0))
    clean = F.transform(chosen, lambda e: F.struct(
        *(F.coalesce(e[c], F.lit("")).alias(c) for c in ("chunk_id", "doc_id", "page_id")), F.coalesce(e["page_no"], F.lit(0)).cast("long").alias("page_no"),
        F.coalesce(e["text"], F.lit("")).alias("text"), F.coalesce(e["role"], F.lit(TEXT_ROLE)).alias("role"),
    ))
    return candidates.select(
        "candidate_id", F.coalesce(F.nullif("title", F.lit("")), "key", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce(_said("payload", "draft"), F.lit("{}")).alias("payload"),
        F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(CONFIDENCE)).alias("confidence"), F.coalesce("trust_level", F.lit(TRUST)).alias("trust_level"),
        F.coalesce(F.nullif(first["authority_level"], F.lit("")), F.lit(AUTHORITY)).alias("authority_level"), F.coalesce(F.nullif(first["publisher"], F.lit("")), "publisher").alias("publisher"), first["citation"].alias("citation"),
        clean.alias("evidence"),
    )


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str], only: Column | None = None) -> DataFrame:
    """UPDATE ... WHERE key IN changes AND only: rows with the changed columns, and whether they changed. Keys of changes are unique.

    Running it on its own result changes nothing more if `only` asks for what the update takes away, as a backfill of nulls does.
    """
    side = changes.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    fits = F.col("_hit").isNotNull() & (F.coalesce(only, F.lit(False)) if only is not None else F.lit(True))
    j = rows.join(side, F.col(key) == F.col("_key"), "left").withColumn("changed", fits)
    return j.withColumns({c: F.when(F.col("changed"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_key", "_hit", *(f"_{c}" for c in columns))


def evidence_of(objects: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """The evidence of the given objects with what is known of its document; evidence of unknown documents stays."""
    return evidence.join(objects.select("ko_id").distinct(), "ko_id", "left_semi").join(documents, "doc_id", "left")


def requested_covered(requested: DataFrame, found: DataFrame, section: str = "section_id") -> DataFrame:
    """requested(prefix) with whether any found section begins with it, and how many distinct ones do. Sections meet prefixes of their own by equality, no pair is compared."""
    ids = found.select(F.col(section).alias("_s")).where("_s IS NOT NULL").distinct()
    starts = ids.select("_s", F.explode(F.transform(F.sequence(F.lit(0), F.length("_s")), lambda n: F.substring("_s", F.lit(1), n))).alias("prefix"))
    wanted = requested.select("prefix").distinct()
    n = starts.join(wanted, "prefix", "left_semi").groupBy("prefix").agg(F.count("*").alias("n"))
    return wanted.join(n, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n_sections"), F.col("n").isNotNull().alias("covered"))


def first_candidates(entries: DataFrame, limit: int) -> DataFrame:
    """The first candidates: the surest, then by document, page and chunk. A report of a fixed length."""
    return entries.orderBy(F.desc("confidence"), "doc_id", "page_no", "chunk_index").limit(limit)


def page_summary(entries: DataFrame, limit: int) -> DataFrame:
    """Of the first candidates, by document: how many, of how many chunks, by which methods."""
    first = cut(first_candidates(entries, limit))
    return first.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("chunk_index").alias("n_chunks"), F.array_join(F.array_sort(F.collect_set(F.coalesce("method", F.lit("unknown")))), ",").alias("methods"))


def apply_state(pending: Column, accepted: Column, error: Column) -> Column:
    """What became of a pack that was to be applied."""
    return F.when(pending > 0, "skipped_pending").when(accepted == 0, "skipped_no_accepted").when(error.isNotNull(), "failed").otherwise("applied")
