"""Tables of a reviewer's console: packs of candidates, documents, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions import facets
from lorekiln.operators import lookup


def blank(x: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.when(F.trim(x) != "", F.trim(x))


def compact_display(x: Column, limit: int) -> Column:
    """One line of at most `limit` characters, with dots where it is cut."""
    t = F.trim(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit("...")))


def review_center(entries: DataFrame, assets: DataFrame) -> DataFrame:
    """entries with the title and summary that a reviewer sees: their own, else the traced asset's, else a cut of their text.

    entries(doc, chunk, kind, title, summary, excerpt, key_candidate), assets(doc, chunk, kind, asset, title, summary). The last
    asset (the largest id) of a document, chunk and kind is the traced one; null keys trace nothing.
    """
    trace = ["doc", "chunk", "kind"]
    last = assets.groupBy(*trace).agg(F.max_by(F.struct("title", "summary"), "asset").alias("traced"))
    excerpt = F.coalesce("excerpt", F.lit(""))
    cut = F.when(excerpt.rlike("[一-鿿]"), compact_display(excerpt, 28)).otherwise(F.coalesce("key_candidate", F.lit("")))
    title = F.coalesce(blank(F.col("title")), F.when(F.col("traced.title") != "", F.col("traced.title")), cut)
    summary = F.coalesce(blank(F.col("summary")), F.when(F.col("traced.summary") != "", F.col("traced.summary")), compact_display(excerpt, 80))
    return entries.join(last, trace, "left").withColumns({"title": title, "summary": summary, "traced": F.col("traced").isNotNull()})


def review_state(x: Column) -> Column:
    return F.when(x.isin("approved", "accepted"), "accepted").when(x.isin("rejected", "review_ready"), x).otherwise("pending")


def document_console(documents: DataFrame, chunks: DataFrame, targets: DataFrame, links: DataFrame) -> DataFrame:
    """Every document with its status, its classes and its number of linked assets.

    documents(doc, parse_status), chunks(doc), targets(doc, class_id) of anchors, links(doc, asset, class_id) of assets' evidence. A
    document without targets takes the classes of its linked assets. Each side is aggregated before it is joined.
    """
    n = chunks.groupBy("doc").agg(F.count("*").alias("n_chunks"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    t = targets.groupBy("doc").agg(joined("class_id").alias("anchored"))
    k = links.groupBy("doc").agg(joined("class_id").alias("linked"), F.countDistinct("asset").alias("n_linked"))
    j = documents.join(n, "doc", "left").join(t, "doc", "left").join(k, "doc", "left")
    status = F.when(F.col("n_chunks") > 0, "chunked").when(F.col("parse_status").isin("completed", "parsed"), "parsed").otherwise("imported")
    return j.select(
        "doc", status.alias("status"), F.coalesce("anchored", "linked", F.lit("")).alias("classes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")
    )


def class_labels(objects: DataFrame, labels: DataFrame, language: str) -> DataFrame:
    """The label of each (domain, class) of objects in a language, else the class's first label, else its id; classes without an entry go."""
    pairs = objects.select("domain", "class_id").distinct()
    return pairs.join(labels, "class_id").select("domain", "class_id", F.coalesce(blank(F.col(language)), "primary_label", "class_id").alias("label"))


def pack_edits(stored: DataFrame, edited: DataFrame, fixed: list[str], stored_entries: DataFrame, edited_entries: DataFrame) -> DataFrame:
    """(pack, fault) of edited packs: the first fault that forbids to save one, null if none.

    A pack must exist with the same `fixed` columns, in their order, and hold the same candidates; an accepted entry needs a title and a summary.
    entries(pack, candidate, decision, title, summary). Sets of candidates are compared by rows, not as arrays.
    """
    sides = stored_entries.select("pack", "candidate", F.lit(0).alias("side")).unionByName(edited_entries.select("pack", "candidate", F.lit(1).alias("side")))
    moved = sides.groupBy("pack", "candidate").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a = b").select("pack").distinct()
    bad = (F.col("decision") == "accepted") & (blank(F.col("title")).isNull() | blank(F.col("summary")).isNull())
    unfinished = edited_entries.where(bad).select("pack").distinct()
    s = stored.select("pack", *(F.col(c).alias(f"_{c}") for c in fixed), F.lit(True).alias("_known"))
    j = edited.join(s, "pack", "left").join(moved.withColumn("_moved", F.lit(True)), "pack", "left").join(unfinished.withColumn("_open", F.lit(True)), "pack", "left")
    fault = F.when(F.col("_known").isNull(), "unknown_pack")
    for c in fixed:
        fault = fault.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"{c}_changed")
    return j.select("pack", fault.when(F.col("_moved"), "candidates_changed").when(F.col("_open"), "unfinished_entry").alias("fault"))


def accepted_identity(entries: DataFrame) -> DataFrame:
    """(pack, n_accepted, class_id, fault) of packs: their accepted entries must be there and of one class."""
    ok = F.col("decision") == "accepted"
    kinds = F.count_distinct(F.when(ok, F.col("class_id")))
    n = F.count_if(ok)
    g = entries.groupBy("pack").agg(n.alias("n_accepted"), kinds.alias("kinds"), F.max(F.when(ok, F.col("class_id"))).alias("one"))
    fault = F.when(F.col("n_accepted") == 0, "no_accepted").when(F.col("kinds") != 1, "several_classes")
    return g.select("pack", "n_accepted", F.when(fault.isNull(), F.col("one")).alias("class_id"), fault.alias("fault"))


def supporting_evidence(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each source chunk of an entry after its first: entries(candidate, doc, chunk_ids), chunks(chunk, chunk_doc).

    `fault` says that the chunk is of another document or not there.
    """
    rest = F.slice("chunk_ids", F.lit(2), F.greatest(F.size("chunk_ids") - 1, F.lit(0)))
    rows = entries.select("candidate", "doc", F.posexplode(rest).alias("pos", "chunk")).join(chunks, "chunk", "left")
    fault = F.when(F.col("chunk_doc").isNull(), "unknown_chunk").when(F.col("chunk_doc") != F.col("doc"), "other_document")
    return rows.select("candidate", (F.col("pos") + 2).cast("long").alias("place"), "chunk", fault.alias("fault"))


def review_queue(documents: DataFrame) -> DataFrame:
    """documents(doc, file_name, file_ext, text_quality, page_count as text, decision) for manual review, and the lists they are on."""
    name, ext = F.lower(F.coalesce("file_name", F.lit(""))), F.ltrim(F.lower(F.coalesce("file_ext", F.lit(""))), F.lit("."))
    pages = F.floor(F.coalesce(F.expr("try_cast(page_count AS double)"), F.lit(0.0)))
    word = ext.isin("doc", "docx") & (F.contains(name, F.lit("gb")) | F.contains(name, F.lit("标准")))
    large = F.lower(F.coalesce("text_quality", F.lit(""))).isin("unknown", "") & (pages >= 50)
    return documents.where("decision = 'MANUAL_REVIEW'").select("doc", word.alias("gb_word"), large.alias("unknown_large"))


def object_candidates(objects: DataFrame, evidence: DataFrame, by_chunk: DataFrame, by_doc: DataFrame) -> DataFrame:
    """A candidate for each evidence row of an object, one for an object without any.

    objects(ko_id, title, authority), evidence(ko_id, chunk_id, doc_id, quote); layers are structs (name, summary, authority) of the
    chunk, else of the document. The layer's name stands if it can be a name, else the object's title; the summary is the quote, else the layer's, else the name.
    """
    layered = lookup.layers_of_evidence(evidence, by_chunk, by_doc)
    name = F.when(facets.like_a_name(F.col("layer.name")), F.trim("layer.name")).otherwise(F.col("title"))
    full = lambda c: F.when(c != "", c)
    return objects.join(layered, "ko_id", "left").select(
        "ko_id", "chunk_id", name.alias("title"), F.coalesce(full(F.col("quote")), full(F.col("layer.summary")), name).alias("summary"),
        F.coalesce("layer.authority", "authority").alias("authority"),
    )
