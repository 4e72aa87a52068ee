"""From chunks to typed candidates, and from quotes back to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions import text as X
from lorekiln.functions import values as V
from lorekiln.operators.substrings import holding


def containment(chunks: DataFrame, terms: DataFrame, chunk_key: str = "chunk_id") -> DataFrame:
    """(chunk_key, term) wherever a chunk's words hold a term's words in a row.

    A theta join made equi: a chunk is exploded to its word runs of the terms' lengths, which join the terms by value, so
    the term list may be of any size. Terms are compared as words, lower-cased.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    t = terms.select("term", F.array_join(words(F.col("term")), " ").alias("run"), F.size(words(F.col("term"))).alias("n")).where("n > 0").distinct()
    sizes = [r.n for r in t.select("n").distinct().orderBy("n").collect()]
    w = chunks.select(chunk_key, words(F.col("text")).alias("w"))
    none = F.array().cast("array<string>")

    def of_length(n: int):
        if n == 1:
            return F.col("w")
        starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
        return F.when(F.size("w") >= n, F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(none)

    runs = F.array_distinct(F.concat(*map(of_length, sizes))) if sizes else none
    return w.select(chunk_key, F.explode(runs).alias("run")).join(t, "run").select(chunk_key, "term")


def best_matches(matches: DataFrame, n: int = 4, key: str = "chunk_id") -> DataFrame:
    """The best scored term of each chunk and its next alternatives, by rank."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "term")
    return matches.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def merge_lanes(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate a key: the model's lane before the rules', then confidence, then order."""
    w = Window.partitionBy(*keys).orderBy(F.desc("is_model"), F.desc("confidence"), "ord")
    return candidates.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def context_window(rows: DataFrame, doc: str, order: list[str], radius: int = 1, text: str = "text", out: str = "context") -> DataFrame:
    """Each row's text between those of its neighbours in the document."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(-radius, radius)
    return rows.withColumn(out, F.array_join(F.collect_list(text).over(w), "\n\n"))


def quotes_in(texts: DataFrame, quotes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(quote_id, key) wherever a text holds a quote, both in normal form."""
    q = quotes.select("quote_id", X.anchor(F.col("quote")).alias("string"))
    t = texts.select(key, X.anchor(F.col("text")).alias("text"))
    return holding(t, q, [key]).select("quote_id", key)


def quotes_across(chunks: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, doc_id, chunk_index) where a quote lies across a chunk and the next of its document, in normal form, and in neither alone."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    both = chunks.select("doc_id", "chunk_index", "text", F.lead("text").over(w).alias("next")).where("next IS NOT NULL")
    both = both.select("doc_id", "chunk_index", X.anchor(F.col("text")).alias("a"), X.anchor(F.col("next")).alias("b"))
    q = quotes.select("quote_id", X.anchor(F.col("quote")).alias("string"))
    keys = ["doc_id", "chunk_index"]
    found = holding(both.withColumn("text", F.concat("a", "b")), q, keys).join(both, keys)
    return found.where(~F.contains("a", "string") & ~F.contains("b", "string")).select("quote_id", *keys)


def repair_terms(values: list[Column]) -> Column:
    """The parts of a candidate's codes and names that may stand for its quote: three characters or more in normal form, or letters and a number."""
    parts = F.flatten(F.array(*(F.split(F.coalesce(v, F.lit("")), r"[/,，、\s]+") for v in values)))
    terms = F.transform(parts, X.anchor)
    return F.array_distinct(F.filter(terms, lambda t: (F.length(t) >= 3) | t.rlike("^[a-z]+\\d+")))


def anchored(candidates: DataFrame, chunks: DataFrame, names: list[str]) -> DataFrame:
    """candidates(candidate_id, doc_id, quote, names...) with the chunks of their document that back them.

    chunks(doc_id, chunk_id, chunk_index, page_no, text). A candidate stands on the chunks that hold its quote in normal form, else on
    those that hold one of its repair terms, and is else rejected. Returns candidate_id, chunk_id and page_no of the first, n_chunks, reason: verbatim,
    repaired or rejected.
    """
    quote = X.anchor(F.coalesce("quote", F.lit("")))
    asked = candidates.select("candidate_id", "doc_id", quote.alias("string"), F.lit("verbatim").alias("reason")).unionByName(
        candidates.select("candidate_id", "doc_id", F.explode(repair_terms([F.col(n) for n in names])).alias("string"), F.lit("repaired").alias("reason"))
    )
    text = chunks.select("doc_id", "chunk_id", "chunk_index", "page_no", X.anchor(F.col("text")).alias("text"))
    held = holding(text, asked, ["chunk_id", "chunk_index", "page_no"], within=("doc_id",))
    # first by document, where what is held already lies
    chunk = held.groupBy("doc_id", "candidate_id", "reason", "chunk_id").agg(F.min("chunk_index").alias("chunk_index"), F.min("page_no").alias("page_no"))
    first, n = F.min(F.struct("chunk_index", "chunk_id")).alias("first"), F.count("*").alias("n_chunks")
    by_doc = chunk.groupBy("doc_id", "candidate_id", "reason").agg(first, F.min("page_no").alias("page_no"), n)
    backed = by_doc.groupBy("candidate_id", "reason").agg(F.min("first").alias("first"), F.min("page_no").alias("page_no"), F.sum("n_chunks").alias("n_chunks"))
    # verbatim before repaired
    best = backed.groupBy("candidate_id").agg(F.max_by(F.struct("first.chunk_id", "page_no", "n_chunks", "reason"), "reason").alias("b")).select("candidate_id", "b.*")
    found = candidates.select("candidate_id").join(best, "candidate_id", "left")
    return found.select("candidate_id", "chunk_id", "page_no", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("reason", F.lit("rejected")).alias("reason"))


def rule_candidates(chunks: DataFrame, pattern: str, kind: str, base: float, bonus: float, equipment: float = 1.0) -> DataFrame:
    """One candidate for each distinct code of each chunk."""
    codes = X.distinct_matches(F.col("text"), pattern)
    return chunks.select("chunk_id", "doc_id", F.explode(codes).alias("code")).select(
        "chunk_id",
        "doc_id",
        F.lit(kind).alias("kind"),
        "code",
        V.candidate_confidence(base, bonus, F.lit(equipment)).alias("confidence"),
        X.stable_id("cand", F.col("chunk_id"), F.lit(kind), F.col("code")).alias("candidate_id"),
    )
