"""Sections of documents: islands of headings, outlines, packing, greedy selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heading_sections(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_no, heading) with the number of the section each page lies in.

    A heading opens a section unless it repeats the last one (in any case); pages before the first heading are one section.
    """
    w = Window.partitionBy("doc_id").orderBy("page_no")
    last = F.last(F.lower("heading"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.row_number().over(w) == 1) | (F.col("heading").isNotNull() & ~F.lower("heading").eqNullSafe(last))
    return pages.withColumn("section", F.sum(opens.cast("int")).over(w).cast("long"))


def section_ranges(sectioned: DataFrame) -> DataFrame:
    """First and last page and title of each section."""
    return sectioned.groupBy("doc_id", "section").agg(
        F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.count("*").alias("n_pages"), F.min_by("heading", "page_no").alias("title")
    )


def outline_ends(outline: DataFrame, last_page: str = "last_page") -> DataFrame:
    """An outline entry ends before the next entry of its depth or a higher one, found without looking at all pairs.

    Over the entries of a document from the last, the nearest later start of each depth up to one's own is a running minimum
    by depth, for as many depths as the outlines have.
    """
    deepest = outline.agg(F.max("depth")).first()[0] or 1
    w = Window.partitionBy("doc_id").orderBy("start", "ord").rowsBetween(1, Window.unboundedFollowing)
    nearest = [F.min(F.when(F.col("depth") <= d, F.col("start"))).over(w) for d in range(1, deepest + 1)]
    ended = outline.withColumn("nearest", F.array(*nearest))
    own = F.get("nearest", F.greatest(F.col("depth"), F.lit(1)).cast("int") - 1)
    return ended.withColumn("page_end", F.greatest(F.coalesce(own - 1, F.col(last_page)), F.col("start"))).drop("nearest")


def pages_in_sections(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, page_no, section) by the range page_start..page_end: sections are exploded to pages and joined by value."""
    spread = sections.select("doc_id", "section", F.explode(F.sequence("page_start", "page_end")).alias("page_no"))
    return pages.join(spread, ["doc_id", "page_no"])


def pack(rows: DataFrame, most: int, least: int) -> DataFrame:
    """rows(doc_id, ord, tokens, is_heading) with the pack each falls in.

    A pack closes when the next row would take it over `most` tokens, or before a heading once it has `least`. It is a fold over a
    document's rows; only their sizes are collected, a document at a time.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        packs, size, number = [], 0, 0
        for tokens, heading in zip(pdf["tokens"], pdf["is_heading"], strict=True):
            if size and (size + tokens > most or (heading and size >= least)):
                number, size = number + 1, 0
            size += tokens
            packs.append(number)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "ord": pdf["ord"], "pack": packs})

    kinds = dict(rows.dtypes)
    return rows.select("doc_id", "ord", "tokens", "is_heading").groupBy("doc_id").applyInPandas(
        fold, f"doc_id {kinds['doc_id']}, ord {kinds['ord']}, pack long"
    )


def select_within(sections: DataFrame, max_sections: int, max_pages: int) -> DataFrame:
    """sections(doc_id, section, score, pages): by falling score, each one that still fits both budgets."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "section"], ascending=[False, True])
        taken, pages, keep = 0, 0, []
        for p in pdf["pages"]:
            ok = taken < max_sections and pages + p <= max_pages
            keep.append(ok)
            if ok:
                taken, pages = taken + 1, pages + p
        return pdf[keep]

    return sections.groupBy("doc_id").applyInPandas(fold, sections.schema)


MOST_CHARS = 1000  # of a chunk


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def chunk_array(text: Column, most: int = MOST_CHARS) -> Column:
    """A page's paragraphs as an array; a longer one is repacked by its sentences, each closed by a full stop, in a fold that stays in the JVM."""
    empty = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, sentence: Column) -> Column:
        closed = F.concat(sentence, F.lit(". "))
        fits = F.length(state["held"]) + F.length(sentence) <= most
        done = F.when(state["held"] == "", state["out"]).otherwise(F.array_append(state["out"], _stripped(state["held"])))
        return F.when(fits, F.struct(F.concat(state["held"], closed).alias("held"), state["out"].alias("out"))).otherwise(F.struct(closed.alias("held"), done.alias("out")))

    def end(state: Column) -> Column:
        return F.when(state["held"] == "", state["out"]).otherwise(F.array_append(state["out"], _stripped(state["held"])))

    repacked = lambda p: F.aggregate(F.split(p, r"\. ", -1), empty, add, end)
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(repacked(p))))


def page_chunks(pages: DataFrame, keys: list[str], text: str = "text", most: int = MOST_CHARS) -> DataFrame:
    """keys, chunk_index, text and excerpt of the chunks of every page; blank ones are left out and keep their number, from 0."""
    each = pages.select(*keys, F.posexplode(chunk_array(F.col(text), most)).alias("chunk_index", "text"))
    return each.where(_stripped(F.col("text")) != "").select(*keys, F.col("chunk_index").cast("long"), "text", F.substring("text", 1, 200).alias("excerpt"))


def chunk_page(text: str | None, most: int = 1000) -> list[str]:
    """chunk_array of one text, in plain Python."""
    out = []
    for para in (text or "").split("\n\n"):
        if len(para) <= most:
            out.append(para)
            continue
        held = ""
        for sentence in para.split(". "):
            if held and len(held) + len(sentence) > most:
                out.append(held.strip())
                held = ""
            held += sentence + ". "
        if held.strip():
            out.append(held.strip())
    return out


def cap_in_order(rows: DataFrame, bucket: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each bucket."""
    w = Window.partitionBy(*bucket).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= n)


def overlapping_ranges(ranges: DataFrame, doc: str, first: str, last: str, key: str) -> DataFrame:
    """ranges that begin before an earlier one of their document has ended, with the key of the one that reaches furthest: a sweep by first page, without pairs."""
    w = Window.partitionBy(doc).orderBy(first, last, key).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.struct(F.col(last).alias("reach"), F.col(key).alias("over"))).over(w)
    return ranges.withColumn("_before", reach).where(F.col("_before.reach") >= F.col(first)).select(doc, key, first, last, F.col("_before.over").alias("overlaps"), F.col("_before.reach").alias("reach"))
