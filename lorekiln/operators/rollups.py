"""Counts, rates, gates and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_counts(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages and chunks of each document; both sides are counted before the joins, so nothing fans out."""
    p = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return documents.join(p, "doc_id", "left").join(c, "doc_id", "left").select("doc_id", zero("n_pages"), zero("n_chunks"))


def anchor_counts(anchors: DataFrame) -> DataFrame:
    """Distinct chunks of each (document, class)."""
    return anchors.groupBy("doc_id", "class_id").agg(F.countDistinct("chunk_id").alias("n_chunks"))


def hit_rate(chunks: DataFrame, matched: Column, candidate: Column) -> DataFrame:
    """Scanned and matched chunks and candidates of each document, with the rate."""
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("scanned"),
        F.sum(matched.cast("long")).alias("matched"),
        F.sum(candidate.cast("long")).alias("candidates"),
        F.bround(F.avg(matched.cast("double")), 3).alias("hit_rate"),
    )


def status_pivot(rows: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(*(F.sum((F.col(status) == v).cast("long")).alias(f"n_{v.lower()}") for v in values), F.count("*").alias("n_all"))


def gate(name: str, part: Column, whole: Column, threshold: float) -> list[Column]:
    """A rate in percent and whether it passes."""
    rate = F.when(whole > 0, F.bround(100.0 * part / whole, 2)).otherwise(0.0)
    return [rate.alias(f"{name}_rate"), F.when(rate >= threshold, "PASS").otherwise("FAIL").alias(f"{name}_status")]


def token_cost(calls: DataFrame, key: str, in_price: float, out_price: float) -> DataFrame:
    """Tokens and cost of calls, prices for a thousand tokens."""
    return calls.groupBy(key).agg(
        F.count("*").alias("calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.bround((F.sum("tokens_in") * in_price + F.sum("tokens_out") * out_price) / 1000, 6).alias("cost"),
    )


def coverage(present: DataFrame, key: str, kind: str, supported: list[str]) -> DataFrame:
    """Covered and missing kinds of each key, and its status."""
    have = F.array_sort(F.array_intersect(F.array(*map(F.lit, supported)), F.collect_set(kind)))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, supported)), F.collect_set(kind)))
    return present.groupBy(key).agg(
        F.array_join(have, ",").alias("covered"),
        F.array_join(missing, ",").alias("missing"),
        F.when(F.size(have) == 0, "uncovered").when(F.size(missing) > 0, "partial").otherwise("covered").alias("status"),
    )


def overlap_matrix(items: DataFrame, run: str, item: str, runs: list) -> DataFrame:
    """Common, left-only and right-only items of every two runs, from one pivoted row an item: no pair of items is formed."""
    flags = items.groupBy(item).agg(*(F.max((F.col(run) == r).cast("int")).alias(f"r{i}") for i, r in enumerate(runs)))
    pairs = [(i, j) for i in range(len(runs)) for j in range(i + 1, len(runs))]
    both = lambda i, j: F.sum(F.col(f"r{i}") * F.col(f"r{j}")).cast("long")
    sums = flags.agg(*(x for i, j in pairs for x in (both(i, j).alias(f"b{i}_{j}"),)), *(F.sum(f"r{i}").cast("long").alias(f"s{i}") for i in range(len(runs))))
    rows = F.array(
        *(
            F.struct(
                F.lit(runs[i]).alias("left_run"), F.lit(runs[j]).alias("right_run"), F.col(f"b{i}_{j}").alias("common"),
                (F.col(f"s{i}") - F.col(f"b{i}_{j}")).alias("left_only"), (F.col(f"s{j}") - F.col(f"b{i}_{j}")).alias("right_only"),
            )
            for i, j in pairs
        )
    )
    return sums.select(F.inline(rows))
