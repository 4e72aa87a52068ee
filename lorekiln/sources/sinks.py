"""Sinks: reports, JSON lines, review packs, replaced partitions, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.functions import text as X


def csv_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def review_packs(candidates: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Candidates as JSON by group folders; returns the manifest. Candidates of a group are spread by their hash, so a hot group has several files."""
    candidates.withColumn("_spread", F.pmod(F.xxhash64(*candidates.columns), F.lit(16))).repartition(*keys, "_spread").drop("_spread").write.mode(
        "overwrite"
    ).partitionBy(*keys).json(path)
    return candidates.groupBy(*keys).agg(F.count("*").alias("n_candidates"))


def replace_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrite only the partitions that rows has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def audit_lines(packets: DataFrame, column: str, path: str) -> None:
    """Audit packets as text lines, secrets redacted."""
    packets.select(X.redact(F.col(column)).alias("value")).write.mode("append").text(path)


def markdown_table(rows: DataFrame, limit: int = 50) -> str:
    """The first rows as a Markdown table, for reports."""
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(limit).collect()]
    return "\n".join(lines)
