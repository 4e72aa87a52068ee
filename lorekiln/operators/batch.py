"""Batch driving: lanes, budgets, resumption, expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.operators.ordered import ranked


def lanes(items: DataFrame, order: list[str], specs: dict[str, tuple[Column, int, int]]) -> DataFrame:
    """Items in lanes: of those that fit a lane's filter (the first that fits), the ones from an offset on, up to a limit."""
    lane = F.lit(None).cast("string")
    for name, (fits, _, _) in reversed(specs.items()):
        lane = F.when(fits, name).otherwise(lane)
    placed, out = items.withColumn("lane", lane), None
    for name, (_, offset, limit) in specs.items():
        # offset and limit bound what is sorted in one task: each task brings so many rows at most
        first = placed.where(F.col("lane") == name).orderBy(*order).limit(offset + limit)
        ranked_first = first.withColumn("at", F.row_number().over(Window.partitionBy("lane").orderBy(*order)).cast("long") - 1).where(F.col("at") >= offset)
        out = ranked_first if out is None else out.unionByName(ranked_first)
    return out


def expanded_pages(sections: DataFrame, key: str) -> DataFrame:
    """The distinct pages that sections(page_start, page_end) cover."""
    return sections.select(key, F.explode(F.sequence("page_start", "page_end")).alias("page_no")).distinct()


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: tasks replaced by key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def unprocessed(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(done.select(*keys), keys, "left_anti")


def within_budget(rows: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows of a group up to the one that uses its budget up; groups of any size."""
    return ranked(rows, [group], order, "_rank", cost, "used").drop("_rank").where(F.col("used") < budget)


def batches(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    return ranked(rows, [group], order, "_rank").withColumn("batch", F.floor(F.col("_rank") / size).cast("long")).drop("_rank")


def smoke_status(expected: DataFrame, visible: DataFrame, key: str, limit: int) -> DataFrame:
    """Expected and visible counts of each key; a page that has more may show fewer."""
    j = expected.join(visible, key, "full").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("visible", F.lit(0)).alias("visible"))
    status = F.when(F.col("visible") >= F.col("expected"), "passed").when((F.col("visible") == limit) & (F.col("expected") > limit), "passed_partial").otherwise("failed")
    return j.withColumn("status", status)


def missing_expected(found: str = "found", expected: str = "expected") -> Column:
    return F.array_join(F.array_sort(F.array_except(expected, found)), ",")
