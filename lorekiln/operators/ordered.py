"""Ranks and running sums within groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.operators.components import cut

_SHIFT = 33  # monotonically_increasing_id holds the partition from this bit on


def ranked(rows: DataFrame, group: list[str], order: list[str | Column], rank: str = "rank", cost: str | None = None, before: str = "used") -> DataFrame:
    """rows with their rank in their group, from 0, and if `cost` is given the sum of that over the group's earlier rows.

    Rows are sorted by group and order over all partitions, numbered there, and a partition's part of a group starts from the totals of the parts before:
    a group that holds most rows is spread like any other. Groups may be null; rows that tie get ranks in an order of their own, fixed once computed.
    """
    placed = cut(rows.orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", _SHIFT))
    total = F.sum(cost) if cost else F.lit(0)
    parts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), total.alias("_cost"))
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a group has a row for each partition that it lies in
    starts = parts.select(
        *(F.col(g).alias(f"_{i}") for i, g in enumerate(group)), F.col("_part").alias("_p"), "_first",
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_ahead"), F.coalesce(F.sum("_cost").over(w), F.lit(0)).alias("_spent"),
    )
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(f"_{i}")) for i, g in enumerate(group)), F.col("_part") == F.col("_p"))
    out = placed.join(starts, same).withColumn(rank, F.col("_at") - F.col("_first") + F.col("_ahead"))
    if cost:
        local = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(before, F.coalesce(F.sum(cost).over(local), F.lit(0)) + F.col("_spent"))
    return out.drop("_at", "_part", "_p", "_first", "_ahead", "_spent", *(f"_{i}" for i in range(len(group))))
