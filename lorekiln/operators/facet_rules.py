"""Keyword rules as a table: a rule gives an axis a value, and the rule with the longest keyword wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.operators.substrings import SENT, few, holding, scanner


def payload_text(name: Column, fields: list[Column]) -> Column:
    """What rules look at: a name and the fields of its payload that are there, lower-cased."""
    return F.lower(F.concat_ws(" ", name, *(f.cast("string") for f in fields)))


def prepared(rules: DataFrame) -> DataFrame:
    """rules(axis, value, keyword, ord) with their priority: a value's longest keyword decides, then the order of the values."""
    known = rules.select("axis", "value", F.lower(F.trim("keyword")).alias("keyword"), "ord").where("keyword <> '' AND value IS NOT NULL")
    w = Window.partitionBy("axis", "value")
    return known.withColumn("longest", F.max(F.length("keyword")).over(w)).withColumn("ord", F.min("ord").over(w)).distinct()


def facets(texts: DataFrame, rules: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, axis, value): of each axis the value of the first rule that has a keyword in the text, rules with the longest keyword first.

    Keywords are found by characters, anywhere in the text; there may be any number of rules and of axes. Where the rules are few enough to be sent to the
    tasks, a text gives one row for each axis, else one for each rule that it fits.
    """
    known, texts = prepared(rules).withColumnRenamed("keyword", "string"), texts.select(key, F.lower(text).alias("text"))
    order = F.struct((-F.col("longest")).alias("l"), "ord", "value")
    words = few(known, "string") if known.limit(SENT + 1).count() <= SENT else None
    if words is None:
        return holding(texts, known, [key]).groupBy(key, "axis").agg(F.min_by("value", order).alias("value"))
    known = known.withColumn("rank", F.dense_rank().over(Window.partitionBy("axis").orderBy(order)))
    rows = known.select("axis", "string", "rank").distinct().collect()
    axes = sorted({r.axis for r in rows if r.axis is not None}) + [None]
    at, axis_at = {w: i for i, w in enumerate(words)}, {a: i for i, a in enumerate(axes)}
    held = np.array(sorted((at[r.string], axis_at[r.axis], r.rank) for r in rows), np.int64).reshape(-1, 3)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = scanner(words)
        first, to = np.searchsorted(held[:, 0], np.arange(len(words))), np.searchsorted(held[:, 0], np.arange(len(words)), "right")
        for b in batches:
            row, which = found(b.column(1))
            n = (to - first)[which]
            rule = held[np.repeat(first[which] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
            place, rank = np.repeat(row, n) * len(axes) + rule[:, 1], rule[:, 2]
            order = np.lexsort((rank, place))
            place, one = np.unique(place[order], return_index=True)
            yield pa.RecordBatch.from_arrays([b.column(0).take(place // len(axes)), pa.array(place % len(axes), pa.int32()), pa.array(rank[order][one], pa.int32())], names=[key, "_axis", "rank"])

    ranks = texts.mapInArrow(best, texts.select(key).withColumns({"_axis": F.lit(0), "rank": F.lit(0)}).schema)
    ranks = ranks.groupBy(key, "_axis").agg(F.min("rank").alias("rank"))
    table = F.array(*(F.lit(a).cast("string") for a in axes))
    values = known.select(F.col("axis").alias("_of"), F.col("rank").alias("_rank"), "value").distinct()
    axis = ranks.withColumn("axis", F.get(table, F.col("_axis")))
    return axis.join(F.broadcast(values), F.col("axis").eqNullSafe(F.col("_of")) & (F.col("rank") == F.col("_rank"))).select(key, "axis", "value")


def signature(texts: DataFrame, rules: DataFrame, key: str, axes: list[str], text: str = "text") -> DataFrame:
    """texts with a column for each axis, null where no rule fits."""
    wide = facets(texts, rules.where(F.col("axis").isin(axes)), key, text).groupBy(key).pivot("axis", axes).agg(F.first("value"))
    return texts.join(wide, key, "left")


def descendants(points: DataFrame) -> DataFrame:
    """(tag, ancestor, depth) of points(tag, parent): a rule's parents, as deep as the table is."""
    step = points.where("parent IS NOT NULL").select("tag", F.col("parent").alias("ancestor")).withColumn("depth", F.lit(1))
    out = step
    while not step.isEmpty():
        up = points.where("parent IS NOT NULL").select(F.col("tag").alias("ancestor"), F.col("parent").alias("next"))
        step = step.join(up, "ancestor").select("tag", F.col("next").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
        step = step.where("tag <> ancestor").join(out.select("tag", "ancestor"), ["tag", "ancestor"], "left_anti")
        out = out.unionByName(step)
    return out
