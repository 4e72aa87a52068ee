"""Names of one thing under one key: clusters of vectors, tightened, split by facets, joined again and named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions import text as X
from lorekiln.operators.cluster import complete_linkage, similar_pairs, split_by_facets, tightened
from lorekiln.operators.components import cut

#: Thresholds and sizes of the stages.
CLUSTERED, REJOINED, STEP, LAST = 0.90, 0.85, 0.05, 0.95
MOST_NAMES, MOST_TIGHTENED = 10, 8


def _clustered(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows with their cluster under pairs; a row without pairs is its own."""
    found = complete_linkage(pairs.select("a", "b")).toDF("row", "cluster")
    return rows.drop("cluster").join(found, "row", "left").withColumn("cluster", F.coalesce("cluster", "row"))


def _split_oversize(rows: DataFrame, most: int) -> DataFrame:
    """Clusters of more rows than `most` fall apart into their rows."""
    size = F.count("*").over(Window.partitionBy("cluster"))
    return rows.withColumn("_size", size).withColumn("cluster", F.when(F.col("_size") > most, F.col("row")).otherwise(F.col("cluster"))).drop("_size")


def facet_key(axes: list[str], subtype: str | None = None) -> Column:
    """What names must share to be joined again: their facets that are known; with a subtype the first axis does not count. Null without any."""
    parts = []
    for i, a in enumerate(axes):
        known = F.concat(F.lit(f"{i}="), F.col(a))
        parts.append(F.when(F.col(subtype).isNull(), known) if subtype and i == 0 and a != subtype else known)
    return F.when(F.size(F.array_compact(F.array(*parts))) > 0, F.concat_ws("|", *parts))


def named_groups(names: DataFrame, aliases: DataFrame, axes: list[str], vector: str = "vector", subtype: str | None = None, prefix: Column | None = None) -> DataFrame:
    """names(class_id, name, vector, axes...) with cluster and key: one key for the names that mean the same.

    1. Complete linkage at 0.90 among the names of a class, in the order of the names. 2. Clusters of more than 10 are linked anew at 0.95 and
    what is still more than 10 falls apart. 3. Clusters split on each axis; names that lack the first join its only value, names that lack another
    stay by themselves. 4. Of the clusters whose names share one set of known facets, all names of a class with that set are linked anew at 0.85.
    5. Clusters of more than 8 fall apart. 6. A cluster takes the key of its first name that is an alias, else the slug of its first name; `prefix` stands before it.

    Names repeat as one; blank ones are dropped; names without a vector stay by themselves. Rows leave no task whole: pairs come from blocked products,
    linkage places a block of a component at a time, and all else are joins on the cluster.
    """
    cleaned = F.trim(F.col("name"))
    rows = names.where(F.coalesce(cleaned, F.lit("")) != "").withColumn("name", cleaned)
    rows = rows.groupBy("class_id", "name").agg(*(F.first(c, ignorenulls=True).alias(c) for c in [vector, *axes]))
    rows = cut(rows.withColumn("row", F.concat(F.col("class_id").cast("string"), F.lit("\n"), F.col("name"))))
    pairs = cut(similar_pairs(rows.where(F.col(vector).isNotNull()), "row", vector, "class_id", min(CLUSTERED, REJOINED)))
    rows = cut(_clustered(rows.drop(vector), pairs.where(F.col("similarity") >= CLUSTERED)))

    size = F.count("*").over(Window.partitionBy("cluster"))
    large = cut(rows.withColumn("_size", size).where(F.col("_size") > MOST_NAMES).drop("_size"))
    if not large.isEmpty():
        a, b = large.select(F.col("row").alias("a"), F.col("cluster").alias("ca")), large.select(F.col("row").alias("b"), F.col("cluster").alias("cb"))
        inside = pairs.join(a, "a").join(b, "b").where("ca = cb").select("a", "b", "similarity")
        start = min(CLUSTERED + STEP, LAST)
        anew = tightened(large.select("row"), inside.where(F.col("similarity") >= start), "row", start, MOST_TIGHTENED, STEP, LAST)
        anew = _split_oversize(large.drop("cluster").join(anew, "row"), MOST_NAMES)
        rows = rows.join(large.select("row"), "row", "left_anti").unionByName(anew)

    rows = cut(split_by_facets(rows, "cluster", axes).drop("cluster").withColumnRenamed("facet_group", "cluster").withColumn("facets", facet_key(axes, subtype)))
    alike = F.col("facets").isNotNull() & (F.size(F.collect_set("facets").over(Window.partitionBy("cluster"))) == 1) & (F.sum(F.col("facets").isNull().cast("int")).over(Window.partitionBy("cluster")) == 0)
    rows = cut(rows.withColumn("_alike", alike))
    again = rows.where("_alike")
    a, b = (again.select(F.col("row").alias(s), F.col("facets").alias(f"f{s}")) for s in ("a", "b"))
    near = pairs.where(F.col("similarity") >= min(CLUSTERED, REJOINED)).join(a, "a").join(b, "b").where("fa = fb")
    rows = _split_oversize(rows.where(~F.col("_alike")).unionByName(_clustered(again, near)).drop("_alike", "facets"), MOST_TIGHTENED)

    known = aliases.groupBy(F.trim("alias").alias("name")).agg(F.min("key").alias("known_key"))
    rows = cut(rows.join(known, "name", "left"))
    first = F.min(F.when(F.col("known_key").isNotNull(), F.struct("name", "known_key"))).alias("known")
    keys = rows.groupBy("cluster").agg(first, F.min("name").alias("first_name"))
    own = F.coalesce("known.known_key", X.safe_slug(F.col("first_name")))
    out = rows.drop("known_key").join(keys, "cluster")
    key = F.concat(prefix, own) if prefix is not None else own
    return out.select("class_id", "name", *axes, F.col("first_name").alias("cluster"), key.alias("key"))
