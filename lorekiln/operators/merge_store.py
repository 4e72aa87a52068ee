"""A merge that writes: groups of names go into a store of objects, with their evidence, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.operators.components import cut
from lorekiln.sources.sinks import replace_partitions

#: States of consensus that ask for a review, and its status.
IN_CONFLICT, REVIEW, FRESH = ("over_merge", "material_conflict"), "conflict_review_required", "draft"


def new_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("::", *parts)), 1, 16))


def assigned(groups: DataFrame, members: DataFrame, objects: DataFrame, names: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., key, ko_id, action, removed): the object of each group, and the ids that go into it.

    A name is the object's that had it last (the largest id). Groups take objects in the order of their keys: an object goes to the first group that has one of its names,
    unless a group before that one has the object's own key and so takes it over. A group keeps the smallest of the ids that it has by name, else by key; the others go. Without any it is new.
    """
    at = objects.select(*scope, "ko_id", F.col("key").alias("own_key"))
    owner = at.join(names, "ko_id").groupBy(*scope, "name").agg(F.max("ko_id").alias("ko_id"))
    by_name = members.select(*scope, "key", "name").distinct().join(owner, [*scope, "name"]).groupBy("ko_id").agg(F.min("key").alias("h"))
    by_key = at.join(groups.select(*scope, F.col("key").alias("own_key")), [*scope, "own_key"]).select("ko_id", F.col("own_key").alias("g"))
    taken = F.col("g").isNotNull() & (F.col("h").isNull() | (F.col("g") < F.col("h")))
    claims = at.join(by_name, "ko_id", "left").join(by_key, "ko_id", "left").where("h IS NOT NULL OR g IS NOT NULL").select(
        *scope, "ko_id", F.when(taken, F.col("g")).otherwise(F.col("h")).alias("key"), taken.alias("taken")
    )
    held = claims.groupBy(*scope, "key").agg(
        F.array_sort(F.collect_set(F.when(~F.col("taken"), F.col("ko_id")))).alias("named"), F.array_sort(F.collect_set(F.when(F.col("taken"), F.col("ko_id")))).alias("keyed")
    )
    all_ids = F.concat("named", "keyed")
    n = F.coalesce(F.size("named"), F.lit(0))
    action = F.when(n >= 2, "merged_existing").when(n == 1, "updated_existing").when(F.size("keyed") > 0, "adopted_key").otherwise("new_merged")
    return groups.select(*scope, "key").join(held, [*scope, "key"], "left").select(
        *scope, "key", F.coalesce(F.get(all_ids, F.lit(0)), new_id("ko_", *scope, "key")).alias("ko_id"), action.alias("action"),
        F.coalesce(F.slice(all_ids, F.lit(2), F.greatest(F.size(all_ids) - 1, F.lit(0))), F.array().cast("array<string>")).alias("removed"),
    )


def merge_into_store(
    groups: DataFrame, members: DataFrame, new_evidence: DataFrame, objects: DataFrame, names: DataFrame, evidence: DataFrame, scope: list[str]
) -> dict[str, DataFrame]:
    """The store after a merge: objects, names, evidence; and moved(ko_id, into), the objects that are gone.

    groups(scope..., key, title, state, confidence), members(scope..., key, name), where a name has one group of its scope, new_evidence(scope..., key, chunk_id, role);
    objects(scope..., ko_id, key, title, status, confidence, primary_chunk), names(ko_id, name), evidence(evidence_id, ko_id, chunk_id, role); ko_id a string.
    A group's object gets its key and title, the higher confidence, its first new chunk where it has no primary one, and a review status if the group's state is a conflict. Evidence
    moves with its object and stands once for each chunk and role: the object's own before what moved before what is new, then the least id. A name of a
    group is its object's alone. Other objects stay as they are. Merging the same groups again changes nothing.
    """
    target = cut(assigned(groups, members, objects, names, scope))
    moved = cut(target.select(F.explode("removed").alias("ko_id"), F.col("ko_id").alias("into")))
    keys = [*scope, "key"]
    first = new_evidence.groupBy(*keys).agg(F.min("chunk_id").alias("first_chunk"))
    old = objects.select("ko_id", F.col("status").alias("_status"), F.col("confidence").alias("_confidence"), F.col("primary_chunk").alias("_chunk"))
    written = groups.join(target.select(*keys, "ko_id"), keys).join(old, "ko_id", "left").join(first, keys, "left").select(
        *scope, "ko_id", "key", "title", F.when(F.col("state").isin(*IN_CONFLICT), REVIEW).otherwise(F.coalesce("_status", F.lit(FRESH))).alias("status"),
        F.greatest("confidence", "_confidence").alias("confidence"), F.coalesce("_chunk", "first_chunk").alias("primary_chunk"),
    )
    gone = target.select("ko_id").unionByName(moved.select("ko_id"))
    kept = objects.join(gone, "ko_id", "left_anti").select(written.columns)

    into = lambda rows: rows.join(moved, "ko_id", "left").withColumn("moved", F.col("into").isNotNull()).withColumn("ko_id", F.coalesce("into", "ko_id")).drop("into")
    named = members.select(*keys, "name").distinct().join(target.select(*keys, "ko_id"), keys)
    where = kept.unionByName(written).select("ko_id", *scope)
    others = into(names).drop("moved").distinct().join(where, "ko_id").join(named.select(*scope, "name"), [*scope, "name"], "left_anti")
    fresh = new_evidence.select(*keys, "chunk_id", "role").distinct().join(target.select(*keys, "ko_id"), keys)
    fresh = fresh.select(new_id("ev_", "ko_id", F.col("chunk_id").cast("string"), "role").alias("evidence_id"), "ko_id", "chunk_id", "role", F.lit(2).alias("rank"))
    every = into(evidence).withColumn("rank", F.col("moved").cast("int")).drop("moved").unionByName(fresh)
    once = every.groupBy("ko_id", "chunk_id", "role").agg(F.min_by("evidence_id", F.struct("rank", "evidence_id")).alias("evidence_id"))
    return {
        "objects": kept.unionByName(written),
        "names": others.select("ko_id", "name").unionByName(named.select("ko_id", "name")),
        "evidence": once.select("evidence_id", "ko_id", "chunk_id", "role"),
        "moved": moved,
    }


def write_store(store: dict[str, DataFrame], folder: str, partition: str) -> None:
    """Write a store's tables, each partition of `partition` (a column of objects) as a whole; a run that was cut off is simply run again."""
    at = store["objects"].select("ko_id", partition)
    replace_partitions(store["objects"], f"{folder}/objects", [partition])
    for table in ("names", "evidence"):
        replace_partitions(store[table].join(at, "ko_id"), f"{folder}/{table}", [partition])
