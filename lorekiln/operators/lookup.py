"""Lookups: cascades of unique keys, registries of names, keys that must exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions import text as X


def _packed(key: Column) -> Column:
    """A key as bytes, other keys other bytes; one of hexadecimal digits takes half of its length."""
    text = key.cast("string")
    return F.when(text.rlike(r"^([0-9a-f]{2})+\z"), F.concat(F.unhex(F.lit("00")), F.unhex(text))).otherwise(F.concat(F.unhex(F.lit("01")), F.encode(text, "UTF-8")))


def cascade(rows: DataFrame, targets: DataFrame, keys: list[tuple[str, str]], target: str, row: str, found_only: bool = False) -> DataFrame:
    """rows with the target and the name of the key that found it; keys are (column of rows, column of targets) and tried in turn.

    A key finds a target only if one target alone has its value; a row without any has nulls. Each key is one equi-join with an
    aggregate of the targets by that key. With found_only rows without a target are left out, `row` is unique and keys are strings: then all keys are
    looked up in one join to which a row goes as a short row for each key that it has.
    """
    if found_only:
        listed = lambda columns: F.inline(F.array(*(F.struct(F.lit(i).cast("tinyint").alias("_by"), _packed(F.col(c)).alias("_key")) for i, c in enumerate(columns))))
        known = targets.select(F.col(target).alias("target"), listed([theirs for _, theirs in keys])).where("_key IS NOT NULL")
        unique = known.groupBy("_by", "_key").agg(F.count("*").alias("_n"), F.min("target").alias("target")).where("_n = 1").drop("_n")
        asked = rows.select(row, listed([mine for mine, _ in keys])).where("_key IS NOT NULL")
        hits = asked.join(unique.where("target IS NOT NULL"), ["_by", "_key"]).select(row, "_by", "target")
        first = hits.groupBy(row).agg(*(F.min(F.when(F.col("_by") == i, F.col("target"))).alias(f"_t{i}") for i in range(len(keys))))
        by = F.coalesce(*(F.when(F.col(f"_t{i}").isNotNull(), mine) for i, (mine, _) in enumerate(keys)))
        return first.select(row, F.coalesce(*(f"_t{i}" for i in range(len(keys)))).alias("target"), by.alias("matched_by"))
    out, found, by = rows, F.lit(None), F.lit(None).cast("string")
    names = []
    for i, (mine, theirs) in enumerate(keys):
        unique = targets.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(f"_k{i}")).agg(F.count("*").alias("_n"), F.min(target).alias(f"_t{i}")).where("_n = 1").drop("_n")
        out = out.join(unique, F.col(mine) == F.col(f"_k{i}"), "left")
        names.append((f"_t{i}", mine))
    for column, name in reversed(names):
        found = F.when(F.col(column).isNotNull(), F.col(column)).otherwise(found)
        by = F.when(F.col(column).isNotNull(), name).otherwise(by)
    return out.select(row, found.alias("target"), by.alias("matched_by"))


def first_registered(names: DataFrame, registry: DataFrame) -> DataFrame:
    """names(name) with the key that the registry(name, key, ord) has for each in its order, null if none; case and white space do not matter."""
    norm = X.squeeze(F.col("name"))
    r = registry.select(norm.alias("norm"), "key", "ord").groupBy("norm").agg(F.min_by("key", "ord").alias("key"))
    return names.withColumn("norm", norm).join(r, "norm", "left").drop("norm")


def registered(batches: DataFrame) -> DataFrame:
    """A registry after batches(name, key, seq): a name belongs to the key that registered it last."""
    w = Window.partitionBy("name").orderBy(F.desc("seq"), "key")
    return batches.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("name", "key")


def resolved(names: DataFrame, terminology: DataFrame, registry: DataFrame) -> DataFrame:
    """names(name) with their key and where it is from: terminology, else registry, else the name's own slug."""
    t = first_registered(names, terminology).withColumnRenamed("key", "term_key")
    both = first_registered(t, registry).withColumnRenamed("key", "known_key")
    origin = F.when(F.col("term_key").isNotNull(), "terminology").when(F.col("known_key").isNotNull(), "registry").otherwise("slug")
    return both.select("name", F.coalesce("term_key", "known_key", X.safe_slug(F.col("name"))).alias("key"), origin.alias("origin"))


def broken_references(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose key does not exist, for a check that must find none."""
    return rows.where(F.col(column).isNotNull()).join(keys.select(column).distinct(), column, "left_anti")


def identity_fault(key: Column, class_id: Column) -> Column:
    """What is wrong with an object's key (domain:class:type:name, the class being the object's), or null."""
    k, c = F.trim(F.coalesce(key, F.lit(""))), F.trim(F.coalesce(class_id, F.lit("")))
    return (
        F.when(c == "", "no_class")
        .when(k == "", "no_key")
        .when(F.contains(k, F.lit("::")) | ~k.rlike("^[^:]+:[^:]+:[^:]+:.+$"), "malformed_key")
        .when(F.get(F.split(k, ":"), F.lit(1)) != c, "other_class")
    )


def anchored_key(key: Column, domain: Column, class_id: Column, prefix: Column, name: Column) -> Column:
    """The key with its parts as they must be: its own last part stays if it says something, else the slug of the name."""
    parts = F.filter(F.split(F.coalesce(key, F.lit("")), ":"), lambda p: p != "")
    own = F.when(F.size(parts) >= 4, F.element_at(parts, -1)).otherwise(F.coalesce(key, F.lit("")))
    dull = (own == "") | F.startswith(own, F.lit("key_")) | (F.length(own) <= 2) | own.rlike("^[0-9]+$")
    base = F.coalesce(F.when(name != "", name), F.when(own != "", own), F.lit("unknown"))
    slug = lambda c: X.slug(F.lower(c))
    return F.concat_ws(":", slug(domain), slug(class_id), prefix, F.when(dull, X.safe_slug(base)).otherwise(own))


def layers_of_evidence(evidence: DataFrame, by_chunk: DataFrame, by_doc: DataFrame) -> DataFrame:
    """evidence with its layer: that of its chunk, else of its document."""
    c = by_chunk.select("chunk_id", F.col("layer").alias("_c"))
    d = by_doc.select("doc_id", F.col("layer").alias("_d"))
    return evidence.join(c, "chunk_id", "left").join(d, "doc_id", "left").withColumn("layer", F.coalesce("_c", "_d")).drop("_c", "_d")


def within_sections(column: Column, sections: list[str]) -> Column:
    """Whether a dotted section is one of these or lies below one."""
    out = F.lit(False)
    for s in sections:
        out |= (column == s) | F.startswith(column, F.lit(s + "."))
    return out


def apart_from_sections(column: Column, sections: list[str]) -> Column:
    """Whether a dotted section is neither one of these nor above or below one."""
    out = F.lit(True)
    for s in sections:
        out &= ~((column == s) | F.startswith(column, F.lit(s + ".")) | F.startswith(F.lit(s), F.concat(column, F.lit("."))))
    return out
