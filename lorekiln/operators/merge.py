"""Merging sources: layers, consensus, arbitration, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions import text as X
from lorekiln.functions import values as V


def distinct_layers(layers: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first layer of each key, by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return layers.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def layer_arrays(layers: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Each concept's layers as one ordered array; the array is as long as the concept has sources."""
    packed = F.array_sort(F.collect_list(F.struct(*order, *(f for f in fields if f not in order))))
    return layers.groupBy(key).agg(packed.alias("layers"))


def consensus(values: Column, agree) -> Column:
    """The state of an ordered array of values, null where a source gives none: all are held against the first.

    single_source, single_value_unknown, agreed, partial_conflict (more than half agree), else disagreement.
    """
    known = F.filter(values, lambda v: v.isNotNull())
    same = F.size(F.filter(known, lambda v: agree(F.get(known, F.lit(0)), v)))
    n = F.size(known)
    return (
        F.when(F.size(values) <= 1, "single_source")
        .when(n == 0, "single_value_unknown")
        .when((n == 1) | (same == n), "agreed")
        .when(n == 2, "disagreement")
        .when(same > F.floor(n / 2), "partial_conflict")
        .otherwise("disagreement")
    )


def classify_conflict(facets: Column, same_name: Column) -> Column:
    """Why layers disagree, from an array of arrays of facets (one value or null an axis, the first is the unit).

    over_merge if an axis has two values; partial_conflict if one is known to some only; value_disagreement if a facet other than the
    unit, or an explicit common name, says they mean the same; else material_conflict.
    """
    axes = F.transform(F.sequence(F.lit(0), F.size(F.get(facets, F.lit(0))) - 1), lambda i: F.transform(facets, lambda f: F.get(f, i)))
    known = lambda axis: F.array_distinct(F.filter(axis, lambda v: v.isNotNull()))
    split = F.exists(axes, lambda a: F.size(known(a)) > 1)
    partial = F.exists(axes, lambda a: (F.size(known(a)) == 1) & F.exists(a, lambda v: v.isNull()))
    meaning = F.filter(axes, lambda a, i: i > 0)
    signal = F.exists(meaning, lambda a: F.size(known(a)) == 1)
    return (
        F.when(split, "over_merge").when(partial, "partial_conflict").when(signal | same_name, "value_disagreement").otherwise("material_conflict")
    )


def arbitrate(layers: Column, samples: int = 5) -> Column:
    """struct(value, level, rule) of an array of structs (ord, authority_level, publisher_id, value, publication_year, sample_count).

    Rules in their order: a field observation with enough samples; the newest of several standards; a standard over a
    manual; the newer of two manuals of a publisher; a manual over a vendor note; any manual or better over an academic source;
    else the highest rank, the first of equals.
    """
    ranked = F.array_sort(F.transform(layers, lambda s: F.struct((-V.authority_rank(s["authority_level"])).alias("k"), s["ord"].alias("o"), s.alias("s"))))
    ranked = F.transform(ranked, lambda x: x["s"])
    of = lambda level: F.filter(ranked, lambda s: s["authority_level"] == level)
    year = lambda s: F.coalesce(s["publication_year"], F.lit(0))
    first = lambda a: F.get(a, F.lit(0))
    pick = lambda s, rule: F.struct(s["value"].alias("value"), s["authority_level"].alias("level"), F.lit(rule).alias("rule"))
    field, std, oem, note, paper = (of(x) for x in ("field_observation", "industry_standard", "oem_manual", "vendor_application_note", "academic_reference"))
    newest = F.array_max(F.transform(std, year))
    renewed = F.filter(oem, lambda a: F.exists(oem, lambda b: a["publisher_id"].eqNullSafe(b["publisher_id"]) & (year(a) != year(b))))
    partners = F.filter(
        oem,
        lambda b: b["publisher_id"].eqNullSafe(first(renewed)["publisher_id"]) & (year(b) != year(first(renewed))),
    )
    newer = F.when(year(first(renewed)) > year(first(partners)), first(renewed)).otherwise(first(partners))
    high = F.filter(ranked, lambda s: V.authority_rank(s["authority_level"]) >= V.AUTHORITY_RANK["oem_manual"])
    n = F.size
    return (
        F.when(n(layers) == 1, pick(first(ranked), None))
        .when((n(field) > 0) & (F.coalesce(first(field)["sample_count"], F.lit(0)) >= samples), pick(first(field), "rule_1_field_observation"))
        .when(
            (n(std) >= 2) & (newest > 0) & F.exists(std, lambda s: year(s) < newest),
            pick(first(F.filter(std, lambda s: year(s) == newest)), "rule_2_newer_standard"),
        )
        .when((n(std) > 0) & (n(oem) > 0), pick(first(std), "rule_3_standard_over_oem"))
        .when(n(renewed) > 0, pick(newer, "rule_4_newer_oem"))
        .when((n(oem) > 0) & (n(note) > 0), pick(first(oem), "rule_5_oem_over_vendor_note"))
        .when((n(paper) > 0) & (n(high) > 0), pick(first(high), "rule_6_authority_over_academic"))
        .otherwise(pick(first(ranked), "fallback_highest_rank"))
    )


def merged_objects(layers: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One object a concept: its best confidence, its highest authority (the first of equals), its first part, its numbers of sources."""
    at = F.struct(*order)
    return layers.groupBy(key).agg(
        F.max("price").alias("best_price"),
        F.max_by("authority_level", F.struct(V.authority_rank(F.col("authority_level")), *((-F.col(c)).alias(c) for c in order[:3]))).alias("highest_authority"),
        F.min_by("part_id", at).alias("first_part"),
        F.count("*").alias("n_layers"),
        F.countDistinct("publisher_id").alias("n_publishers"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key the new row stands. One shuffle on the key."""
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("side"))
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").withColumn("side", F.when(F.col("side") == 1, "new").otherwise("kept"))


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not there yet, once each."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def replace_evidence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Deleting and inserting without conflicts leaves the first row of each key."""
    return distinct_layers(rows, keys, order)


def numbered_keys(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Unique keys: the first row of a base key has it plain, the others get _2, _3 ..."""
    w = Window.partitionBy(base).orderBy(*order)
    n = F.row_number().over(w)
    return rows.withColumn("unique_key", F.when(n == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), n.cast("string"))))


def keys_around(rows: DataFrame, base: str, order: list[str], reserved: DataFrame) -> DataFrame:
    """Unique keys where some are taken: rows of a base key get the free ones of base, base_2, base_3 ... in order; reserved(key).

    The k-th row takes the k-th free number: reserved numbers of a base, ascending, each push the free ones behind them by one, so the number is k plus how many of them
    are at most that; these gaps are runs, found by a running difference, and rows meet runs by their base.
    """
    number = F.coalesce(F.regexp_extract("key", r"_([1-9][0-9]*)$", 1).try_cast("long"), F.lit(1))
    stem = F.regexp_replace("key", r"_[1-9][0-9]*$", "")
    # a key may itself be a base, or a base with a number from 2 on; a base that looks like another with a number has that number
    bases = rows.select(F.col(base).alias("key")).distinct()
    numbered = reserved.select("key").unionByName(bases).where(number >= 2).select(stem.alias("b"), number.alias("n"))
    taken = reserved.select(F.col("key").alias("b"), F.lit(1).cast("long").alias("n")).unionByName(numbered).distinct()
    w = Window.partitionBy("b").orderBy("n")
    free_before = F.col("n") - F.row_number().over(w)  # numbers below n that are free
    pushed = taken.withColumn("free", free_before).groupBy("b", "free").agg(F.max("n").alias("n"))
    runs = pushed.select("b", F.col("free").alias("k0"), (F.col("n") - F.col("free")).alias("shift"))
    ends = runs.withColumn("k1", F.lead("k0").over(Window.partitionBy("b").orderBy("k0")))
    ranked_rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(base).orderBy(*order)).cast("long"))
    # rows k with k0 < k <= k1 lie behind the run that has k0 free numbers before it
    met = ranked_rows.join(ends, (F.col(base) == F.col("b")) & (F.col("_k") > F.col("k0")) & (F.col("k1").isNull() | (F.col("_k") <= F.col("k1"))), "left")
    n = F.col("_k") + F.coalesce("shift", F.lit(0))
    return met.withColumn("unique_key", F.when(n == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), n.cast("string")))).drop("_k", "b", "k0", "k1", "shift")


def sliced(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """Groups with more rows than `size` in slices of it."""
    w = Window.partitionBy(key)
    return rows.withColumn("slice", F.when(F.count("*").over(w) > size, F.floor((F.row_number().over(w.orderBy(*order)) - 1) / size)).otherwise(0).cast("long"))


def conflicts(objects: DataFrame) -> DataFrame:
    """Pairs of a class whose names share two words and whose values disagree, between representatives of (class, name, value).

    objects(class_id, name, value). Names meet by equi-joins on their pairs of words, not as all pairs of a class.
    """
    reps = objects.groupBy("class_id", "name", "value").agg(F.count("*").alias("n"))
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0))))
    pairs = F.flatten(F.transform(words, lambda a: F.transform(F.filter(words, lambda b: b > a), lambda b: F.concat(a, F.lit(" "), b))))
    by_pair = reps.select("class_id", "name", F.explode(pairs).alias("two")).distinct()
    a, b = by_pair.alias("a"), by_pair.alias("b")
    names = (
        a.join(b, (F.col("a.class_id") == F.col("b.class_id")) & (F.col("a.two") == F.col("b.two")) & (F.col("a.name") <= F.col("b.name")))
        .select(F.col("a.class_id").alias("class_id"), F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
        .distinct()
    )
    left = reps.select("class_id", F.col("name").alias("name_a"), F.col("value").alias("value_a"), F.col("n").alias("n_a"))
    right = reps.select("class_id", F.col("name").alias("name_b"), F.col("value").alias("value_b"), F.col("n").alias("n_b"))
    return (
        names.join(left, ["class_id", "name_a"])
        .join(right, ["class_id", "name_b"])
        .where((F.col("name_a") < F.col("name_b")) | (F.col("value_a") < F.col("value_b")))
        .where(~V.numbers_agree(F.col("value_a"), F.col("value_b")))
    )


def merge_with_existing(members: DataFrame, existing: DataFrame, evidence: DataFrame) -> DataFrame:
    """Where merged groups go among existing objects, as one plan over all classes.

    members(class_id, key, name) are the groups' names, existing(class_id, ko_id, key, name) the objects there (ko_id a string, one
    row a name), evidence(key, chunk_id, role) the groups' evidence. A name is the object's that had it last (the largest id); an
    object goes to the first group, by key, that has one of its names. A group takes the smallest of its objects' ids and the others go; a group
    without any takes over an unclaimed object of its own key, else it is new. A group that has an object removes an unclaimed one of its
    key. Evidence is counted once a chunk and role. Returns class_id, key, ko_id, action, removed, n_evidence.
    """
    owner = existing.groupBy("class_id", "name").agg(F.max("ko_id").alias("ko_id"))
    claims = members.distinct().join(owner, ["class_id", "name"]).groupBy("class_id", "ko_id").agg(F.min("key").alias("key"))
    taken = claims.groupBy("class_id", "key").agg(F.array_sort(F.collect_set("ko_id")).alias("ids"))
    free = existing.join(claims.select("class_id", "ko_id"), ["class_id", "ko_id"], "left_anti").groupBy("class_id", "key").agg(F.min("ko_id").alias("same_key"))
    n = evidence.groupBy("key").agg(F.countDistinct("chunk_id", "role").alias("n_evidence"))
    groups = members.select("class_id", "key").distinct().join(taken, ["class_id", "key"], "left").join(free, ["class_id", "key"], "left").join(n, "key", "left")
    has = F.coalesce(F.size("ids"), F.lit(0))
    target = F.coalesce(F.get("ids", F.lit(0)), "same_key", F.concat(F.lit("ko_"), F.substring(F.sha1("key"), 1, 16)))
    action = F.when(has >= 2, "merged_existing").when(has == 1, "updated_existing").when(F.col("same_key").isNotNull(), "adopted_key").otherwise("new_merged")
    rest = F.when(has > 0, F.concat(F.slice("ids", F.lit(2), F.greatest(has - 1, F.lit(0))), F.when(F.col("same_key").isNotNull(), F.array("same_key")).otherwise(F.array().cast("array<string>"))))
    return groups.select(
        "class_id", "key", target.alias("ko_id"), action.alias("action"), F.coalesce(F.array_join(F.array_sort(rest), ","), F.lit("")).alias("removed"),
        F.coalesce("n_evidence", F.lit(0)).cast("long").alias("n_evidence"),
    )


def split_objects(evidence: DataFrame, order: list[str]) -> DataFrame:
    """evidence(ko_id, part, ...) with the object it belongs to once objects are split by part: the part of the first evidence keeps the id."""
    lead = evidence.groupBy("ko_id").agg(F.min_by("part", F.struct(*order)).alias("lead"))
    fresh = F.concat(F.lit("ko_"), F.substring(F.sha1(F.concat_ws("::", F.col("ko_id").cast("string"), "part")), 1, 16))
    return evidence.join(lead, "ko_id").withColumn("new_id", F.when(F.col("part").eqNullSafe(F.col("lead")), F.col("ko_id").cast("string")).otherwise(fresh)).drop("lead")


def split_by_signature(rows: DataFrame, key: str, signature: Column, name: Column) -> DataFrame:
    """rows whose group `key` has one signature only keep it; where there are several, each gets the key with the slug of its first name."""
    signed = rows.withColumn("signature", signature).withColumn("_name", name)
    firsts = signed.groupBy(key, "signature").agg(F.min("_name").alias("first_name"))
    kinds = firsts.groupBy(key).agg(F.count("*").alias("kinds"))
    refined = F.when(F.col("kinds") <= 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("_"), X.safe_slug(F.coalesce("first_name", "signature"))))
    return signed.join(firsts, [key, "signature"]).join(kinds, key).withColumn("refined_key", refined).drop("first_name", "kinds", "_name")


def renamed_groups(rows: DataFrame, group: str, raw_key: str, order: list[str]) -> DataFrame:
    """Groups under the key that their first member prefers: a raw key that is no hash if there is one, else any; equal keys become one group."""
    says = F.element_at(F.split(raw_key, ":"), -1)
    hashed = F.startswith(says, F.lit("key_"))
    best = rows.where(F.col(raw_key).isNotNull()).groupBy(group).agg(F.min_by(raw_key, F.struct(hashed.alias("h"), *order)).alias("preferred"))
    return rows.join(best, group, "left").withColumn("final_key", F.coalesce("preferred", group)).drop("preferred")


def kept_and_dropped(rows: DataFrame, links: DataFrame, components_of, key: str, order: list[Column]) -> DataFrame:
    """Groups of linked rows: the one to keep, how many go and the reasons: links(src, dst, reason)."""
    parts = components_of(links.select("src", "dst"))
    reasons = links.join(parts.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    members = rows.join(parts.withColumnRenamed("node", key), key)
    groups = members.groupBy("component").agg(F.max_by(key, F.struct(*order)).alias("keep"), (F.count("*") - 1).alias("n_dropped"))
    return groups.join(reasons, "component").select("component", "keep", "n_dropped", "reasons")
