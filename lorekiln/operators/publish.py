"""What was published: catalogs of fixtures, releases of review packs, audit packets, reports of sections, scenario cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.operators.evidence import release_status
from lorekiln.operators.ordered import ranked

#: The kind of an entry that names none, the kind that stands for a whole pack.
DEFAULT_KIND, WHOLE_PACK = "fault_code", "review_pack"


def fixture_entries(fixtures: DataFrame) -> DataFrame:
    """fixtures(path, class_id, class_key, entries: array of structs) → one row for each entry, with its place in its fixture."""
    return fixtures.select("path", "class_id", "class_key", F.posexplode("entries").alias("place", "entry")).select("path", "class_id", "class_key", "place", "entry.*")


def fixture_citations(entries: DataFrame) -> DataFrame:
    """(doc_id, path): which fixtures cite which documents."""
    return entries.select("doc_id", "path").distinct()


def fixture_catalog(entries: DataFrame) -> DataFrame:
    """The documents that fixtures cite: entries(path, place, class_id, class_key, kind, doc_id, file_name, domain, page_no, page_type, brand, family) → one row for each doc_id.

    Name and domain are those of the first entry by path and place; classes, kinds, pages, brands and families are sorted sets. An entry without class takes the last part of its key,
    one without kind is a fault code, null and empty brands and families do not count. Sets hold what a document and the ontology bound, built map-side first; fixtures, which nothing bounds, are counted only (`fixture_citations` has them).
    """
    filled = entries.withColumns({
        "class_id": F.coalesce(F.nullif("class_id", F.lit("")), F.element_at(F.split(F.coalesce("class_key", F.lit("")), ":"), -1)), "kind": F.coalesce("kind", F.lit(DEFAULT_KIND)),
        "brand": F.nullif("brand", F.lit("")), "family": F.nullif("family", F.lit("")),
    })
    first = F.min_by(F.struct("file_name", "domain"), F.struct("path", "place"))
    sets = {"classes": "class_id", "kinds": "kind", "page_nos": "page_no", "page_types": "page_type", "brands": "brand", "families": "family"}
    found = filled.groupBy("doc_id").agg(first.alias("first"), *(F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()), F.count("*").alias("n_entries"))
    cited = fixture_citations(entries).groupBy(F.col("doc_id").alias("_doc")).agg(F.count("*").alias("n_fixtures"))
    return found.join(cited, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "first.*", "n_fixtures", *sets, "n_entries")


def release_items(runs: DataFrame, applied: DataFrame, readiness: DataFrame, packs: DataFrame, entries: DataFrame) -> DataFrame:
    """What a release brought or would bring, one row for each accepted entry of its packs, or one for a pack without any.

    runs(workspace, executed_at): workspaces with an apply run that left a report; all others show how ready their packs are.
    applied(workspace, place, pack, status, error), readiness(workspace, place, pack, status, blocker, accepted, rejected, pending): the two kinds of results.
    packs(pack, pack_name, class_id, doc_id), entries(pack, entry_place, decision, ko_id, key, title, kind, trust_level, doc_id).
    An item has the pack's result: applied and ready packs succeed. Names fall back from title to key to id, then to the pack's name and the pack itself.
    """
    ran = runs.select("workspace")
    done = applied.join(ran, "workspace", "left_semi").select(
        "workspace", "place", "pack", "status", "error", F.lit("apply_run").alias("mode"), (F.col("status") == "applied").alias("ok"),
        F.when(F.col("status") == "applied", "written").when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit("failed: "), "error")).alias("said"), F.lit(None).cast("string").alias("counts"),
    )
    blocker = F.nullif("blocker", F.lit(""))
    preview = readiness.join(ran, "workspace", "left_anti").select(
        "workspace", "place", "pack", "status", blocker.alias("error"), F.lit("workspace_snapshot").alias("mode"), (F.col("status") == "ready").alias("ok"),
        F.concat_ws("; ", F.concat(F.lit("status "), "status"), blocker).alias("said"),
        F.format_string("accepted %d / rejected %d / pending %d", *(F.coalesce(c, F.lit(0)).cast("long") for c in ("accepted", "rejected", "pending"))).alias("counts"),
    )
    took = entries.where("decision = 'accepted'").select("pack", "entry_place", "ko_id", "key", "title", "kind", "trust_level", F.col("doc_id").alias("entry_doc"))
    j = done.unionByName(preview).join(packs, "pack", "left").join(took, "pack", "left")
    whole = F.col("entry_place").isNull()
    trust = F.when(F.coalesce("trust_level", F.lit("")) != "", F.concat(F.lit("trust "), "trust_level"))
    label = F.coalesce(F.nullif("pack_name", F.lit("")), F.col("pack").cast("string"))
    of_entry = F.concat_ws(" · ", F.nullif("key", F.lit("")), trust, "said")
    of_pack = F.when(F.col("mode") == "apply_run", F.coalesce("said", F.lit("no entries"))).otherwise(F.concat_ws("; ", "counts", "said"))
    return j.select(
        "workspace", "mode", "place", "pack", "entry_place",
        F.when(whole, label).otherwise(F.coalesce(F.nullif("title", F.lit("")), F.nullif("key", F.lit("")), "ko_id")).alias("name"),
        F.when(whole, WHOLE_PACK).otherwise(F.col("kind")).alias("kind"), F.when(F.coalesce("ok", F.lit(False)), "success").otherwise("failed").alias("result"), F.when(whole, of_pack).otherwise(of_entry).alias("note"),
        "ko_id", "key", F.when(whole, F.col("doc_id")).otherwise(F.col("entry_doc")).alias("doc_id"), "class_id", "status", "error",
    )


def release_records(runs: DataFrame, prepared: DataFrame, items: DataFrame) -> DataFrame:
    """One record for each workspace with results: packs that succeeded and failed, items, distinct packs, the first fault by place, and how it ended.

    runs(workspace, executed_at), prepared(workspace, prepared_at, domain). Counted by pack before by workspace, so a workspace with most items is spread over its packs.
    Blocked packs are those that a review can still unblock; a pack that failed otherwise counts as failed in apply runs only.
    """
    blocked = F.col("status").isin("blocked_pending", "blocked_no_accepted", "blocked_invalid")
    lost = F.when(F.col("mode") == "apply_run", F.col("status") == "failed").otherwise(blocked)
    results = items.groupBy("workspace", "mode", "place", "pack").agg(F.first("status").alias("status"), F.first("error").alias("error"), F.max("result").alias("result"), F.count("*").alias("items"))
    told = F.when(F.col("mode") == "apply_run", F.when(F.col("status") == "failed", F.col("error"))).otherwise(F.concat_ws(": ", "pack", F.when(F.col("error") != "", F.col("error"))))
    fault = F.when(F.coalesce("error", F.lit("")) != "", told)
    by = results.withColumn("fault", fault).groupBy("workspace", "mode").agg(
        F.count_if(F.col("result") == "success").alias("n_success"), F.count_if(F.coalesce(lost, F.lit(False))).alias("n_failed"), F.sum("items").alias("n_items"), F.countDistinct("pack").alias("n_packs"),
        F.count("fault").alias("n_faults"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.struct("place", "pack"))).alias("first_fault"),
    )
    at = F.when(F.col("mode") == "apply_run", F.col("executed_at")).otherwise(F.col("prepared_at"))
    return by.join(runs, "workspace", "left").join(prepared, "workspace", "left").select(
        F.concat_ws("-", F.when(F.col("mode") == "apply_run", "run").otherwise("preview"), "workspace", F.when(F.col("mode") == "apply_run", F.col("executed_at").cast("string"))).alias("record_id"),
        "workspace", "mode", at.alias("executed_at"), "domain", release_status(F.col("n_success"), F.col("n_failed")).alias("status"), "n_success", "n_failed", "n_items", "n_packs", "n_faults", "first_fault",
    )


def scenario_cards(queries: DataFrame, order: list[str], at: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cards, highlights): queries by class, classes in the given order, without those that have no query; queries of other or no class have no card.

    Cards are (class_id, card from 0, n_queries). Highlights are the queries with their card and their place on it (from 0, by `at`), in classes of any size.
    """
    places = F.create_map(*(x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))))
    known = queries.where(F.col("class_id").isin(*order)).withColumn("wanted", places[F.col("class_id")])
    counts = known.groupBy("class_id", "wanted").agg(F.count("*").alias("n_queries"))
    # the one window over all of them sorts as many rows as `order` names
    cards = counts.select("class_id", (F.row_number().over(Window.orderBy("wanted")) - 1).cast("long").alias("card"), "n_queries")
    placed = ranked(known.drop("wanted"), ["class_id"], at, "place")
    return cards, placed.join(F.broadcast(cards.select("class_id", "card")), "class_id")


def audit_packets(runs: DataFrame, sources: DataFrame, results: DataFrame) -> DataFrame:
    """runs(run) with the integrity counts of their packets: sources(run), results(run, status); the flag of runs with failed results."""
    s = sources.groupBy("run").agg(F.count("*").alias("n_sources"))
    r = results.groupBy("run").agg(F.count("*").alias("n_results"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = runs.join(s, "run", "left").join(r, "run", "left").select("run", zero("n_sources"), zero("n_results"), zero("n_failed"))
    return out.withColumn("flags", F.when(F.col("n_failed") > 0, "has_failed_results").otherwise(""))


def section_report(rows: DataFrame, section: str, verified: Column, anchored: Column, top: Column, threshold: int) -> DataFrame:
    """What each section gave: raw rows, those anchored, verified and of the top level; sections with few verified rows are low."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    stats = rows.groupBy(section).agg(F.count("*").alias("raw"), n(anchored).alias("anchor_passed"), n(verified).alias("verified"), n(top).alias("top_level"))
    return stats.withColumn("low_output", F.col("verified") <= threshold)
