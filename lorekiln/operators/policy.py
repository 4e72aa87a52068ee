"""Which sources are taken, in which order, and how each is read: selection, model and anchor policies of standards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Policies of standards, lanes and families that change them, anchors and the reasons for them.
SMALL_STANDARD, LARGE_PAGES = "211", 450
KINDS = "application_guidance,parameter_spec,operational_sequence"
POLICIES = {
    "small": ("deepseek-v4-pro", 18), "large": ("mimo-v2-omni", 18), "other": ("deepseek-parameter-spec", 16),
}
METHOD, TOPIC, SYSTEM = ("audit_methodology", "methodology_guide"), ("sustainability_topic", "cross_domain_sustainability_guide"), "system_design"
NO_ANCHOR, DEFAULT_ANCHOR, GENERAL = ("mixed", "none"), "chiller", "general_hvac"
OCR_FIRST = "ocr_or_multimodal_first"


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix_of(path: Column) -> Column:
    """The lower-case suffix with its dot; a leading dot begins no suffix."""
    return F.lower(F.regexp_extract(name_of(path), r".(\.[^.]+)$", 1))


def canonical_score(path: Column) -> Column:
    """Order of paths, best first: no mark of a copy, a plain or descriptive name, short, then by letters."""
    name = name_of(path)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    copied = F.rlike(name, F.lit(r"(?i)\(\d+\)| copy|副本"))
    plain = F.rlike(name, F.lit(r"^[a-z0-9_.+\- ]+$")) | F.rlike(stem, F.lit("[a-z]+_[a-z0-9_]+"))
    return F.struct(copied.cast("int").alias("copied"), (~plain).cast("int").alias("odd"), F.length(path).alias("chars"), F.lower(path).alias("low"))


def scanned(files: DataFrame, suffixes: list[str], path: str = "path") -> DataFrame:
    """Files of the given suffixes, in order of their canonical score."""
    return files.where(suffix_of(F.col(path)).isin(*suffixes)).orderBy(canonical_score(F.col(path)), path)


def selected(items: DataFrame, groups: list[str], limit: int | None = None, include_ocr: bool = False, order: str = "row_index") -> DataFrame:
    """items(path, batch_group, mode, row_index): PDF files of the groups (of any, if none is given), without those held for OCR, the first ones up to a limit."""
    fits = suffix_of(F.col("path")) == ".pdf"
    if groups:
        fits &= F.col("batch_group").isin(*groups)
    if not include_ocr:
        fits &= F.coalesce("mode", F.lit("")) != OCR_FIRST
    chosen = items.where(fits)
    return chosen.orderBy(order).limit(limit) if limit is not None else chosen


def is_standard(applies_to: Column, source_standard: Column, key: Column, standard: str, prefix: str) -> Column:
    """Whether an object belongs to a standard: by what it applies to, by its payload or by its key."""
    return F.coalesce(applies_to == standard, F.lit(False)) | F.coalesce(source_standard == standard, F.lit(False)) | F.coalesce(F.startswith(key, F.lit(prefix)), F.lit(False))


def base_policy(name: Column, pages: Column) -> Column:
    """The policy that a document has by its name and size: backend, kinds, candidates, pages, sections, least confidence."""
    n = F.coalesce(pages, F.lit(0))
    kind = F.when(F.contains(F.coalesce(name, F.lit("")), F.lit(SMALL_STANDARD)), "small").when(n >= LARGE_PAGES, "large").otherwise("other")
    pick = lambda i: F.create_map(*(F.lit(x) for k, v in POLICIES.items() for x in (k, v[i])))[kind]
    return F.struct(pick(0).alias("backend"), F.lit(KINDS).alias("kinds"), F.lit(15).alias("candidates"), pick(1).alias("max_pages"), F.lit(3).alias("max_sections"), F.lit("high").alias("min_confidence"))


def route_aware(policy: Column, lane: Column, family: Column, run_equipment: Column) -> Column:
    """The policy after the route of the document: methods read more at less confidence, topics and system design more sections."""
    lane, family = F.coalesce(lane, F.lit("")), F.coalesce(family, F.lit(""))
    method = (lane == METHOD[0]) | (family == METHOD[1])
    topic = ~method & ((lane == TOPIC[0]) | (family == TOPIC[1]))
    routed = method | topic | (lane == SYSTEM)
    sections = F.when(method, F.greatest(policy["max_sections"], F.lit(5))).when(routed, F.greatest(policy["max_sections"], F.lit(4))).otherwise(policy["max_sections"])
    return F.struct(
        F.when(method, POLICIES["small"][0]).when(topic, POLICIES["large"][0]).otherwise(policy["backend"]).alias("backend"),
        F.when(method | ~F.coalesce(run_equipment, F.lit(True)), KINDS).otherwise(policy["kinds"]).alias("kinds"),
        F.when(method, F.greatest(policy["candidates"], F.lit(15))).otherwise(policy["candidates"]).alias("candidates"),
        F.when(routed, F.greatest(policy["max_pages"], F.lit(12))).otherwise(policy["max_pages"]).alias("max_pages"), sections.alias("max_sections"),
        F.when(method, "medium").when(topic, "high").otherwise(policy["min_confidence"]).alias("min_confidence"),
    )


def suggested_anchor(name: Column, pages: Column) -> Column:
    """The class that a standard hangs on when its route says nothing, and why."""
    n = F.coalesce(name, F.lit(""))
    has = lambda w: F.contains(n, F.lit(w))
    why = (
        F.when(has(SMALL_STANDARD), "small_standard_guidance_default")
        .when(has("设计") | has("design"), "design_manual_general_hvac_default")
        .when(has("绿色建筑指南"), "green_guidance_general_hvac_default")
        .when(F.coalesce(pages, F.lit(0)) >= LARGE_PAGES, "large_handbook_general_hvac_default")
        .otherwise("fallback_general_hvac_standard")
    )
    return F.struct(F.lit(DEFAULT_ANCHOR).alias("anchor"), why.alias("reason"))


def routed_anchor(name: Column, pages: Column, lane: Column, family: Column, route_anchor: Column) -> Column:
    lane, family, own = F.coalesce(lane, F.lit("")), F.coalesce(family, F.lit("")), F.trim(F.coalesce(route_anchor, F.lit("")))
    fallback = suggested_anchor(name, pages)
    by_route = F.concat(F.lit("llm_document_route:"), F.coalesce(F.nullif(lane, F.lit("")), family))
    told, method = (own != "") & ~own.isin(*NO_ANCHOR), (lane == METHOD[0]) | (family == METHOD[1])
    lanes = lane.isin(SYSTEM, TOPIC[0])
    return F.struct(
        F.when(told, own).when(method | lanes, GENERAL).otherwise(fallback["anchor"]).alias("anchor"),
        F.when(told, by_route).when(method, "llm_methodology_route_default").when(lanes, by_route).otherwise(fallback["reason"]).alias("reason"),
    )


def standard_policies(tasks: DataFrame, routes: DataFrame) -> DataFrame:
    """tasks(doc_id, name, pages, class_id) with their policy and anchor after routes(doc_id, lane, family, run_equipment, route_anchor), and whether the anchor replaces the class they have.

    A document without a route keeps its own policy; several routes for one document are a fault of the caller and repeat its row.
    """
    j = tasks.join(routes, "doc_id", "left")
    name, pages, lane, family = (F.col(c) for c in ("name", "pages", "lane", "family"))
    j = j.withColumns({"policy": route_aware(base_policy(name, pages), lane, family, F.col("run_equipment")), "suggested": routed_anchor(name, pages, lane, family, F.col("route_anchor"))})
    return j.select("doc_id", "policy.*", "suggested.*", (F.coalesce("class_id", F.lit("")) != F.col("suggested.anchor")).alias("needs_override"))
