"""What evidence is worth: weak quotes, audits, readiness of review packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions import text as X

#: Words of the weak-evidence rules.
EDITOR = ("retain/delete", "retain or delete", "delete this section", "retain this section", "designer shall", "specifier shall", "choose one")
INTRO = ("the following are potential", "map loop output as follows")
COMMISSIONING = (
    "configure", "force", "throttle", "reduce", "increase", "note", "provide", "report", "switch", "verify", "test", "interlock", "measure", "override",
    "starting from", "in increments",
)
RULE = (
    "shall", "must", "should", "when", "whenever", "if", "enable", "disable", "reset", "stage", "start", "stop", "alarm", "fault", "open", "close",
    "modulat", "control", "setpoint", "command", "description", "equation", "speed", "flow", "temperature", "pressure", "applies to", "greater", "less",
    "below", "above", "=",
)
SEQUENCES = ("operational_sequence", "fault_diagnostic_rule", "commissioning_step")
#: Names that are none, kinds of findings' severities.
NOT_NAMES = ("en", "cn", "na", "n/a", "none", "null")


def compact(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-zA-Z0-9%]+", "")


def weak_reason(kind: Column, quote: Column, title: Column, section_id: Column, section_title: Column) -> Column:
    """Why a quote does not support its candidate, by the first rule that holds, or null."""
    q = F.trim(F.coalesce(quote, F.lit("")))
    low, dense = F.lower(q), compact(q)
    heads = F.filter(F.array(section_id, title, section_title), lambda h: F.coalesce(h, F.lit("")) != "")
    heads = F.transform(heads, compact)
    heading = (dense == "") | F.array_contains(heads, dense) | ((F.length(dense) < 80) & F.exists(heads, lambda h: F.endswith(dense, h)))
    codes = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"(?i)fc#?\s*(\d+)"), F.lit(1))
    no_code = (F.size(codes) > 0) & ~F.exists(codes, lambda c: F.contains(dense, F.concat(F.lit("fc"), c)))
    sequence = kind.isin(*SEQUENCES)
    return (
        F.when(X.has_any(low, EDITOR), "editor_instruction")
        .when(heading, "heading_only")
        .when((kind == "fault_diagnostic_rule") & no_code, "no_fault_code")
        .when((kind == "commissioning_step") & ~X.has_any(low, COMMISSIONING), "no_commissioning_action")
        .when(F.endswith(low, F.lit(",")) | X.has_any(low, INTRO), "incomplete_intro")
        .when(sequence & (F.regexp_count(q, F.lit("[A-Za-z0-9%]+")) < 8), "too_short")
        .when(sequence & ~X.has_any(low, RULE), "no_rule_signal")
    )


def audit(evidence: DataFrame) -> DataFrame:
    """Objects none of whose evidence is strong: evidence(ko_id, reason) → ko_id, n_evidence, reasons."""
    return (
        evidence.groupBy("ko_id")
        .agg(
            F.count("*").alias("n_evidence"),
            F.bool_or(F.col("reason").isNull()).alias("strong"),
            F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
        )
        .where("NOT strong")
        .drop("strong")
    )


def reviewable(kind: Column, kinds: list[str], name: Column, evidence: Column) -> Column:
    """Whether a reader should see a candidate: its kind is asked for, its name and evidence are long enough."""
    n, e = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(evidence, F.lit("")))
    return F.coalesce(kind.isin(*kinds), F.lit(False)) & (F.length(n) >= 2) & ~F.lower(n).isin(*NOT_NAMES) & (F.length(e) >= 4)


def pack_status(pending: Column, accepted: Column, done: str = "review_complete") -> Column:
    return F.when(pending > 0, "blocked_pending").when(accepted == 0, "blocked_no_accepted").otherwise(done)


def release_status(succeeded: Column, failed: Column) -> Column:
    return F.when((succeeded > 0) & (failed == 0), "success").when(succeeded > 0, "partial").otherwise("failed")


def retagged(state: Column, classified: Column) -> Column:
    """The consensus state of an object: only material conflicts are classified anew, and none stays one."""
    return (
        F.when(state == "material_conflict", F.when(classified == "material_conflict", "partial_conflict").otherwise(classified))
        .otherwise(F.coalesce(F.when(state != "", state), F.lit("undetermined")))
    )


def task_findings(accepted: Column, rate: Column, equipment: Column, weak: Column) -> Column:
    """Codes of what a graded task shows, in their order."""
    return F.concat_ws(
        ",",
        F.when(F.coalesce(accepted, F.lit(0)) == 0, "no_publishable_knowledge"),
        F.when(F.coalesce(rate, F.lit(0.0)) < 20, "low_judge_acceptance").when(rate < 50, "medium_judge_acceptance"),
        F.when(equipment.isin("controller", "valve", "pump", "cooling_tower"), "equipment_anchor_suspect"),
        F.when(weak > 0, "weak_evidence_present"),
    )


def filled(decision: Column, trust: Column, curator: Column, defaults: dict[str, str]) -> list[Column]:
    """Curation fields of a pack's entry: what is there stays, blanks get the defaults, and no decision is a pending one."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return [
        F.coalesce(blank(decision), F.lit("pending")).alias("decision"),
        F.coalesce(blank(trust), F.lit(defaults["trust_level"])).alias("trust_level"),
        F.coalesce(blank(curator), F.lit(defaults["curator"])).alias("curator"),
    ]


def surface_rollup(reports: DataFrame, surfaces: DataFrame) -> DataFrame:
    """status, report_count, passed, failed of every surface: passed if all its reports are, pending without any."""
    g = reports.groupBy("surface").agg(
        F.bool_and(F.col("status") == "passed").alias("all_passed"), F.count("*").alias("n"), F.sum("passed").alias("passed"), F.sum("failed").alias("failed")
    )
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(name)
    status = F.when(F.col("n").isNull(), "pending").when(F.col("all_passed"), "passed").otherwise("failed").alias("status")
    return surfaces.join(g, "surface", "left").select("surface", status, zero("n", "report_count"), zero("passed", "passed"), zero("failed", "failed"))
