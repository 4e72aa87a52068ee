"""Model answers as typed rows: JSON mended by a cascade of repairs, candidates normalised, faults kept with their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.text import let

#: What a candidate's confidence is without one, and at most.
DEFAULT_CONFIDENCE, MOST_CONFIDENCE = 0.72, 0.95
NO_RATIONALE = "llm draft from constrained chunk window"


def _blank_ends(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _uncomma(x: Column) -> Column:
    """Without commas before a closing bracket."""
    return F.regexp_replace(x, r",(\s*[}\]])", "$1")


def repairs(content: Column) -> Column:
    """The readings of an answer in the order in which they are tried: as it is, without its code fence, from its first { to its last }; each then without trailing commas."""
    def unfenced(bare: Column) -> Column:
        inner = _blank_ends(F.regexp_replace(F.regexp_replace(bare, r"^(?i)```(?:json)?\s*", ""), r"\s*```$", ""))
        return F.array(bare, F.when(F.startswith(bare, F.lit("```")), inner).otherwise(bare))

    def outer(read: Column) -> Column:
        last = F.when(F.get(read, F.lit(1)) != "", F.get(read, F.lit(1))).otherwise(F.get(read, F.lit(0)))
        return F.array_append(read, F.regexp_extract(last, r"(?s)(\{.*\})", 1))

    three = let(let(_blank_ends(F.coalesce(content, F.lit(""))), unfenced), outer)
    return F.array_distinct(F.filter(F.flatten(F.transform(three, lambda x: F.array(x, _uncomma(x)))), lambda x: x != ""))


def parsed(content: Column) -> Column:
    """struct(payload variant, reading, fault): the first reading that is JSON; fault is null, `empty`, `malformed` or `no object`."""

    def first(texts: Column) -> Column:
        good = F.filter(texts, lambda t: F.try_parse_json(t).isNotNull())
        return F.struct(F.get(good, F.lit(0)).alias("reading"), F.size(texts).alias("n"))

    def typed(found: Column) -> Column:
        payload = F.try_parse_json(found["reading"])
        fault = (
            F.when(found["n"] == 0, "empty")
            .when(found["reading"].isNull(), "malformed")
            .when(~F.startswith(F.schema_of_variant(payload), F.lit("OBJECT")), "no object")
        )
        return F.struct(F.when(fault.isNull(), payload).alias("payload"), found["reading"].alias("reading"), fault.alias("fault"))

    return let(let(repairs(content), first), typed)


def candidate_rows(answers: DataFrame, allowed: list[str], content: str = "content", list_key: str = "candidates") -> DataFrame:
    """answers' other columns with one row for each candidate of an answer, and one for an answer that has none.

    Adds pos, kind, key, payload (a JSON object as text), confidence, rationale and fault. Faults of answers: those of parsed, `no candidates` where the list is
    missing, empty or no list. Faults of candidates, in this order: `no object`, `kind` (not allowed), `key` (empty), `payload` (no object). Only rows without fault are typed.
    """
    keep = [c for c in answers.columns if c != content]
    read = answers.select(*keep, parsed(F.col(content)).alias("_read"))
    items = F.expr(f"try_variant_get(_read.payload, '$.{list_key}', 'array<variant>')")
    each = read.withColumn("_items", items).select(
        *keep, F.coalesce("_read.fault", F.when(F.coalesce(F.size("_items"), F.lit(0)) <= 0, "no candidates")).alias("_fault"), F.posexplode_outer("_items").alias("pos", "_item")
    )
    text = lambda path: _blank_ends(F.coalesce(F.expr(f"try_variant_get(_item, '$.{path}', 'string')"), F.lit("")))
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    body = F.expr("try_variant_get(_item, '$.structured_payload_candidate', 'variant')")
    fault = (
        F.when(F.col("_fault").isNotNull(), F.col("_fault"))
        .when(~is_object(F.col("_item")), "no object")
        .when(~text("knowledge_object_type").isin(allowed), "kind")
        .when(text("canonical_key_candidate") == "", "key")
        .when(~is_object(body), "payload")
    )
    given = F.expr("try_cast(try_variant_get(_item, '$.confidence_score', 'string') AS double)")
    confidence = F.bround(F.greatest(F.lit(0.0), F.least(F.coalesce(F.when(~F.isnan(given), given), F.lit(DEFAULT_CONFIDENCE)), F.lit(MOST_CONFIDENCE))), 3)
    rationale = F.when(text("rationale") == "", NO_RATIONALE).otherwise(text("rationale"))
    sound = lambda c, name: F.when(F.col("fault").isNull(), c).alias(name)
    return each.withColumn("fault", fault).select(
        *keep, "pos", sound(text("knowledge_object_type"), "kind"), sound(text("canonical_key_candidate"), "key"), sound(F.to_json(body), "payload"),
        sound(confidence, "confidence"), sound(rationale, "rationale"), "fault",
    )
