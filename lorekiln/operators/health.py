"""Health of knowledge objects by their evidence: brands that they should name, classes that it does not speak of."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Brands that evidence may name, and the share of a class's tokens below which its anchor is weak.
BRANDS = (
    "Trane", "York", "Carrier", "Daikin", "McQuay", "ABB", "Siemens", "Danfoss", "Hitachi", "Mitsubishi", "LG", "Samsung", "Panasonic", "Schneider",
    "Emerson", "Toshiba", "Honeywell", "特灵", "约克", "开利", "大金", "麦克维尔", "三菱", "日立", "格力", "美的", "海尔", "天加",
)
WEAK_ANCHOR = 0.3


def ambiguous(objects: DataFrame, evidence: DataFrame, brands: tuple[str, ...] = BRANDS) -> DataFrame:
    """Objects that name neither brand nor model while their evidence does: objects(ko_id, brand, model), evidence(ko_id, text) → ko_id, brands as the texts spell them, sorted.

    Each text is read once, in its own task; only distinct names are grouped by object.
    """
    bare = objects.where("coalesce(brand, '') = '' AND coalesce(model, '') = ''").select("ko_id").distinct()
    pattern = r"(?iU)\b(" + "|".join(map(re.escape, brands)) + r")\b"
    named = evidence.select("ko_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("found"))
    return named.join(bare, "ko_id", "left_semi").groupBy("ko_id").agg(F.array_sort(F.collect_set("found")).alias("brands"))


def weak_anchors(objects: DataFrame, evidence: DataFrame, least: float = WEAK_ANCHOR) -> DataFrame:
    """Objects whose evidence holds too few of their class's tokens: objects(ko_id, class_id), evidence(ko_id, text) → ko_id, class_id, found, missing, ratio (rounded to 3).

    A token may stand anywhere in a text, also inside a word. Objects without class, or without any evidence text, are not judged.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("class_id"), F.lit("[a-z0-9]+"), F.lit(0)))
    o = objects.select("ko_id", "class_id", tokens.alias("tokens")).where("size(tokens) > 0")
    hits = F.filter("tokens", lambda t: F.contains(F.lower("text"), t))
    read = evidence.where("text <> ''").join(o, "ko_id").select("ko_id", "class_id", "tokens", F.explode_outer(hits).alias("hit"))
    by = read.groupBy("ko_id", "class_id", "tokens").agg(F.array_sort(F.collect_set("hit")).alias("found"))
    ratio = F.size("found") / F.size("tokens")
    return by.where(ratio < least).select("ko_id", "class_id", "found", F.array_sort(F.array_except("tokens", "found")).alias("missing"), F.bround(ratio, 3).alias("ratio"))


def report(**findings: DataFrame) -> DataFrame:
    """(code, ko_id) of all findings, each object once for a code."""
    out = None
    for code, rows in findings.items():
        one = rows.select(F.lit(code).alias("code"), "ko_id").distinct()
        out = one if out is None else out.unionByName(one)
    return out
