"""Decision tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions import text as X
from lorekiln.functions import values as V

#: Fixed values of the triage table.
EXTENSIONS = ("pdf", "docx", "doc", "xlsx")
VENDOR_LEVELS = ("vendor_app_note", "vendor_training")
INDUSTRY_LEVELS = ("industry_standard", "industry_standard_or_reference", "regulatory_code")
LOW_TEXT = ("low_or_no_text", "not_pdf", "unknown", "")
#: Fixed values of the authority classifier, in the order in which they are tried.
STANDARD_WORDS = (
    "ashrae", "guideline", "standard", "iec ", "iso ", "gb/t", "gb ", "en ", "bs ", "din ", "nfpa", "ul ", "csa ", "ahri",
    "标准", "规范", "国标",
)
REGULATORY_WORDS = ("regulatory", "regulation", "code of federal", "building code", "法规", "强制", "规章")
BRANDS = (
    "trane", "york", "carrier", "daikin", "mcquay", "abb", "siemens", "honeywell", "johnson controls", "lg", "samsung", "mitsubishi",
    "hitachi", "toshiba", "panasonic", "schneider", "danfoss", "emerson", "特灵", "约克", "开利", "大金", "麦克维尔", "三菱", "日立", "格力",
    "美的", "海尔", "天加", "顿汉布什", "国祥",
)
SOP_WORDS = ("sop", "procedure", "checklist", "操作规程")
ACADEMIC_WORDS = ("handbook", "textbook", "paper", "journal", "thesis")
#: Words that mark the contexts of the rule detectors.
FAULT = ("fault", "alarm", "warning", "error", "protection", "trip", "故障", "报警", "保护", "告警")
PARAMETER = ("parameter", "setting", "default", "threshold", "group", "参数", "设定", "阈值", "默认")
PERFORMANCE = (
    "rated", "nominal", "capacity", "efficiency", "cop", "eer", "performance", "specification", "rating", "output", "额定", "性能", "效率", "能力",
)
APPLICATION = ("application", "pump", "fan", "flow", "pressure", "hvac", "应用", "风机", "水泵", "流量", "压力")
MAINTENANCE = (
    "maintenance", "service", "procedure", "clean", "wash", "inspect", "check", "replace", "lubricate", "maintain", "guide",
    "维护", "保养", "检查", "清洗", "清洁",
)
TASKS = {
    "cleaning": ("clean", "wash", "清洗", "清洁"),
    "inspection": ("inspect", "check", "检查"),
    "replacement": ("replace", "更换"),
    "lubrication": ("lubricate", "润滑"),
}
COMMISSIONING = (
    "commission", "startup", "start-up", "getting started", "backup settings", "upload settings", "调试", "启动", "设置备份", "上传变频器设置",
)
WIRING = (
    "wiring", "terminal", "cable", "shield", "ground", "modbus", "bacnet", "rs485", "communication port", "接线", "端子", "屏蔽", "接地", "通讯",
)
DIAGNOSTIC = ("check", "inspect", "verify", "increase", "decrease", "vent", "排气", "检查", "确认")
STRONG_MAINTENANCE = ("clean", "wash", "replace", "lubricate", "maintain", "regularly", "periodic", "清洗", "清洁", "更换", "润滑", "保养")
CATEGORIES = {
    "capacity": ("capacity", "cooling capacity", "heating capacity", "output", "rt", "kw", "能力", "制冷量"),
    "efficiency": ("efficiency", "cop", "eer", "kw/rt", "效率"),
    "temperature": ("temperature", "leaving temp", "approach", "°c", "c", "温度"),
    "flow": ("flow", "water flow", "air flow", "m3/h", "l/s", "流量"),
}
TOPICS = {
    "communication_wiring": ("modbus", "bacnet", "rs485"),
    "shield_grounding": ("shield", "ground", "接地"),
    "terminal_connection": ("terminal", "端子"),
}
#: Markers of the gates of the model lane.
GATE_APPLICATION = (
    "operate together", "same mode", "use for", "recommended for", "suitable for", "control applications", "control application", "sequence",
    "运行模式", "适用", "应用", "用于",
)
GATE_MAINTENANCE = ("inspect", "calibrate", "preventive maintenance", "maintenance plan", "clean", "replace", "维护", "保养", "检查")
GATE_DIAGNOSTIC = ("inspect", "check", "verify", "diagnose", "确认", "检查", "排查")
GATE_SYMPTOM = ("symptom", "warning", "alarm", "trip", "故障", "报警", "症状")
PREFIXED_VALUE = r"(?i)\b(?:cop|eer)\s*\d+(?:\.\d+)?\b"
FAULT_CODE = r"(?i)\b([A-Z]\d[A-Z0-9]{1,6})\b"
PARAMETER_CODE = r"(?i)\b(p\d{3,5})\b"
NUMERIC_CODE = r"\b(\d{2,4})\b"
VALUE_WITH_UNIT = r"(?i)\b\d+(?:\.\d+)?\s*(?:rt|kw|cop|eer|kw/rt|m3/h|l/s|°c|c|%)\b"
VISUAL_TYPES = ("figure", "diagram", "table", "schematic", "wiring", "nameplate")


def triage(ext: Column, level: Column, quality: Column, pages: Column, size_mb: Column) -> Column:
    """What to do with a source document; the first row of the table that fits decides."""
    norm = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    e, a, q = F.regexp_replace(norm(ext), r"^\.", ""), norm(level), norm(quality)
    vendor, industry, oem = a.isin(*VENDOR_LEVELS), a.isin(*INDUSTRY_LEVELS), a == "oem_manual"
    readable, scanned = q.isin("good_text", "partial_text"), q == "low_or_no_text"
    return (
        F.when(~e.isin(*EXTENSIONS), "DISCARD")
        .when(vendor & (q.isin(*LOW_TEXT) | (pages < 5) | ((size_mb > 50) & scanned)), "DISCARD")
        .when(industry & e.isin("doc", "docx"), "MANUAL_REVIEW")
        .when((industry | oem) & readable, "KEEP_TEXT")
        .when(industry & scanned, "NEEDS_OCR_CONVERT")
        .when(oem & scanned, "KEEP_VISUAL")
        .otherwise("MANUAL_REVIEW")
    )


def first_brand(x: Column) -> Column:
    """The alphabetically first known brand that the text contains."""
    return F.array_min(F.filter(F.array(*map(F.lit, BRANDS)), lambda b: F.contains(x, b)))


def authority(file_name: Column, publisher: Column) -> Column:
    """Authority level from file name and publisher, or null if no rule decides."""
    f, p = F.lower(F.coalesce(file_name, F.lit(""))), F.lower(F.coalesce(publisher, F.lit("")))
    either = lambda words: X.has_any(f, words) | X.has_any(p, words)
    return (
        F.when(X.has_any(f, STANDARD_WORDS), "industry_standard")
        .when(either(REGULATORY_WORDS), "regulatory_code")
        .when(either(BRANDS), "oem_manual")
        .when(X.has_any(f, SOP_WORDS), "internal_sop")
        .when(X.has_any(f, ACADEMIC_WORDS), "academic_reference")
    )


def fault_context(text: Column, kinds: Column) -> Column:
    return F.when(X.has_any(kinds, ("fault", "alarm")), True).when(X.has_any(kinds, ("parameter",)), False).otherwise(X.has_any(text, FAULT))


def application_context(text: Column, kinds: Column) -> Column:
    return ~fault_context(text, kinds) & X.has_any(F.concat_ws(" ", text, kinds), APPLICATION)


def visual(chunk_type: Column, text: Column) -> Column:
    """Whether a chunk is worth a look at its picture."""
    return X.has_any(F.lower(F.coalesce(chunk_type, F.lit(""))), VISUAL_TYPES) | (F.length(F.trim(F.coalesce(text, F.lit("")))) < 200)


def candidate_findings(confidence: Column, evidence: Column, equipment: Column, n_alternatives: Column) -> Column:
    """Codes of what is weak about a candidate."""
    weak = (F.coalesce(confidence, F.lit(0.0)) < 0.78) | (F.length(F.trim(F.coalesce(evidence, F.lit("")))) < 40)
    unsure = (F.coalesce(equipment, F.lit(0.0)) < 0.85) | (n_alternatives > 0)
    return F.concat_ws(",", F.when(weak, "weak_evidence"), F.when(unsure, "anchor_uncertainty"))


def all_groups_match(text: Column, groups: list[tuple[str, ...]]) -> Column:
    """A conjunction of disjunctions of keywords."""
    out = F.lit(True)
    for g in groups:
        out = out & X.has_any(text, g)
    return out


def text_quality(sampled: Column, with_text: Column, chars: Column) -> Column:
    """How readable a document's sampled pages are."""
    share = with_text / sampled
    return (
        F.when(sampled == 0, "unknown").when((share >= 0.8) & (chars >= 800), "good_text").when(with_text > 0, "partial_text").otherwise("low_or_no_text")
    )


def detected(chunks: DataFrame, equipment: float = 1.0) -> DataFrame:
    """Candidates of all eight detectors: chunks(chunk_id, text, kinds) → chunk_id, kind, key, confidence, one row a candidate.

    kinds is the chunk's and page's type, lower-cased. Each detector is a condition with an array of keys, so a chunk is read once
    and exploded once.
    """
    base = chunks.select("chunk_id", X.squeeze(F.col("text")).alias("t"), F.coalesce("kinds", F.lit("")).alias("kinds"), X.token_slug(F.col("text")).alias("slug"))
    base = base.withColumn("both", F.concat_ws(" ", "t", "kinds"))  # computed once, for the conditions below read these many times
    t, kinds, both, slug = (F.col(c) for c in ("t", "kinds", "both", "slug"))
    under = lambda head: F.array(F.concat(head, F.lit("_"), slug))
    task = X.first_category(t, TASKS, "maintenance")
    procedure, diagnostic = X.has_any(both, MAINTENANCE), X.has_any(t, DIAGNOSTIC)
    wiring = X.has_any(both, WIRING)
    about = (
        F.when(F.contains(t, F.lit("pump")) & F.contains(t, F.lit("fan")), "pump_fan")
        .when(X.has_any(t, ("pump", "水泵")), "pump")
        .when(X.has_any(t, ("fan", "风机")), "fan")
        .when(X.has_any(t, ("flow", "流量")), "flow")
        .otherwise("application")
    )
    letters = F.array_sort(F.array_distinct(F.transform(F.filter(F.regexp_extract_all(t, F.lit(FAULT_CODE), F.lit(1)), lambda c: ~F.startswith(F.lower(c), F.lit("p"))), F.upper)))
    digits = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(NUMERIC_CODE), F.lit(1))))
    table = [
        ("parameter_spec", X.has_any(both, PARAMETER), X.distinct_matches(t, PARAMETER_CODE), 0.8, 0.05),
        ("performance_spec", ~X.has_any(kinds, ("maintenance", "fault", "alarm")) & X.has_any(both, PERFORMANCE), under(X.first_category(t, CATEGORIES, "performance")), 0.79, 0.04),
        ("commissioning_step", X.has_any(both, COMMISSIONING) & ~wiring, F.array(slug), 0.78, 0.03),
        ("wiring_guidance", wiring, under(X.first_category(t, TOPICS, "wiring")), 0.77, 0.03),
        ("application_guidance", ~fault_context(t, kinds) & X.has_any(both, APPLICATION), under(about), 0.76, 0.03),
        ("fault_code", fault_context(t, kinds), F.concat(letters, digits), 0.85, 0.04),
        ("maintenance_procedure", procedure & ~(diagnostic & ~X.has_any(t, STRONG_MAINTENANCE)), under(task), 0.75, 0.03),
        ("diagnostic_step", procedure & diagnostic, under(task), 0.74, 0.03),
    ]
    none = F.array().cast("array<struct<kind:string,key:string,confidence:double>>")

    def candidates(kind: str, when: Column, keys: Column, base: float, more: float) -> Column:
        score = V.candidate_confidence(base, more, F.lit(equipment)).cast("double").alias("confidence")
        return F.when(when, F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"), score))).otherwise(none)

    found = [candidates(*row) for row in table]
    return base.select("chunk_id", F.inline(F.concat(*found)))


def gated_types(text: Column, kinds: Column) -> dict[str, Column]:
    """Which types the model lane may look for in a chunk of normalised text and types."""
    any_of = lambda *words: X.has_any(kinds, words)
    return {
        "parameter_spec": ~any_of("fault", "alarm", "maintenance", "commission", "wiring"),
        "application_guidance": ~any_of("spec", "parameter", "fault", "maintenance", "commission", "wiring", "checklist")
        & (any_of("guidance", "application", "sequence") | X.has_any(text, GATE_APPLICATION)),
        "maintenance_procedure": ~any_of("fault", "parameter") & (any_of("maintenance", "procedure") | X.has_any(text, GATE_MAINTENANCE)),
        "diagnostic_step": ~any_of("fault", "parameter") & X.has_any(text, GATE_DIAGNOSTIC),
        "symptom": any_of("fault", "alarm", "symptom") | X.has_any(text, GATE_SYMPTOM),
    }


def section_confidence(matches: Column, span_pages: Column, chunks: Column) -> Column:
    richness = matches + (span_pages >= 2).cast("int") + (chunks >= 3).cast("int")
    return F.when(matches == 0, "none").when(richness >= 4, "high").when(richness >= 2, "medium").otherwise("low")
