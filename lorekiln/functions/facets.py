"""Facets of a parameter: its physical quantity, its polarity, its trigger and axes of keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekiln.functions import text as X

#: The quantity that each unit measures.
UNITS = {
    "temperature": ("c", "°c", "℃", "f", "°f", "℉"),
    "pressure": ("pa", "kpa", "mpa", "bar", "psi", "psia", "psig"),
    "pressure_differential": ("psid",),
    "current": ("a", "ma", "ka"),
    "voltage": ("v", "kv"),
    "frequency": ("hz",),
    "flow": ("gpm", "l/s", "m3/h", "m³/h", "cfm"),
    "power": ("w", "kw", "mw", "hp"),
    "ratio": ("%",),
    "time": ("minute", "minutes", "min", "second", "seconds", "sec", "s", "分钟", "秒"),
}
#: What says that a pressure is a difference.
DIFFERENCE = ("压差", "差压", "differential pressure", "pressure differential", "psid", "Δp", "∆p")
#: Fixed value: a number with its unit in prose.
MEASURED = r"[-+]?\d+(?:\.\d+)?\s*([a-zA-Z°℃℉%]+(?:/[a-zA-Z]+)?|m[³3]/h|分钟|秒)"
#: What a fault does, tried in this order.
POLARITY = {
    "sensor_fault": ("传感器", "sensor fault", "sensor failure", "断线"),
    "loss": ("丢失", "无信号", "loss", "lost", "missing", "no signal"),
    "high": ("过高", "高温", "高压", "超限", "high", "over"),
    "low": ("过低", "低温", "低压", "不足", "low", "under"),
    "range_out": ("越限", "out of range", "range out"),
}
#: What triggers a fault, tried in this order.
TRIGGERS = ("油", "水", "制冷剂", "冷媒", "轴承", "电机", "相序", "压缩机", "oil", "water", "refrigerant", "bearing", "motor", "phase", "compressor")
#: Qualifiers of which one name has one and another name another.
QUALIFIERS = {
    "quantity": ("温度", "油温", "temperature", "压力", "压差", "pressure", "differential", "电流", "current", "容量", "制冷量", "capacity", "时间", "time"),
    "bound": ("最大", "最小", "最高", "最低", "maximum", "minimum", "max", "min", "启动", "起动", "运行", "start", "stop"),
    "reference": (
        "供油", "油箱", "润滑油", "oil tank", "supply oil", "lubricating oil", "蒸发器", "冷凝器", "evaporator", "condenser", "水侧", "制冷剂侧", "water side",
        "refrigerant side", "front panel", "external", "active", "bas", "tracer",
    ),
}


def unit_quantity(unit: Column) -> Column:
    """The quantity that a unit measures, or null."""
    u = F.regexp_replace(F.lower(F.trim(unit)), " ", "")
    table = F.create_map(*(F.lit(x) for q, units in UNITS.items() for u_ in units for x in (u_, q)))
    return F.try_element_at(table, u)


def quantity(unit: Column, text: Column) -> Column:
    """The quantity of the unit, else of the first known unit after a number in the text; a pressure whose text speaks of a difference is one."""
    lower = F.lower(text)
    units = F.regexp_extract_all(text, F.lit(MEASURED), F.lit(1))
    known = F.filter(F.transform(units, unit_quantity), lambda q: q.isNotNull())
    found = F.coalesce(unit_quantity(unit), F.get(known, F.lit(0)))
    differs = X.has_any(lower, tuple(d.lower() for d in DIFFERENCE))
    return F.when(differs & (found.isNull() | (found == "pressure")), "pressure_differential").otherwise(found)


def axis(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """The value of a keyword axis: rules are tried by their longest keyword, longest first, and the first with a keyword in the text wins."""
    out = F.lit(None).cast("string")
    ordered = sorted(rules.items(), key=lambda r: max(map(len, r[1])), reverse=True)
    for value, words in reversed(ordered):
        out = F.when(X.has_any(text, tuple(w.lower() for w in words)), value).otherwise(out)
    return out


def polarity(text: Column) -> Column:
    return X.first_category(text, POLARITY, "unknown")


def trigger(text: Column) -> Column:
    """The first trigger that the text names."""
    return X.first_category(text, {t: (t,) for t in TRIGGERS}, "unknown")


def conflicting(names: Column) -> Column:
    """Whether an array of different names has two qualifiers of one kind."""
    n = F.array_distinct(F.transform(names, F.lower))
    kinds = [
        F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.exists(n, lambda x: F.contains(x, w)))) > 1 for words in QUALIFIERS.values()
    ]
    out = F.lit(False)
    for k in kinds:
        out |= k
    return (F.size(F.array_distinct(names)) > 1) & out


def contextual_name(name: Column, summary: Column, values: dict[str, Column]) -> Column:
    """What a parameter's name is embedded as: the name, 120 characters of its summary, its values."""
    from lorekiln.functions.values import is_empty

    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    pairs = F.concat_ws(" ", *(F.when(~is_empty(v), F.concat(F.lit(f"{k}="), v)) for k, v in values.items()))
    return F.concat_ws("。", blank(name), blank(F.substring(F.trim(summary), 1, 120)), blank(pairs))


def like_a_name(text: Column) -> Column:
    """Whether a text can be a parameter's name: two ideographs in a row or two letters."""
    t = F.trim(text)
    return F.coalesce((F.length(t) >= 2) & (t.rlike("[一-鿿]{2,}") | t.rlike("[A-Za-z].*[A-Za-z]")), F.lit(False))


def name_from_evidence(evidence: Column, fallback: Column) -> Column:
    """The first line of the evidence if it can be a name, at most 120 characters, else the fallback."""
    line = F.trim(F.get(F.split(F.trim(evidence), "\r\n|\r|\n"), F.lit(0)))
    return F.when(like_a_name(line), F.substring(line, 1, 120)).otherwise(fallback)
