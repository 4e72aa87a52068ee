"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[一-鿿]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(x: Column) -> Column:
    """Lower-cased, trimmed, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def slug(x: Column, keep: str = "a-zA-Z0-9一-鿿") -> Column:
    """Runs of characters that are not kept become _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, f"[^{keep}]+", "_"), "^_+|_+$", "")


def ascii_slug(x: Column, default: str = "item") -> Column:
    s = slug(F.lower(x), "a-z0-9")
    return F.when(s == "", default).otherwise(F.coalesce(s, F.lit(default)))


def token_slug(x: Column, n: int = 6) -> Column:
    """The first n runs of ASCII letters and digits, joined by _; `candidate` without any."""
    tokens = F.slice(F.regexp_extract_all(squeeze(x), F.lit("[a-z0-9]+"), F.lit(0)), 1, n)
    return F.when(F.size(tokens) > 0, F.array_join(tokens, "_")).otherwise("candidate")


def hashed_slug(x: Column) -> Column:
    return F.concat(F.lit("key_"), F.substring(F.sha1(x), 1, 10))


def safe_slug(x: Column) -> Column:
    """The slug, or a hashed one where the slug has two characters at most or is all digits."""
    s = slug(F.lower(x))
    return F.when((F.length(s) <= 2) | s.rlike("^[0-9]+$"), hashed_slug(x)).otherwise(s)


def clean_page(x: Column) -> Column:
    """Lines trimmed, blank lines and NULs dropped."""
    lines = F.transform(F.split(F.regexp_replace(x, "\\x00", ""), "\n"), lambda s: F.trim(s))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def printable(x: Column) -> Column:
    """Control characters other than tab, line feed and carriage return become blanks."""
    return F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


def anchor(x: Column) -> Column:
    """What quotes are compared by: lower case, full-width signs folded, blanks and punctuation dropped."""
    folded = F.translate(F.lower(x), "％（）", "%()")
    return F.regexp_replace(folded, "[\\s ，。；、,.;:：]+", "")


def shorten(x: Column, limit: int = 220) -> Column:
    s = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 3), F.lit("..."))).otherwise(s)


def language(x: Column) -> Column:
    """zh if any character is a CJK ideograph, else en; null for empty."""
    return F.when(F.coalesce(F.trim(x), F.lit("")) == "", None).when(x.rlike(CJK), "zh").otherwise("en")


def stable_id(prefix: str, *parts: Column, sep: str = "::") -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws(sep, *parts)), 1, 16))


def distinct_matches(x: Column, pattern: str, group: int = 1) -> Column:
    """Distinct lower-cased matches, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), F.lower)))


def first_match(x: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def has_any(x: Column, markers) -> Column:
    """Whether the text contains a marker; an OR chain stops at the first."""
    hits = [F.contains(x, F.lit(m)) for m in markers]
    return F.coalesce(functools.reduce(lambda a, b: a | b, hits), F.lit(False)) if hits else F.lit(False)


def first_category(x: Column, groups: dict[str, tuple[str, ...]], default: str) -> Column:
    """The first category one of whose keywords the text contains."""
    out = F.lit(default)
    for name, keywords in reversed(groups.items()):
        out = F.when(has_any(x, keywords), name).otherwise(out)
    return out


def token_estimate(x: Column) -> Column:
    """Half a token for each CJK ideograph and a quarter for each other character, truncated."""
    cjk = F.regexp_count(x, F.lit(CJK))
    return F.floor(cjk / 2 + (F.length(x) - cjk) / 4).cast("long")


def redact(x: Column) -> Column:
    """Values of JSON keys that name secrets, replaced."""
    return F.regexp_replace(x, r'(?i)("[^"]*(?:api_key|token|secret|password|authorization)[^"]*"\s*:\s*)("[^"]*"|[^,}\]]+)', '$1"[REDACTED]"')


def json_body(x: Column) -> Column:
    """A model's answer without code fences, from the first { to the last }, without commas before a closing bracket."""
    body = F.regexp_extract(F.regexp_replace(x, "```[a-zA-Z]*", ""), r"(?s)(\{.*\})", 1)
    return F.regexp_replace(body, r",\s*([}\]])", "$1")


def section_prefix(x: Column, n: int = 4) -> Column:
    return F.substring_index(x, ".", n)


def key_tail(x: Column) -> Column:
    return F.element_at(F.split(x, ":"), -1)


#: The patterns of numeric ranges in prose, tried in this order.
RANGES = (
    "(-?\\d+(?:\\.\\d+)?)\\s*[℃°]?[CF]?\\s*[~～\\-—–到至]\\s*(-?\\d+(?:\\.\\d+)?)\\s*[℃°][CF]?",
    "(?i)(-?\\d+(?:\\.\\d+)?)\\s*°[CF]\\s*(?:to|~|-|–|—)\\s*(-?\\d+(?:\\.\\d+)?)\\s*°[CF]",
    "(?i)(-?\\d+(?:\\.\\d+)?)\\s*(?:to|and)\\s*(-?\\d+(?:\\.\\d+)?)",
)


def prose_range(x: Column) -> Column:
    """struct(low, high) if the first pattern that finds a rising range finds exactly one; else null."""
    out = F.lit(None).cast("struct<low:string,high:string>")
    for p in reversed(RANGES):
        both = F.arrays_zip(
            F.regexp_extract_all(x, F.lit(p), F.lit(1)).alias("low"), F.regexp_extract_all(x, F.lit(p), F.lit(2)).alias("high")
        )
        rising = F.array_distinct(F.filter(both, lambda r: r["low"].cast("double") < r["high"].cast("double")))
        out = F.when(F.size(rising) == 1, F.struct(rising[0]["low"].alias("low"), rising[0]["high"].alias("high"))).when(
            F.coalesce(F.size(rising), F.lit(0)) == 0, out
        )
    return out


#: Fixed value: the name space of URLs for version-5 UUIDs.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(x: Column) -> Column:
    """The version-5 UUID of a URL, from its SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(x, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def inputs_hash(names: Column, *rest: Column) -> Column:
    """The same for the same names in any order."""
    return F.substring(F.sha1(F.concat_ws("\x1f", F.array_join(F.array_sort(names), "\x1e"), *rest)), 1, 16)


def dotted_order(x: Column) -> Column:
    """A key that orders dotted section numbers by their numbers."""
    return F.transform(F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(0).cast("long")))


def fault_number(x: Column) -> Column:
    """The number of the first fault code such as FC #12, or null."""
    return first_match(x, r"(?i)\bFC\s*#?\s*(\d+)\b", 1)


#: Refrigerants and what names them, in the order in which they are tried.
REFRIGERANTS = {
    "r407c": ("r407c",), "r134a": ("r134a",), "r22": ("r22",), "r600a": ("refrigerant600a", "600a", "isobutane"),
    "r732": ("refrigerant732", "oxygen"), "r740": ("refrigerant740", "argon"),
}


def refrigerant(x: Column) -> Column:
    """The refrigerant that a text names, or null; hyphens and spaces do not matter."""
    dense = F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), "[- ]", ""))
    name = first_category(dense, REFRIGERANTS, "")
    return F.when(name != "", name)
