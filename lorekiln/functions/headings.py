"""Headings of pages from their lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekiln.functions.text import let

#: Lines that are no headings, and what is cut from a line's ends before it is one.
GENERIC = ("untitled", "chapter", "section")
NOISE = (r"^\d+(?:\.\d+)?\s+", r"\s+\d+\.\d+$")
NUMBERED = r"^\d+(?:\.\d+){0,2}\s+"
FIRST_LINES, MOST_WORDS, SHORT_WORDS, CAPITAL_WORDS = 8, 14, 8, 12


def cleaned(line: Column, noise: tuple[str, ...] = NOISE) -> Column:
    """A line without the noise at its ends: page and section numbers, dashes, colons, bullets."""
    out = F.trim(F.regexp_replace(line, r"\s+", " "))
    for pattern in noise:
        out = F.trim(F.regexp_replace(out, pattern, ""))
    return F.regexp_replace(F.regexp_replace(out, r"\s{2,}", " "), r"^[ \-–—:•]+|[ \-–—:•]+$", "")


def like_heading(line: Column, noise: tuple[str, ...] = NOISE, titles: tuple[str, ...] = ()) -> Column:
    """Whether a line can head a page: not generic, no sentence, numbered or in capitals or in title case; titles are words of running heads."""

    def judge(z: Column) -> Column:
        c, low, raw = z["c"], z["low"], z["raw"]
        words, letters = F.split(c, r"\s+"), F.regexp_count(c, F.lit(r"\p{L}"))
        n = F.size(words)
        sentence = F.rtrim(raw).rlike(r"[.;:]$") & ~raw.rlike(NUMBERED)
        barred = (F.length(c) < 4) | low.isin(*GENERIC) | F.contains(raw, F.lit("•")) | sentence | (letters < 3) | (n > MOST_WORDS)
        for t in titles:
            barred |= F.contains(low, F.lit(t))
        capitals = (F.regexp_count(c, F.lit(r"\p{Lu}")) >= 0.75 * letters) & (n <= CAPITAL_WORDS)
        titled = (n <= SHORT_WORDS) & (F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) >= F.greatest(F.lit(2), n - 1))
        return ~barred & (low.rlike(r"^(chapter|appendix)\b") | raw.rlike(NUMBERED + "[A-Z0-9]") | capitals | titled)

    return let(let(cleaned(line, noise), lambda c: F.struct(c.alias("c"), F.lower(c).alias("low"), line.alias("raw"))), judge)


def page_heading(text: Column, noise: tuple[str, ...] = NOISE, titles: tuple[str, ...] = ()) -> Column:
    """The heading of a page: the line after a chapter's number, else the first of its first eight lines that is like one; null without any."""

    def first(lines: Column) -> Column:
        own, after = cleaned(F.get(lines, F.lit(0)), noise), cleaned(F.get(lines, F.lit(1)), noise)
        numbered = F.get(lines, F.lit(0)).rlike(r"(?i)^\d+(?:\.\d+)?\s*chapter\b") & (F.size(lines) >= 2)
        good = F.filter(F.slice(lines, 1, FIRST_LINES), lambda x: like_heading(x, noise, titles))
        return F.when(numbered, F.when(after != "", after).otherwise(own)).otherwise(cleaned(F.get(good, F.lit(0)), noise))

    stripped = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return let(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), stripped), lambda x: x != ""), first)
