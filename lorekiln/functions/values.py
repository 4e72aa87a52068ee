"""Values and ranks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekiln.functions.text import let

#: Rank of each authority level.
AUTHORITY_RANK = {
    "field_observation": 6,
    "industry_standard": 5,
    "regulatory_code": 4,
    "oem_manual": 3,
    "vendor_application_note": 2,
    "academic_reference": 1,
    "internal_sop": 0,
    "unspecified": -1,
}
TRUST_RANK = {"L1": 0, "L2": 1, "L3": 2, "L4": 3}
#: Texts that stand for no value.
EMPTY = ("", "none", "null", "n/a", "-")


def _lookup(x: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(x == k, v).otherwise(out)
    return F.when(x.isNull(), default).otherwise(out)


def authority_rank(x: Column) -> Column:
    return _lookup(x, AUTHORITY_RANK, -1)


def trust_rank(x: Column) -> Column:
    return _lookup(x, TRUST_RANK, -1)


def least_trust(x: Column, minimum: str) -> Column:
    """Whether the trust level is the minimum at least; an unknown minimum is an error."""
    return trust_rank(x) >= TRUST_RANK[minimum]


def least_authority(x: Column, minimum: str) -> Column:
    """Whether the level is the minimum at least; an unknown minimum admits all."""
    return authority_rank(x) >= AUTHORITY_RANK.get(minimum, -1)


def is_empty(x: Column) -> Column:
    return x.isNull() | F.lower(F.trim(x)).isin(*EMPTY)


def numeric(x: Column) -> Column:
    """A number, or the first number in the text; commas are dropped."""
    s = F.regexp_replace(F.trim(x), ",", "")
    found = F.regexp_extract(s, r"[-+]?\d+\.?\d*", 0)
    return F.coalesce(s.try_cast("double"), F.when(found != "", found.try_cast("double")))


def _unit(x: Column, pattern: str) -> Column:
    """struct(n, unit) of a number with its unit."""
    s = F.regexp_replace(F.lower(F.trim(x)), " ", "")
    return let(s, lambda v: F.struct(F.regexp_extract(v, pattern, 1).try_cast("double").alias("n"), F.regexp_extract(v, pattern, 2).alias("unit")))


def celsius(x: Column) -> Column:
    return let(_unit(x, "^(-?\\d+\\.?\\d*)°?([fc])$"), lambda u: F.when(u["unit"] == "f", (u["n"] - 32) * 5 / 9).when(u["unit"] == "c", u["n"]))


def bar(x: Column) -> Column:
    of = lambda u: F.when(u["unit"] == "psi", u["n"] * 0.0689476).when(u["unit"] == "mpa", u["n"] * 10).when(u["unit"] == "kpa", u["n"] / 100).when(u["unit"] == "bar", u["n"])
    return let(_unit(x, r"^(\d+\.?\d*)(psi|bar|mpa|kpa)$"), of)


def _near(a: Column, b: Column, share: float, floor: float) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(floor)) <= share


PLAIN = r"^[-+]?\d+(\.\d+)?$"


def values_agree(a: Column, b: Column) -> Column:
    """Empty values agree with all; then equal texts; temperatures and pressures within 10 % across units; numbers within 5 %."""
    plain = lambda x: F.coalesce(F.trim(x).rlike(PLAIN), F.lit(False))
    read = lambda x: F.struct(celsius(x).alias("t"), bar(x).alias("p"), numeric(x).alias("n"), is_empty(x).alias("e"), F.lower(F.trim(x)).alias("s"))

    def cascade(z: Column) -> Column:
        x, y = z["x"], z["y"]
        both = lambda c: x[c].isNotNull() & y[c].isNotNull()
        return (
            F.when(x["e"] | y["e"], True)
            .when(x["s"] == y["s"], True)
            .when(both("t"), _near(x["t"], y["t"], 0.10, 1.0))
            .when(both("p"), _near(x["p"], y["p"], 0.10, 1.0))
            .when(both("n"), numbers_agree(x["n"], y["n"]))
            .otherwise(False)
        )

    numbers = numbers_agree(F.trim(a).try_cast("double"), F.trim(b).try_cast("double"))
    # most values are plain numbers: then no other pattern is tried
    return F.when(plain(a) & plain(b), numbers).otherwise(let(F.struct(read(a).alias("x"), read(b).alias("y")), cascade))


def numbers_agree(a: Column, b: Column, share: float = 0.05) -> Column:
    return F.when((a == 0) & (b == 0), True).when((a == 0) | (b == 0), False).otherwise(
        F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)) <= share
    )


def alias_score(alias: Column, preferred: Column, label: Column) -> Column:
    return F.least(F.lit(0.3) + F.least(F.length(alias), F.lit(24)) / 36 + 0.06 * preferred.cast("int") + 0.03 * label.cast("int"), F.lit(0.98))


def candidate_confidence(base: float, bonus: float, equipment: Column) -> Column:
    return F.bround(F.least(F.lit(base + bonus) + (equipment - 0.6) * 0.25, F.lit(0.99)), 3)


def value_summary(value: Column, default: Column, unit: Column, low: Column, high: Column, title: Column, summary: Column) -> Column:
    """The value or default with its unit (not twice), else [low, high], else the title, else the summary."""
    blank = lambda c: F.when(c != "", c)
    v, u = F.trim(F.coalesce(blank(value), default)), F.coalesce(F.trim(unit), F.lit(""))
    return (
        F.when(v.isNotNull(), F.when((u != "") & ~F.endswith(v, u), F.concat(v, u)).otherwise(v))
        .when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("["), low, F.lit(", "), high, F.lit("]")))
        .otherwise(F.coalesce(blank(title), summary))
    )


def authority_role(level: Column, primary: Column) -> Column:
    return (
        F.when(level == "industry_standard", F.when(primary, "primary_standard").otherwise("corroborating_standard"))
        .when(level == "oem_manual", F.when(primary, "primary_oem").otherwise("corroborating_oem"))
        .when(level == "field_observation", "field_validation")
        .otherwise("unspecified")
    )
