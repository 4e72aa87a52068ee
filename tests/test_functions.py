import pytest
from pyspark.sql import functions as F

from lorekiln.functions import text as X
from lorekiln.functions import values as V
from lorekiln.operators import rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (None, "5", True), ("n/a", "-", True), ("0", "1", False), ("0", "0.0", True), ("100", "104", True), ("100", "110", False),
        ("44F", "7C", True), ("100 psi", "6.9 bar", True), ("1 MPa", "10 bar", True), ("Auto", "auto ", True), ("x", "y", False), ("1,000", "1000", True),
        ("about 50", "51", True),
    ],
)
def test_values_agree(spark, a, b, want):
    assert one(spark, V.values_agree(F.lit(a).cast("string"), F.lit(b).cast("string"))) is want


def test_texts(spark):
    assert one(spark, X.slug(F.lit("油压差报警/保护"))) == "油压差报警_保护"
    assert one(spark, X.ascii_slug(F.lit("  ?? "), "none")) == "none"
    assert one(spark, X.safe_slug(F.lit("12"))).startswith("key_")
    assert one(spark, X.token_slug(F.lit("One two-three FOUR five six seven"))) == "one_two_three_four_five_six"
    assert one(spark, X.clean_page(F.lit(" a \n\n b\x00 "))) == "a\nb"
    assert one(spark, X.anchor(F.lit("Ａ b，（5％）."))) == "ａb(5%)"
    assert one(spark, X.shorten(F.lit("word " * 100))).endswith("...") and len(one(spark, X.shorten(F.lit("word " * 100)))) <= 220
    assert one(spark, X.language(F.lit("a 泵"))) == "zh" and one(spark, X.language(F.lit(" "))) is None
    assert one(spark, X.token_estimate(F.lit("水泵ab"))) == 1
    assert one(spark, X.redact(F.lit('{"api_key": "abc", "n": 1}'))) == '{"api_key": "[REDACTED]", "n": 1}'
    assert one(spark, X.json_body(F.lit('```json\n{"a": [1, 2,],}\n```'))) == '{"a": [1, 2]}'
    assert one(spark, X.section_prefix(F.lit("5.1.2.3.4"))) == "5.1.2.3" and one(spark, X.key_tail(F.lit("a:b:c"))) == "c"


@pytest.mark.parametrize(
    ("text", "want"),
    [("20 °C to 34 °C", ("20", "34")), ("between 20 and 34", ("20", "34")), ("20℃～34℃", ("20", "34")), ("34 to 20", None), ("1 to 2, 3 to 4", None), ("", None)],
)
def test_prose_range(spark, text, want):
    got = one(spark, X.prose_range(F.lit(text)))
    assert (None if got is None else (got.low, got.high)) == want


def test_numbers(spark):
    assert one(spark, V.alias_score(F.lit("x" * 12), F.lit(True), F.lit(False))) == pytest.approx(0.6933, abs=1e-4)
    assert one(spark, V.candidate_confidence(0.85, 0.04, F.lit(1.0))) == 0.99
    assert one(spark, V.celsius(F.lit("7℃"))) is None
    assert one(spark, V.value_summary(F.lit("40SEC"), F.lit(None), F.lit("SEC"), F.lit(None), F.lit(None), F.lit("t"), F.lit("s"))) == "40SEC"
    assert one(spark, V.value_summary(F.lit(None), F.lit(None), F.lit(None), F.lit("1"), F.lit("2"), F.lit("t"), F.lit("s"))) == "[1, 2]"
    assert one(spark, V.authority_rank(F.lit("oem_manual"))) == 3 and one(spark, V.authority_rank(F.lit(None).cast("string"))) == -1
    with pytest.raises(KeyError):
        V.least_trust(F.lit("L1"), "L9")


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("txt", "oem_manual", "good_text", 9, 1.0), "DISCARD"), ((".PDF", "oem_manual", "low_or_no_text", 9, 1.0), "KEEP_VISUAL"),
        (("docx", "industry_standard", "good_text", 9, 1.0), "MANUAL_REVIEW"), (("pdf", "regulatory_code", "low_or_no_text", 9, 1.0), "NEEDS_OCR_CONVERT"),
        (("pdf", "vendor_training", "good_text", 3, 1.0), "DISCARD"), (("pdf", "vendor_application_note", "good_text", 3, 1.0), "MANUAL_REVIEW"),
        (("pdf", "oem_manual", "partial_text", None, None), "KEEP_TEXT"), ((None, None, None, None, None), "DISCARD"),
    ],
)
def test_triage(spark, row, want):
    ext, level, quality, pages, size = (F.lit(x) for x in row)
    assert one(spark, rules.triage(ext.cast("string"), level.cast("string"), quality.cast("string"), pages.cast("int"), size.cast("double"))) == want


def test_authority(spark):
    at = lambda f, p=None: one(spark, rules.authority(F.lit(f), F.lit(p).cast("string")))
    assert at("ASHRAE 90.1.pdf") == "industry_standard" and at("building code.pdf") == "regulatory_code"
    assert at("x.pdf", "York") == "oem_manual" and at("pump sop.doc") == "internal_sop" and at("hvac handbook.pdf") == "academic_reference" and at("x.pdf") is None
    assert one(spark, rules.first_brand(F.lit("york and abb"))) == "abb"


def test_ids_and_orders(spark):
    import uuid

    assert one(spark, X.uuid5(F.lit("feedback:é|7"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "feedback:é|7"))
    a, b = (X.inputs_hash(F.array(*map(F.lit, names)), F.lit("t")) for names in (("x", "y"), ("y", "x")))
    assert one(spark, a) == one(spark, b)
    assert one(spark, X.dotted_order(F.lit("5.10.b"))) == [5, 10, 0]
