import re

from lorekiln.llm.license_scan import BASE_PHRASES, UPPER, LOWER, WORD, license_scan

SCHEMA = "doc_id long, text string, w string, label string, gram int"


def words(text):
    return re.findall(WORD, (text or "").translate(str.maketrans(UPPER, LOWER)))


def test_places_and_labels_match_brute_force(spark):
    texts = [
        "CC BY cc by cc-by!", None, "", "All  rights\nreserved. All rights reserved", "general public, license", "General Public License general public license",
        "Released under the M.I.T License", "released under the mit license and more", "licensed under the new apache license version 2.0",
        "cc\x00by éCC BY", "x " * 5000 + "cc by", "cc",
    ]
    rows = [(i, t, "clash", "clash", i) for i, t in enumerate(texts)]
    out, spans = license_scan(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        w = words(text)
        places, labels = [], set()
        for phrase, label in BASE_PHRASES:
            p = phrase.split()
            at = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(labels))
        assert labels <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert "mit" in got[7].labels and "apache-2.0" in got[8].labels and got[7].score == 1.0
    assert {r.label for r in spans.where("doc_id = 7").collect()} == {"mit"}


def test_repeats_nulls_and_empty_tables(spark):
    rows = [(1, "cc by"), (1, "cc by"), (None, "all rights reserved")]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert got[1].n_base == 1 and got[None].base_labels == "reserved"
    rows = [(1, "a"), (1, "cc by x"), (None, "a"), (None, "b c"), (None, "b c")]
    each = license_scan(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base) for r in each) == [("1", 1, 0), ("1", 3, 1), ("None", 1, 0), ("None", 2, 0), ("None", 2, 0)]
    assert license_scan(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0
