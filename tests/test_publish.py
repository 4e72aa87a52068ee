import random
import re
from collections import defaultdict
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from lorekiln.operators import applying, health, policy, publish

ENTRY = "array<struct<kind string, doc_id string, file_name string, domain string, page_no int, page_type string, brand string, family string>>"
SETS = ("fixtures", "classes", "kinds", "page_nos", "page_types", "brands", "families")


def test_fixture_catalog_is_that_of_a_plain_loop(spark):
    rng = random.Random(2)
    fixtures = []
    for i in range(40):
        entries = [
            (rng.choice([None, "a", "b"]), f"d{rng.choice([0, 0, 0, rng.randrange(9)])}", f"f{rng.randrange(3)}", rng.choice("xy"), rng.randrange(4), rng.choice("pq"), rng.choice([None, "", "B"]), rng.choice([None, "", "F", "G"]))
            for _ in range(rng.randrange(5))
        ]
        fixtures.append((f"p{i:02}", rng.choice([None, "", "c1", "c2"]), rng.choice([None, "d:c3", "c4"]), entries))
    want = {}
    for path, cid, ckey, entries in fixtures:
        for kind, doc, name, domain, page, ptype, brand, family in entries:
            r = want.setdefault(doc, [name, domain, *(set() for _ in SETS), 0])
            for at, v in enumerate((path, cid or (ckey or "").split(":")[-1], kind or "fault_code", page, ptype, brand, family)):
                if at < 5 or v:
                    r[at + 2].add(v)
            r[-1] += 1
    df = spark.createDataFrame(fixtures, f"path string, class_id string, class_key string, entries {ENTRY}").repartition(3)
    paths = defaultdict(list)
    for r in publish.fixture_citations(publish.fixture_entries(df)).collect():
        paths[r.doc_id].append(r.path)
    got = {r.doc_id: [r.file_name, r.domain, sorted(paths[r.doc_id]), *(r[c] for c in SETS[1:]), r.n_entries] for r in publish.fixture_catalog(publish.fixture_entries(df)).collect()}
    assert got == {k: [*v[:2], *(sorted(x) for x in v[2:-1]), v[-1]] for k, v in want.items()}
    assert publish.fixture_catalog(publish.fixture_entries(df.where("false"))).count() == 0


def released(spark, runs, applied, readiness, packs, entries):
    make = spark.createDataFrame
    return publish.release_items(
        make(runs, "workspace string, executed_at string"), make(applied, "workspace string, place int, pack string, status string, error string"),
        make(readiness, "workspace string, place int, pack string, status string, blocker string, accepted int, rejected int, pending int"),
        make(packs, "pack string, pack_name string, class_id string, doc_id string"),
        make(entries, "pack string, entry_place int, decision string, ko_id string, key string, title string, kind string, trust_level string, doc_id string"),
    )


def test_a_release_shows_what_was_applied_or_what_is_ready(spark):
    runs = [("w1", "t1")]
    applied = [("w1", 0, "p1", "applied", None), ("w1", 1, "p2", "failed", "broken"), ("w1", 2, "p9", "skipped_pending", None), ("w2", 0, "p1", "applied", None)]
    readiness = [("w1", 0, "p1", "ready", None, 1, 0, 0), ("w2", 0, "p1", "ready", "", 2, None, 1), ("w2", 1, "p3", "blocked_pending", "pending", 0, 0, 3), ("w2", 2, None, "odd", None, None, None, None)]
    packs = [("p1", "one", "c", "d1"), ("p2", "", "c", "d2"), ("p3", None, None, None)]
    entries = [("p1", 0, "accepted", "k1", "key1", " t", "fault", "L3", "e1"), ("p1", 1, "accepted", "k2", "", "", "spec", None, None), ("p1", 2, "rejected", "k3", "key3", "t", "spec", "L1", "e2"), ("p2", 0, "pending", "k4", None, None, None, None, None)]
    items = released(spark, runs, applied, readiness, packs, entries)
    got = {(r.workspace, r.place, r.entry_place): (r.mode, r.name, r.kind, r.result, r.note, r.doc_id) for r in items.collect()}
    assert got == {
        ("w1", 0, 0): ("apply_run", " t", "fault", "success", "key1 · trust L3 · written", "e1"),
        ("w1", 0, 1): ("apply_run", "k2", "spec", "success", "written", None),
        ("w1", 1, None): ("apply_run", "p2", "review_pack", "failed", "failed: broken", "d2"),
        ("w1", 2, None): ("apply_run", "p9", "review_pack", "failed", "no entries", None),
        ("w2", 0, 0): ("workspace_snapshot", " t", "fault", "success", "key1 · trust L3 · status ready", "e1"),
        ("w2", 0, 1): ("workspace_snapshot", "k2", "spec", "success", "status ready", None),
        ("w2", 1, None): ("workspace_snapshot", "p3", "review_pack", "failed", "accepted 0 / rejected 0 / pending 3; status blocked_pending; pending", None),
        ("w2", 2, None): ("workspace_snapshot", None, "review_pack", "failed", "accepted 0 / rejected 0 / pending 0; status odd", None),
    }
    prepared = spark.createDataFrame([("w1", "t0", "hvac"), ("w2", "t2", "drive")], "workspace string, prepared_at string, domain string")
    ran = spark.createDataFrame(runs, "workspace string, executed_at string")
    records = {r.workspace: tuple(r)[0:1] + tuple(r)[2:] for r in publish.release_records(ran, prepared, items).collect()}
    assert records == {
        "w1": ("run-w1-t1", "apply_run", "t1", "hvac", "partial", 1, 1, 4, 3, 1, "broken"),
        "w2": ("preview-w2", "workspace_snapshot", "t2", "drive", "partial", 1, 1, 4, 2, 1, "p3: pending"),
    }
    none = released(spark, [], [], [], [], [])
    assert none.count() == 0 and publish.release_records(ran, prepared, none).count() == 0


def test_cards_follow_the_given_order_and_skip_empty_classes(spark):
    rows = [("b", 1), ("b", 1), ("a", 2), (None, 3), ("z", 4), ("b", 0)]
    cards, lights = publish.scenario_cards(spark.createDataFrame(rows, "class_id string, q int"), ["c", "b", "a"], ["q"])
    assert sorted(map(tuple, cards.collect())) == [("a", 1, 1), ("b", 0, 3)]
    assert sorted((r.card, r.place, r.q) for r in lights.collect()) == [(0, 0, 0), (0, 1, 1), (0, 2, 1), (1, 0, 2)]


def plain_policy(name, pages, lane, family, run):
    """The policies as a plain loop over one document."""
    name, n, lane, family = name or "", pages or 0, lane or "", family or ""
    backend, most = ("deepseek-v4-pro", 18) if "211" in name else ("mimo-v2-omni", 18) if n >= 450 else ("deepseek-parameter-spec", 16)
    sections, least = 3, "high"
    if lane == "audit_methodology" or family == "methodology_guide":
        backend, sections, least = "deepseek-v4-pro", 5, "medium"
    elif lane == "sustainability_topic" or family == "cross_domain_sustainability_guide":
        backend, sections = "mimo-v2-omni", 4
    elif lane == "system_design":
        sections = 4
    return backend, policy.KINDS, 15, most, sections, least


def plain_anchor(name, pages, lane, family, own):
    name, lane, family, own = name or "", lane or "", family or "", (own or "").strip()
    if own and own not in ("mixed", "none"):
        return own, f"llm_document_route:{lane or family}"
    if lane == "audit_methodology" or family == "methodology_guide":
        return "general_hvac", "llm_methodology_route_default"
    if lane in ("system_design", "sustainability_topic"):
        return "general_hvac", f"llm_document_route:{lane}"
    for words, why in ((("211",), "small_standard_guidance_default"), (("设计", "design"), "design_manual_general_hvac_default"), (("绿色建筑指南",), "green_guidance_general_hvac_default")):
        if any(w in name for w in words):
            return "chiller", why
    return "chiller", "large_handbook_general_hvac_default" if (pages or 0) >= 450 else "fallback_general_hvac_standard"


def test_policies_and_anchors_follow_the_route(spark):
    names, pages, anchors = ["std 211", "设计手册", "a design", "绿色建筑指南", "x", None], [None, 449, 450], [None, "", "mixed", "none", " pump "]
    lanes = [None, "audit_methodology", "sustainability_topic", "system_design", "other"]
    families = [None, "methodology_guide", "cross_domain_sustainability_guide", "f"]
    cases = [(n, p, ln, f, a) for n in names for p in pages for ln in lanes for f in families for a in anchors]
    tasks = spark.createDataFrame([(i, c[0], c[1], "chiller" if i % 2 else None) for i, c in enumerate(cases)], "doc_id int, name string, pages int, class_id string")
    routes = spark.createDataFrame([(i, c[2], c[3], i % 3 == 0, c[4]) for i, c in enumerate(cases)], "doc_id int, lane string, family string, run_equipment boolean, route_anchor string")
    got = {r.doc_id: tuple(r)[1:] for r in policy.standard_policies(tasks, routes).collect()}
    for i, (n, p, ln, f, a) in enumerate(cases):
        anchor = plain_anchor(n, p, ln, f, a)
        assert got[i] == (*plain_policy(n, p, ln, f, i % 3 == 0), *anchor, ("chiller" if i % 2 else "") != anchor[0]), cases[i]
    alone = policy.standard_policies(tasks.where("doc_id < 4"), routes.where("false")).collect()
    assert [r.max_sections for r in alone] == [3] * 4


def test_paths_are_ordered_and_chosen(spark):
    paths = ["a/B (1).pdf", "a/plain_name.pdf", "b/plain_name.PDF", "x/My Copy.pdf", "x/标准 副本.pdf", "x/标准.pdf", "x/lower-case 1.txt", "x/.pdf", "x/noext", "x/dot.", "x/Some_Thing_like.pdf", "y..pdf"]

    def score(p):
        name, stem = PurePosixPath(p).name, PurePosixPath(p).stem
        marked, plain = re.search(r"\(\d+\)| copy|副本", name, re.I), re.fullmatch(r"[a-z0-9_.+\- ]+", name) or re.search(r"[a-z]+_[a-z0-9_]+", stem)
        return 1 if marked else 0, 0 if plain else 1, len(p), p.lower()

    df = spark.createDataFrame([(p, i % 2, i) for i, p in enumerate(paths)], "path string, g int, row_index int")
    assert [r.path for r in policy.scanned(df, [".pdf"]).collect()] == sorted((p for p in paths if PurePosixPath(p).suffix.lower() == ".pdf"), key=score)
    items = df.select("path", F.when(F.col("g") == 0, "A").otherwise("B").alias("batch_group"), F.when(F.col("row_index") % 5 == 0, policy.OCR_FIRST).alias("mode"), "row_index")
    pick = lambda *a, **k: [r.row_index for r in policy.selected(items, *a, **k).orderBy("row_index").collect()]
    pdf = [i for i, p in enumerate(paths) if PurePosixPath(p).suffix.lower() == ".pdf"]
    assert pick([]) == [i for i in pdf if i % 5] and pick([], include_ocr=True) == pdf
    assert pick(["A"], include_ocr=True) == [i for i in pdf if i % 2 == 0] and pick([], 2) == [i for i in pdf if i % 5][:2]


def test_visual_rows_are_one_for_each_object_image_and_role(spark):
    rows = [("k1", "i1", "v", "d", "p", 3, None, None), ("k1", "i1", None, "c", "p", None, "", "m2"), ("k1", None, "v9", None, None, None, "detail", None), ("k1", "", "", "d", "p", 1, None, None), ("k2", "i1", None, "d", "p", 1, None, None)]
    df = spark.createDataFrame(rows, "ko_id string, page_image_id string, visual_evidence_id string, doc_id string, page_id string, page_no int, role string, model string")
    import hashlib

    vid = lambda *x: "vev_" + hashlib.sha1(":".join(x).encode()).hexdigest()[:14]
    got = sorted(map(tuple, applying.visual_rows(df, model="m").collect()))
    assert got == sorted([
        (vid("k1", "i1", "primary_visual"), "k1", "i1", "primary_visual", "c", "p", 0, "m2"), (vid("k1", "v9", "detail"), "k1", "v9", "detail", "", "", 0, "m"),
        (vid("k2", "i1", "primary_visual"), "k2", "i1", "primary_visual", "d", "p", 1, "m"),
    ])


def test_evidence_of_candidates_comes_from_the_first_form_that_has_it(spark):
    ev = "struct<chunk_id string, doc_id string, page_id string, page_no int, text string, role string>"
    schema = f"candidate_id int, key string, title string, summary string, payload string, draft string, confidence double, trust_level string, publisher string, layers array<struct<authority_level string, publisher string, citation string>>, chain {ev}, evidence array<{ev}>, own {ev}"
    e = lambda c: (c, None, None, None, None, None)
    rows = [
        (1, "k", "", None, "", '{"a":1}', 0.0, None, "own", [("oem", None, "cite")], e("c1"), [e("c2")], e("c3")),
        (2, "k", "t", "s", "{}", None, 0.4, "L1", "own", [("", "pub", None)], e(""), [e("c2"), None], e("c3")),
        (3, None, None, None, None, None, None, None, None, None, None, [], e("c3")),
        (4, None, None, None, None, None, None, None, None, [], None, None, None),
    ]
    got = {r.candidate_id: r for r in applying.merger_rows(spark.createDataFrame(rows, schema)).collect()}
    assert [[x.chunk_id for x in got[i].evidence] for i in (1, 2, 3, 4)] == [["c1"], ["c2"], ["c3"], []]
    assert tuple(got[1])[1:9] == ("k", "", '{"a":1}', 0.85, "L3", "oem", "own", "cite") and tuple(got[2])[1:9] == ("t", "s", "{}", 0.4, "L1", "unspecified", "pub", None)
    assert tuple(got[4])[1:9] == ("", "", "{}", 0.85, "L3", "unspecified", None, None) and tuple(got[3].evidence[0])[1:] == ("", "", 0, "", "primary")


def test_an_update_of_nulls_changes_nothing_the_second_time(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "x", "b"), (3, None, "c"), (None, None, "d")], "k int, v string, other string")
    changes = spark.createDataFrame([(1, "n1"), (2, "n2"), (9, "n9")], "k int, v string")
    once = applying.updated(rows, changes, "k", ["v"], F.col("v").isNull())
    assert sorted(map(str, once.collect())) == sorted(map(str, [*spark.createDataFrame([(1, "n1", "a", True), (2, "x", "b", False), (3, None, "c", False), (None, None, "d", False)], "k int, v string, other string, changed boolean").collect()]))
    again = applying.updated(once.drop("changed"), changes, "k", ["v"], F.col("v").isNull())
    assert again.where("changed").count() == 0 and sorted(map(str, again.drop("changed").collect())) == sorted(map(str, once.drop("changed").collect()))


def test_requested_sections_are_covered_by_prefix(spark):
    rng = random.Random(5)
    found = [".".join(str(rng.randrange(4)) for _ in range(rng.randrange(1, 4))) for _ in range(30)] + [None, ""]
    asked = ["1", "1.", "2.3", "9", "", "3.1.2"]
    got = {r.prefix: (r.n_sections, r.covered) for r in applying.requested_covered(spark.createDataFrame([(a,) for a in asked * 2], "prefix string"), spark.createDataFrame([(f,) for f in found], "section_id string")).collect()}
    n = {a: len({f for f in found if f is not None and f.startswith(a)}) for a in asked}
    assert got == {a: (k, k > 0) for a, k in n.items()}


@pytest.mark.parametrize("n", [0, 60])
def test_health_of_objects_by_their_evidence(spark, n):
    rng = random.Random(n)
    words = ["Trane", "trane", "LG", "LGx", "特灵", "用特灵的", "chiller", "pump", "waterchiller", "York.", "x"]
    objects = [(i, rng.choice([None, "", "B"]), rng.choice([None, "", "M"]), rng.choice(["water_pump chiller", "", None, "pump", "cooling_tower_fan_a1"])) for i in range(n)]
    evidence = [(rng.randrange(n + 3), rng.choice([None, "", " ".join(rng.choice(words) for _ in range(4))])) for _ in range(3 * n)]
    o = spark.createDataFrame(objects, "ko_id int, brand string, model string, class_id string")
    e = spark.createDataFrame(evidence, "ko_id int, text string")
    texts = defaultdict(list)
    for k, t in evidence:
        if t:
            texts[k].append(t)
    pattern = r"\b(" + "|".join(health.BRANDS) + r")\b"
    named = {k: sorted(set(re.findall(pattern, " ".join(texts[k]), re.I))) for k, b, m, _ in objects if not b and not m}
    assert {r.ko_id: r.brands for r in health.ambiguous(o, e).collect()} == {k: v for k, v in named.items() if v}
    weak = {}
    for k, _, _, c in objects:
        tokens, low = set(re.findall("[a-z0-9]+", (c or "").lower())), " ".join(texts[k]).lower()
        found = {t for t in tokens if t in low}
        if tokens and texts[k] and len(found) / len(tokens) < 0.3:
            weak[k] = (sorted(found), sorted(tokens - found), round(len(found) / len(tokens), 3))
    assert {r.ko_id: (r.found, r.missing, r.ratio) for r in health.weak_anchors(o, e).collect()} == weak
