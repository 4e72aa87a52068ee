import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekiln.functions import text as X
from lorekiln.operators import answers, candidates, cluster, facet_rules, grouping, merge, merge_store, sections


def test_the_fold_repacks_pages_as_the_plain_version_does(spark):
    rng = random.Random(3)
    texts = ["", None, "\n\n", "a" * 1200, " lead\n\n\n\ntail "]
    for _ in range(40):
        paras = [". ".join("w" * rng.randrange(0, 30) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(5))]
        texts.append("\n\n".join(paras))
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r.c for r in rows.select("k", sections.chunk_array(F.col("text"), 40).alias("c")).collect()}
    assert got == {k: sections.chunk_page(t, 40) for k, t in enumerate(texts)}
    chunks = sections.page_chunks(rows, ["k"], most=40).collect()
    assert sorted((c.k, c.chunk_index) for c in chunks) == [(k, i) for k, v in sorted(got.items()) for i, c in enumerate(v) if c.strip()]


def test_answers_are_mended_and_faults_kept(spark):
    good = {"knowledge_object_type": " fault_code ", "canonical_key_candidate": "k", "structured_payload_candidate": {"a": [1, {"b": None}]}, "confidence_score": "7", "rationale": " why "}
    item = lambda **x: json.dumps({"candidates": [good | x]})
    cases = [
        (item(), (0, "fault_code", "k", 0.95, "why", None)),
        ("```json\n" + item(confidence_score=-1)[:-1] + ",}\n```", (0, "fault_code", "k", 0.0, "why", None)),
        ("so: " + item(confidence_score="x", rationale=None) + " done", (0, "fault_code", "k", 0.72, answers.NO_RATIONALE, None)),
        (item(confidence_score=0.12345), (0, "fault_code", "k", 0.123, "why", None)),
        (item(knowledge_object_type="other"), (0, None, None, None, None, "kind")),
        (item(canonical_key_candidate="  "), (0, None, None, None, None, "key")),
        (item(structured_payload_candidate=[1]), (0, None, None, None, None, "payload")),
        ('{"candidates": ["text"]}', (0, None, None, None, None, "no object")),
        ('{"candidates": []}', (None, None, None, None, None, "no candidates")),
        ('{"candidates": {"a": 1}}', (None, None, None, None, None, "no candidates")),
        ("{}", (None, None, None, None, None, "no candidates")),
        ("[1]", (None, None, None, None, None, "no object")),
        ('{"a": ', (None, None, None, None, None, "malformed")),
        ("no json", (None, None, None, None, None, "malformed")),
        ("  ", (None, None, None, None, None, "empty")),
        (None, (None, None, None, None, None, "empty")),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i long, content string")
    got = {r.i: r for r in answers.candidate_rows(df, ["fault_code"]).collect()}
    for i, (_, want) in enumerate(cases):
        r = got[i]
        assert (r.pos, r.kind, r.key, r.confidence, r.rationale, r.fault) == want, cases[i]
    assert json.loads(got[0].payload) == good["structured_payload_candidate"]


def test_the_rule_with_the_longest_keyword_wins(spark):
    rng = random.Random(6)
    words = ["oil", "oil temp", "oil temperature", "water", "冷却水", "温度", "油温", "supply temperature", "t"]
    rules = [(rng.choice(["a", "b"]), f"v{i % 33}", rng.choice(words) + ("" if i % 3 else f" {i}"), i % 33) for i in range(99)] + [("a", None, "oil", 1), ("a", "x", " ", 1)]
    texts = [(i, " ".join(rng.choice([*words, f"oil {i}", "Oil Temperature 3", "冷却水温度"]) for _ in range(rng.randrange(6)))) for i in range(120)] + [(500, None)]
    table = {}
    for axis, value, word, ord_ in rules:
        if value and word.strip():
            keys, o = table.setdefault((axis, value), ([], []))
            keys.append(word.lower())
            o.append(ord_)
    want = {}
    for key, text in texts:
        for axis in "ab":
            fit = [(-max(map(len, ks)), min(o), v) for (x, v), (ks, o) in table.items() if x == axis and any(k in (text or "").lower() for k in ks)]
            if fit:
                want[key, axis] = min(fit)[2]
    tf, rf = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(rules, "axis string, value string, keyword string, ord long")
    assert {(r.k, r.axis): r.value for r in facet_rules.facets(tf, rf, "k").collect()} == want
    wide = facet_rules.signature(tf, rf, "k", ["a", "b", "c"]).collect()
    assert len(wide) == len(texts) and all(r.c is None and r.a == want.get((r.k, "a")) for r in wide)
    tree = spark.createDataFrame([("t", None), ("u", "t"), ("v", "u"), ("w", "w")], "tag string, parent string")
    assert sorted((r.tag, r.ancestor, r.depth) for r in facet_rules.descendants(tree).collect()) == [("u", "t", 1), ("v", "t", 2), ("v", "u", 1), ("w", "w", 1)]


def plain_groups(rows, aliases):
    """Class by class, names in order; facets are (quantity, subtype)."""
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted({r[1].strip(): r for r in rows if r[0] == c and (r[1] or "").strip()}.items())
        names = [n for n, _ in mine]
        vec = {n: np.array(r[2], float) / np.linalg.norm(r[2]) for n, r in mine}
        facet = {n: r[3:5] for n, r in mine}

        def link(part, least, vec=vec):
            part = sorted(part)
            x = np.array([vec[n] for n in part])
            got = {}
            for n, k in zip(part, cluster.greedy_complete_linkage(part, x @ x.T, least), strict=True):
                got.setdefault(k, []).append(n)
            return list(got.values())

        def anew(part, least):
            return [p if len(p) <= 8 or least >= 0.95 else q for p in link(part, least) for q in [p]]

        groups = [g for p in link(names, 0.9) for g in ([p] if len(p) <= 10 else [y for q in anew(p, 0.95) for y in ([q] if len(q) <= 10 else [[n] for n in q])])]
        for axis in (0, 1):
            split = []
            for g in groups:
                known = {facet[n][axis] for n in g} - {None}
                if not known or (len(known) == 1 and (axis == 0 or all(facet[n][axis] for n in g))):
                    split.append(g)
                else:
                    by = {}
                    for n in g:
                        by.setdefault(facet[n][axis], []).append(n)
                    split += by.values()
            groups = split

        def key(n, facet=facet):
            q, s = facet[n]
            return (("s", s),) if s else (("q", q),) if q else None

        alike, rest = {}, []
        for g in groups:
            if len({key(n) for n in g}) == 1 and key(g[0]):
                alike.setdefault(key(g[0]), []).extend(g)
            else:
                rest.append(g)
        groups = rest + [p for g in alike.values() for p in link(g, 0.85)]
        for g in (y for p in groups for y in ([p] if len(p) <= 8 else [[n] for n in p])):
            known = [aliases[n] for n in sorted(g) if n in aliases]
            for n in g:
                out[c, n] = (min(g), known[0] if known else None)
    return out


@pytest.mark.parametrize("block", [12, 2048])
def test_names_are_grouped_as_stage_after_stage_says(spark, monkeypatch, block):
    monkeypatch.setattr(cluster.complete_linkage, "__defaults__", (block,))
    rng = np.random.default_rng(11)
    rows = []
    for g in range(12):
        base = rng.normal(size=6)
        for i in range(int(rng.integers(1, 16))):
            v = base + rng.normal(size=6) * rng.choice([0.02, 0.2, 0.45])
            rows.append((g % 2, f"name {g:02d} {i:02d}", v.tolist(), rng.choice(["t", "p", None]), rng.choice(["u", None, None])))
    aliases = {f"name {g:02d} 03": f"key{g % 5}" for g in range(12)}
    df = spark.createDataFrame([*rows, rows[0], (0, " ", [1.0] * 6, None, None)], "class_id long, name string, vector array<double>, quantity string, subtype string")
    af = spark.createDataFrame(list(aliases.items()), "alias string, key string")
    got = {(r.class_id, r.name): (r.cluster, r.key) for r in grouping.named_groups(df, af, ["quantity", "subtype"], subtype="subtype").collect()}
    want = plain_groups(rows, aliases)
    assert {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in want.items()}
    assert all(got[k][1] == key for k, (_, key) in want.items() if key)
    assert got[0, "name 00 00"][1] is not None
    slug = spark.range(1).select(X.safe_slug(F.lit("name 01 00"))).first()[0]
    assert all(k == slug for (c, k) in got.values() if c == "name 01 00" and k not in aliases.values())


def sequential(groups, members, new_evidence, objects, names, evidence):
    """Group after group, in the order of their keys, on a store that changes as it goes."""
    store = {o[1]: dict(zip(("scope", "ko", "key", "title", "status", "conf", "chunk"), o, strict=True)) for o in objects}
    before = {}
    for ko, name in sorted(names):
        before[store[ko]["scope"], name] = ko
    ev = {ko: {} for ko in store}
    for eid, ko, chunk, role in sorted(evidence, key=str):
        ev[ko].setdefault((chunk, role), eid)
    done, gone, into = set(), set(), {}
    for scope, key, title, state, conf in sorted(groups):
        mine = {before.get((s, n)) for s, k, n in members if (s, k) == (scope, key)} - {None} - done - gone
        same = sorted(o for o, r in store.items() if r["scope"] == scope and r["key"] == key and o not in done and o not in gone and o not in mine)
        ids = sorted(mine) + same
        target = ids[0] if ids else None
        moved = {}
        for o in ids[1:]:
            gone.add(o)
            into[o] = target
            for ref, eid in ev.pop(o).items():
                moved[ref] = min(eid, moved.get(ref, eid))
            store.pop(o)
        fresh = target is None
        if fresh:
            target = ("new", scope, key)
            store[target] = {"scope": scope, "status": "draft", "conf": None, "chunk": None}
            ev[target] = {}
        for ref, eid in moved.items():
            ev[target].setdefault(ref, eid)
        refs = {(c, r) for s, k, c, r in new_evidence if (s, k) == (scope, key)}
        for ref in refs:
            ev[target].setdefault(ref, None)
        o = store[target]
        chunk = o["chunk"] if o["chunk"] is not None else min((c for c, _ in refs), default=None)
        status = "conflict_review_required" if state in merge_store.IN_CONFLICT else o["status"]
        store[target] = {"scope": scope, "key": key, "title": title, "status": status, "conf": max(conf, o["conf"] or 0), "chunk": chunk}
        done.add(target)
    return store, ev, into


def test_merging_writes_what_group_after_group_would_and_again_changes_nothing(spark, tmp_path):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(30)]
    key_of = {(s, n): f"key{rng.randrange(9)}" for s in ("a", "b") for n in names}
    members = [(s, k, n) for (s, n), k in key_of.items() if rng.random() < 0.8]
    groups = [(s, k, f"title {k}", rng.choice(["agreed", "material_conflict"]), round(rng.random(), 2)) for s, k in sorted({m[:2] for m in members})]
    objects = [(rng.choice("ab"), f"k{i:02d}", f"key{rng.randrange(14)}", f"old {i}", "published", round(rng.random(), 2), rng.choice([None, 5])) for i in range(24)]
    own = [(o[1], n) for o in objects for n in rng.sample(names, rng.randrange(4))]
    evidence = [(f"e{i:03d}", rng.choice(objects)[1], rng.randrange(6), rng.choice(["p", "s"])) for i in range(90)]
    fresh = [(s, k, rng.randrange(8), rng.choice(["p", "s"])) for s, k, *_ in groups for _ in range(3)]
    frames = [
        spark.createDataFrame(groups, "scope string, key string, title string, state string, confidence double"), spark.createDataFrame(members, "scope string, key string, name string"),
        spark.createDataFrame(fresh, "scope string, key string, chunk_id long, role string"),
        spark.createDataFrame(objects, "scope string, ko_id string, key string, title string, status string, confidence double, primary_chunk long"),
        spark.createDataFrame(own, "ko_id string, name string"), spark.createDataFrame(evidence, "evidence_id string, ko_id string, chunk_id long, role string"),
    ]
    out = merge_store.merge_into_store(*frames, ["scope"])
    store, ev, into = sequential(groups, members, fresh, objects, own, evidence)
    rows = out["objects"].collect()
    name_of = {("new", r.scope, r.key): r.ko_id for r in rows if r.ko_id.startswith("ko_")}
    want = sorted((o["scope"], name_of.get(i, i), o["key"], o["title"], o["status"], o["conf"], str(o["chunk"])) for i, o in store.items())
    assert sorted((r.scope, r.ko_id, r.key, r.title, r.status, r.confidence, str(r.primary_chunk)) for r in rows) == want
    assert {(r.ko_id, r.into) for r in out["moved"].collect()} == {(a, name_of.get(b, b)) for a, b in into.items()}
    got = {(r.ko_id, r.chunk_id, r.role): r.evidence_id for r in out["evidence"].collect()}
    assert set(got) == {(name_of.get(i, i), *ref) for i, refs in ev.items() for ref in refs}
    assert all(got[name_of.get(i, i), *ref] == eid for i, refs in ev.items() for ref, eid in refs.items() if eid)
    merge_store.write_store(out, str(tmp_path), "scope")
    merge_store.write_store(out, str(tmp_path), "scope")
    read = [spark.read.parquet(f"{tmp_path}/{t}").select(out[t].columns) for t in ("objects", "names", "evidence")]
    again = merge_store.merge_into_store(*frames[:3], *read, ["scope"])
    assert again["moved"].count() == 0
    for t, df in zip(("objects", "names", "evidence"), read, strict=True):
        assert sorted(map(str, again[t].select(df.columns).collect())) == sorted(map(str, df.collect())) == sorted(map(str, out[t].collect()))


def test_keys_go_around_reserved_numbers(spark):
    rows = [("a", i) for i in range(6)] + [("b", i) for i in range(3)] + [("a_3", 9), ("c", 1), ("d_7", 1), ("d_7", 2)]
    reserved = {"a_2", "a_4", "b", "b_x", "b_02", "d_7_2", "c_2", "zz_9"}
    got = {(r.base, r.n): r.unique_key for r in merge.keys_around(spark.createDataFrame(rows, "base string, n long"), "base", ["n"], spark.createDataFrame([(k,) for k in reserved], "key string")).collect()}
    used = set(reserved) | {b for b, _ in rows if b[-1].isdigit()}
    want = {}
    for base, group in itertools.groupby(sorted(rows), lambda r: r[0]):
        numbers = (base if i == 1 else f"{base}_{i}" for i in itertools.count(1))
        free = (k for k in numbers if k not in used or (k == base and base not in reserved))
        want |= {r: next(free) for r in group}
    assert got == want and len(set(got.values())) == len(rows)


def test_overlaps_are_found_without_pairs(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(4), i, s := rng.randrange(60), s + rng.randrange(8)) for i in range(80)]
    got = {(r.d, r.k) for r in sections.overlapping_ranges(spark.createDataFrame(rows, "d long, k long, a long, b long"), "d", "a", "b", "k").collect()}
    assert got == {(d, k) for d, k, a, b in rows if any(d == e and (x, y, j) < (a, b, k) and y >= a for e, j, x, y in rows)}


def test_candidates_stand_on_quotes_else_on_terms(spark):
    chunks = spark.createDataFrame([(1, "c1", 1, 1, "The pump trips. Code E42 shown"), (1, "c2", 2, 3, "code e42: the PUMP trips again"), (2, "c3", 1, 1, "nothing here")], "doc_id long, chunk_id string, chunk_index long, page_no long, text string")
    asked = [("q1", 1, "pump, trips", None), ("q2", 1, "not there", "E42 / x"), ("q3", 1, "not there", "ab"), ("q4", 2, "pump trips", "E42"), ("q5", 1, None, None)]
    got = {r.candidate_id: (r.chunk_id, r.page_no, r.n_chunks, r.reason) for r in candidates.anchored(spark.createDataFrame(asked, "candidate_id string, doc_id long, quote string, code string"), chunks, ["code"]).collect()}
    none = (None, None, 0, "rejected")
    assert got == {"q1": ("c1", 1, 2, "verbatim"), "q2": ("c1", 1, 2, "repaired"), "q3": none, "q4": none, "q5": none}


def test_windows_are_the_last_of_their_changes(spark, tmp_path):
    import datetime as dt

    from lorekiln.streaming import feedback

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    schema = "ts timestamp, event_type string, value double"
    for part, hours in enumerate([(1, 2, 30), (3, 31, 55)]):
        spark.createDataFrame([(at(h), "view", 1.0) for h in hours], schema).write.parquet(f"{tmp_path}/in/{part}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = lambda: feedback.upserted(feedback.windowed(stream(), late="100 hours"), ["w", "event_type"], f"{tmp_path}/out", f"{tmp_path}/state")
    want = [(0, 3), (1, 2), (2, 1)]
    for _ in range(2):  # a second run finds nothing new and leaves the result
        assert sorted(((r.w.start - at(0)).days, r.n) for r in run().collect()) == want


def test_headings_of_pages(spark):
    from lorekiln.functions import headings

    cases = [
        ("12 PUMP CONTROL\nThe pump runs.", "PUMP CONTROL"), ("3.2 chapter\nAir Handling Units", "Air Handling Units"), ("this is prose.\nSafety Notes And Limits", "Safety Notes And Limits"),
        ("only prose here that goes on", None), ("CHAPTER\nsection\n1.2.3 Overview of", "1.2.3 Overview of"), ("Appendix b of it:", None), ("appendix b of it", "appendix b of it"),
        ("•\tBullet Point List", None), ("Ünder Ärea", "Ünder Ärea"), ("", None), (None, None), ("\n".join(["prose line goes on"] * 8 + ["Late Heading"]), None),
        ("A B C D E F G H I J K L M N O", None), ("Running Head Words\nReal Title", "Real Title"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i long, t string")
    got = {r.i: r.h for r in df.select("i", headings.page_heading(F.col("t"), titles=("running head",)).alias("h")).collect()}
    assert got == {i: h for i, (_, h) in enumerate(cases)}


def test_stages_note_what_they_wrote(spark, tmp_path):
    from lorekiln.operators import stages

    jobs, rows = f"{tmp_path}/jobs", spark.range(50).withColumn("bad", F.col("id") % 7 == 0)
    stages.observed("j", "one", rows, lambda df: df.write.parquet(f"{tmp_path}/one"), jobs, F.col("bad"))
    stages.observed("j", "none", rows.limit(0), lambda df: df.write.parquet(f"{tmp_path}/none"), jobs)
    with pytest.raises(Exception, match="already exists"):
        stages.observed("j", "two", rows, lambda df: df.write.mode("error").parquet(f"{tmp_path}/one"), jobs)
    noted = {r.stage: (r.status, r.rows, r.faults) for r in spark.read.parquet(jobs).collect()}
    assert noted == {"one": ("success", 50, 8), "none": ("success", 0, 0), "two": ("failed", None, None)}
    assert spark.read.parquet(f"{tmp_path}/one").count() == 50
    assert [(r.succeeded, r.failed, r.rows) for r in stages.job_summary(spark, jobs).collect()] == [(2, 1, 50)]


def test_fixtures_become_tables_in_one_pass(spark, tmp_path):
    from lorekiln.operators import fixtures

    full = {"doc_id": "d", "file_hash": "h", "title": "T", "pages": [{"page_no": 1, "chunks": [{"chunk_index": 0, "text": "x", "objects": [{"key": "k", "title": "K", "role": "p"}, {"key": None}]}, {"chunk_index": 1, "text": "y"}]}, {"page_no": 2}, None]}
    rows = [json.dumps(full), json.dumps(full), json.dumps({"doc_id": "e"}), json.dumps({"title": "none"}), "no json", None, json.dumps({"doc_id": "d/2", "pages": []})]
    out = {t: sorted(map(tuple, df.collect())) for t, df in fixtures.expand(spark.createDataFrame([(r,) for r in rows], "content string"), f"{tmp_path}/f").items()}
    assert [r[0] for r in out["documents"]] == ["d", "d/2", "e"] and [r[0] for r in out["pages"]] == ["d/1", "d/2"]
    assert [(k, p, json.loads(x)["text"]) for k, _, p, x in out["chunks"]] == [("d/1/0", "d/1", "x"), ("d/1/1", "d/1", "y")]
    assert [r[0] for r in out["objects"]] == ["k"] and [(r[0], r[2]) for r in out["evidence"]] == [("k@d/1/0", "k")]
    known = spark.createDataFrame([("d", "stored")], "doc_id string, stored_id string")
    moved = fixtures.remapped(spark.createDataFrame(out["chunks"], "key string, doc_id string, parent string, payload string"), known).collect()
    assert sorted((r.doc_id, r.key, r.parent) for r in moved) == [("stored", "stored/1/0", "stored/1"), ("stored", "stored/1/1", "stored/1")]


def test_yaml_packages_round_trip(spark, tmp_path):
    from lorekiln.sources import packages

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.yaml").write_text("points:\n  T: {subtype: temp, keywords: [Temperature, 温度]}\n  O: {subtype: oil, keywords: [oil temperature]}\n  N: {keywords: [x]}\npolarity:\n  high: {keywords: [over]}\nwhen: 2024-01-02\n", "utf-8")
    (tmp_path / "in/sub/b.yml").write_text("[1, two]")
    (tmp_path / "in/c.yaml").write_text("a: [1\nb: }")
    (tmp_path / "in/d.yaml").write_text("just text")
    docs = packages.yaml_documents(spark, f"{tmp_path}/in")
    got = {r.path.rsplit("/", 1)[1]: (r.content is not None, r.fault) for r in docs.collect()}
    assert got["a.yaml"] == got["b.yml"] == (True, None) and got["d.yaml"] == (False, "no mapping or list") and not got["c.yaml"][0] and got["c.yaml"][1]
    rules = packages.rule_table(docs, {"points": "subtype", "polarity": None})
    assert sorted((r.axis, r.value, r.keyword) for r in rules.collect()) == [("points", "oil", "oil temperature"), ("points", "temp", "Temperature"), ("points", "temp", "温度"), ("polarity", "high", "over")]
    from lorekiln.sources import readers

    assert {r.key: json.loads(r.value) for r in readers.package(spark, f"{tmp_path}/in/a.yaml").collect()}["when"] == "2024-01-02"
    text = spark.createDataFrame([(1, "Oil Temperature is over"), (2, "温度")], "k long, text string")
    assert {(r.k, r.axis): r.value for r in facet_rules.facets(text, rules, "k").collect()} == {(1, "points"): "oil", (1, "polarity"): "high", (2, "points"): "temp"}
    body = docs.where("fault IS NULL").select(F.regexp_replace(F.substring_index("path", "/", -1), r"\..*", "").alias("name"), F.to_json("content").alias("content"))
    for _ in range(2):
        packages.write_yaml(body, f"{tmp_path}/out")
    again = packages.yaml_documents(spark, f"{tmp_path}/out", "*.txt")
    assert sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in again.select(F.to_json("content")).collect()) == sorted(json.dumps(json.loads(r.content), sort_keys=True) for r in body.collect())


@pytest.mark.parametrize("most", [100, 3])
def test_a_text_gives_a_row_for_each_axis_where_rules_are_few(spark, monkeypatch, most):
    """The rows that reach the groups; more rules than are sent give the same facets."""
    monkeypatch.setattr(facet_rules, "SENT", most)
    rules = [(axis, f"v{i}", word, i) for axis in "ab" for i, word in enumerate(["pump", "pumps", "oil", "pumps", "x"])] + [(None, "n", "oil", 9)]
    texts = [(1, "Pumps and OIL"), (1, "a pump and oil in it"), (2, "oil oil"), (3, "none"), (4, None)]
    df = facet_rules.facets(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(rules, "axis string, value string, keyword string, ord long"), "k")
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, "a", "v1"), (1, "b", "v1"), (1, None, "n"), (2, "a", "v2"), (2, "b", "v2"), (2, None, "n")], key=str)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert ("MapInArrow" in plan) and ("min_by" in plan) == (most == 3)
