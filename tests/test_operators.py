import numpy as np
from pyspark.sql import functions as F

from lorekiln.functions import values as V
from lorekiln.operators import candidates, cluster, components, dedupe, merge, sections, serve


def layers(*rows):
    return F.array(
        *(
            F.struct(F.lit(i).alias("ord"), F.lit(a).alias("authority_level"), F.lit(p).alias("publisher_id"), F.lit(v).alias("value"), F.lit(y).cast("int").alias("publication_year"), F.lit(n).cast("int").alias("sample_count"))
            for i, (a, p, v, y, n) in enumerate(rows)
        )
    )


def test_arbitration(spark):
    cases = [
        ([("field_observation", "a", "f", None, 5), ("oem_manual", "b", "o", None, None)], ("f", "rule_1_field_observation")),
        ([("field_observation", "a", "f", None, 4), ("oem_manual", "b", "o", None, None)], ("f", "fallback_highest_rank")),
        ([("industry_standard", "a", "old", 2018, None), ("industry_standard", "a", "new", 2021, None)], ("new", "rule_2_newer_standard")),
        ([("oem_manual", "a", "o", None, None), ("industry_standard", "a", "s", None, None)], ("s", "rule_3_standard_over_oem")),
        ([("oem_manual", "a", "x", 2015, None), ("oem_manual", "a", "y", 2020, None)], ("y", "rule_4_newer_oem")),
        ([("vendor_application_note", "a", "v", None, None), ("oem_manual", "a", "o", None, None)], ("o", "rule_5_oem_over_vendor_note")),
        ([("academic_reference", "a", "p", None, None), ("regulatory_code", "a", "r", None, None)], ("r", "rule_6_authority_over_academic")),
        ([("internal_sop", "a", "only", None, None)], ("only", None)),
    ]
    for rows, want in cases:
        got = spark.range(1).select(merge.arbitrate(layers(*rows)).alias("a")).first().a
        assert (got.value, got.rule) == want


def test_consensus_and_conflicts(spark):
    state = lambda *v: spark.range(1).select(merge.consensus(F.array(*(F.lit(x).cast("string") for x in v)), V.values_agree).alias("s")).first().s
    assert state("1") == "single_source" and state(None, None) == "single_value_unknown" and state("1", None) == "agreed"
    assert state("10", "10", "20") == "partial_conflict" and state("10", "20") == "disagreement" and state("10", "20", "30") == "disagreement"
    kind = lambda f, same=False: spark.range(1).select(
        merge.classify_conflict(F.array(*(F.array(*(F.lit(x).cast("string") for x in row)) for row in f)), F.lit(same)).alias("s")
    ).first().s
    assert kind([["a", None], ["b", None]]) == "over_merge" and kind([["a", None], [None, None]]) == "partial_conflict"
    assert kind([["a", "x"], ["a", "x"]]) == "value_disagreement" and kind([["a", None], ["a", None]]) == "material_conflict"
    assert kind([["a", None], ["a", None]], True) == "value_disagreement"


def test_clusters():
    sim = np.array([[1, 0.85, 0.6], [0.85, 1, 0.85], [0.6, 0.85, 1]])
    assert cluster.greedy_complete_linkage([0, 1, 2], sim, 0.78) == [0, 0, 2]


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len(got) == 61 + 100 + 1 and {got[i] for i in range(61)} == {0} and {got[i] for i in range(1000, 1100)} == {1000} and got[5000] == 5000
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sections_and_packs(spark):
    assert sections.chunk_page("aaaa. bbbb. cc", 10) == ["aaaa. bbbb.", "cc."]
    rows = spark.createDataFrame([(1, i, t, h) for i, (t, h) in enumerate([(50, False), (60, False), (10, True), (90, False), (300, False)])], "doc_id int, ord int, tokens int, is_heading boolean")
    assert [r.pack for r in sections.pack(rows, 120, 100).orderBy("ord").collect()] == [0, 0, 1, 1, 2]
    pages = spark.createDataFrame([(1, 1, None), (1, 2, "A"), (1, 3, "a"), (1, 4, None), (1, 5, "B")], "doc_id int, page_no int, heading string")
    assert [r.section for r in sections.heading_sections(pages).orderBy("page_no").collect()] == [1, 2, 2, 2, 3]


def test_containment_and_quotes(spark):
    chunks = spark.createDataFrame([("c1", "The water PUMP is on"), ("c2", "pumps")], "chunk_id string, text string")
    terms = spark.createDataFrame([("water pump",), ("pump",), ("",)], "term string")
    assert sorted(map(tuple, candidates.containment(chunks, terms).collect())) == [("c1", "pump"), ("c1", "water pump")]
    rows = spark.createDataFrame([(1, 1, "ends with the first"), (1, 2, "half of it")], "doc_id int, chunk_index int, text string")
    quotes = spark.createDataFrame([(7, "the first half"), (8, "half of")], "quote_id int, quote string")
    assert [tuple(r) for r in candidates.quotes_across(rows, quotes).collect()] == [(7, 1, 1)]


def test_jaccard_finds_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(1)
    sets = {i: sorted({rng.randrange(14) for _ in range(rng.randrange(1, 9))}) for i in range(60)}
    df = spark.createDataFrame([(i, "g", [str(x) for x in s]) for i, s in sets.items()], "id int, g string, w array<string>")
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if len({*sets[a]} & {*sets[b]}) >= 0.5 * len({*sets[a]} | {*sets[b]})}
    assert {(r.a, r.b) for r in dedupe.jaccard_pairs(df, "id", "w", "g", 0.5).collect()} == want


def test_serving(spark):
    assert serve.language_candidates("zh-CN") == ["zh-cn", "zh", "en"]
    got = spark.range(1).select(serve.hidden_when_disputed(F.lit("value_disagreement"), F.lit("fallback_highest_rank"), F.lit(5)).alias("x")).first().x
    assert got is None


def test_containment_takes_terms_of_any_number_of_lengths(spark):
    terms = [" ".join(f"w{j}" for j in range(n)) for n in range(1, 71)]
    chunks = spark.createDataFrame([("c", " ".join(f"w{j}" for j in range(70)))], "chunk_id string, text string")
    got = candidates.containment(chunks, spark.createDataFrame([(t,) for t in terms], "term string"))
    assert sorted(r.term for r in got.collect()) == sorted(terms)


def test_component_groups_of_the_tables(spark):
    """Union-find over the customers and suppliers that orders connect."""
    import duckdb

    from lorekiln import catalog

    sf = "/root/testdata/sf0.001"
    pairs = duckdb.sql(f"SELECT DISTINCT 'c' || o_custkey, 's' || l_suppkey FROM '{sf}/lineitem.parquet' JOIN '{sf}/orders.parquet' ON l_orderkey = o_orderkey").fetchall()
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    assert {(r.node, r.component) for r in catalog.queries()["component_groups"](spark, sf).collect()} == {(x, find(x)) for x in parent}


def test_merge_with_existing_cases(spark):
    from lorekiln.operators import merge

    members = [("c", "g1", "a"), ("c", "g1", "b"), ("c", "g2", "b"), ("c", "g2", "d"), ("c", "g3", "x"), ("c", "g4", "y"), ("c", "g5", "e"), ("d", "g6", "a")]
    existing = [("c", "k2", "old", "a"), ("c", "k1", "old2", "b"), ("c", "k3", "g9", "d"), ("c", "k4", "g3", "other"), ("c", "k5", "z", "e"), ("c", "k6", "g5", "else")]
    ev = [("g1", "c1", "primary"), ("g1", "c1", "primary"), ("g1", "c1", "supporting")]
    got = merge.merge_with_existing(
        spark.createDataFrame(members, "class_id string, key string, name string"),
        spark.createDataFrame(existing, "class_id string, ko_id string, key string, name string"),
        spark.createDataFrame(ev, "key string, chunk_id string, role string"),
    ).collect()
    by = {r.key: (r.ko_id, r.action, r.removed, r.n_evidence) for r in got}
    assert by["g1"] == ("k1", "merged_existing", "k2", 2)  # both names' objects: the smaller id stays
    assert by["g2"] == ("k3", "updated_existing", "", 0)  # b's object went to g1
    assert by["g3"] == ("k4", "adopted_key", "", 0)
    assert by["g4"][1] == by["g6"][1] == "new_merged" and by["g4"][0].startswith("ko_")
    assert by["g5"] == ("k5", "updated_existing", "k6", 0)  # another object has the group's key


def test_outline_of_any_depth(spark):
    from lorekiln.operators import sections

    rows = [("d", i, i + 1, i + 1, 50) for i in range(14)] + [("d", 20, 30, 12, 50)]
    df = spark.createDataFrame(rows, "doc_id string, ord int, start int, depth int, last_page int")
    ends = {r.ord: r.page_end for r in sections.outline_ends(df).collect()}
    assert ends[13] == 29 and ends[11] == 29 and ends[10] == 50 and ends[20] == 50


def test_fuzzy_pairs_find_all_pairs(spark):
    """All pairs of the small table, by their definition."""
    import difflib

    from lorekiln import catalog

    sf = "/root/testdata/sf0.001"
    rows = {(r.p_type, r.p_name) for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    want = set()
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    opposed = lambda x, y: any((p in x and q in y) or (q in x and p in y) for p, q in dedupe.OPPOSED)
    tail = lambda c, t: t.replace(" ", "_") + "_" + c.lower()
    for c, t in rows:
        for d, u in rows:
            if c == d and t < u and not opposed(t, u):
                why = "title" if ratio(t, u) >= 0.6 else "tail" if ratio(tail(c, t), tail(d, u)) >= 0.6 else None
                if why:
                    want.add((f"{c}/{t}", f"{d}/{u}", why))
    got = {(r.a, r.b, r.reason) for r in catalog.queries()["fuzzy_pairs"](spark, sf).collect()}
    assert want and got == want


def test_numbers_of_titles(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("fc #1 low", "fc 2 low"), ("fc 1", "fc#1"), ("level 2", "none"), ("50 % open", "60% open")], "a string, b string")
    assert [r[0] for r in df.select(dedupe.other_numbers(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]


def test_similar_sets_meet_in_blocks_within_tasks(spark, monkeypatch):
    """Blocks of few words, sizes that need several blocks, copies, string keys; no pair is shuffled before it is known to be similar."""
    import itertools
    import random

    monkeypatch.setattr(dedupe, "SENT_WORDS", 900)
    monkeypatch.setattr(dedupe, "HITS", 50)
    monkeypatch.setattr(dedupe, "RANKED", 30)
    rng = random.Random(7)
    sets = {}
    for i in range(140):
        base = rng.choice(list(sets.values())) if i > 20 and i % 2 else {f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 4, 30, 30, 30, 120]))}
        sets[f"k{i:03d}"] = {w for w in base if rng.random() < 0.95} | {f"w{rng.randrange(400)}" for _ in range(len(base) // 20)}
    group = {k: rng.choice(["g", "g", "g", "h", None]) for k in sets}
    df = spark.createDataFrame([(k, group[k], sorted(s)) for k, s in sets.items()], "id string, g string, w array<string>")
    want = {
        (a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        for a, b in itertools.combinations(sets, 2)
        if group[a] is not None and group[a] == group[b] and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])
    }
    out = dedupe.jaccard_pairs(df, "id", "w", "g", 0.6)
    assert {(r.a, r.b): r.similarity for r in out.collect()} == want and len(want) > 40 and out.count() == len(want)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
