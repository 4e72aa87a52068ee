import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorekiln.functions import text as X
from lorekiln.operators import cluster, console


def recursive(keys, x, threshold, max_size):
    """The clusters by plain recursion, as sets."""
    found = {}
    for k, c in zip(keys, cluster.greedy_complete_linkage(keys, x[keys] @ x[keys].T, threshold), strict=True):
        found.setdefault(c, []).append(k)
    out = []
    for members in found.values():
        out += [frozenset(members)] if len(members) <= max_size or threshold >= 0.95 else recursive(members, x, round(threshold + 0.05, 10), max_size)
    return out


def test_oversize_clusters_are_tightened(spark):
    rng = np.random.default_rng(3)
    centres = np.repeat(rng.normal(size=(4, 6)), 20, axis=0)
    x = centres + rng.normal(scale=0.35, size=centres.shape)
    x[:20] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "k long, g string, v array<double>")
    got = {}
    for r in cluster.tightened(df, cluster.similar_pairs(df, "k", "v", "g", 0.7), "k", 0.7, 5).collect():
        got.setdefault(r.cluster, set()).add(r.k)
    want = recursive(list(range(80)), x, 0.7, 5)
    assert {frozenset(s) for s in got.values()} == set(want) and any(len(s) >= 20 for s in want)


def test_tightening_nothing(spark):
    df = spark.createDataFrame([], "k long, g string, v array<double>")
    assert cluster.tightened(df, cluster.similar_pairs(df, "k", "v", "g", 0.7), "k", 0.7).count() == 0


def test_titles_fall_back_to_the_last_asset_then_to_the_text(spark):
    entries = spark.createDataFrame(
        [(1, 1, "p", " own ", None, "x", "k"), (1, 1, "p", "", None, "x", "k"), (2, 1, "p", None, "", "a\nb", "k"), (None, 1, "p", None, None, None, None)],
        "doc int, chunk int, kind string, title string, summary string, excerpt string, key_candidate string",
    )
    assets = spark.createDataFrame([(1, 1, "p", 5, "old", ""), (1, 1, "p", 7, "new", ""), (None, 1, "p", 9, "lost", "lost")], "doc int, chunk int, kind string, asset int, title string, summary string")
    got = sorted((r.title, r.summary, r.traced) for r in console.review_center(entries, assets).collect())
    assert got == [("", "", False), ("k", "a b", False), ("new", "x", True), ("own", "x", True)]


def test_the_first_fault_of_an_edited_pack(spark):
    entry = "pack string, candidate int, decision string, title string, summary string"
    packs = lambda rows: spark.createDataFrame(rows, "pack string, doc int")
    old = spark.createDataFrame([("a", 1, "pending", None, None), ("b", 2, "pending", None, None), ("c", 3, "pending", None, None), ("d", 4, "pending", None, None)], entry)
    new = spark.createDataFrame([("a", 1, "accepted", "t", "s"), ("b", 9, "pending", None, None), ("c", 3, "accepted", " ", "s"), ("d", 4, "pending", None, None), ("e", 5, "pending", None, None)], entry)
    got = console.pack_edits(packs([("a", 1), ("b", 1), ("c", 1), ("d", None)]), packs([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 1)]), ["doc"], old, new)
    assert {r.pack: r.fault for r in got.collect()} == {"a": None, "b": "candidates_changed", "c": "unfinished_entry", "d": "doc_changed", "e": "unknown_pack"}


def test_identities_and_supporting_evidence(spark):
    e = spark.createDataFrame([("a", "accepted", "x"), ("a", "rejected", "y"), ("b", "accepted", "x"), ("b", "accepted", "y"), ("c", "pending", "x"), ("d", None, None), ("f", "accepted", None)], "pack string, decision string, class_id string")
    got = {r.pack: (r.n_accepted, r.class_id, r.fault) for r in console.accepted_identity(e).collect()}
    assert got == {"a": (1, "x", None), "b": (2, None, "several_classes"), "c": (0, None, "no_accepted"), "d": (0, None, "no_accepted"), "f": (1, None, "several_classes")}
    rows = spark.createDataFrame([("m", 1, [1, 2, 3, 4]), ("n", 1, [1]), ("o", 1, []), ("p", 1, None)], "candidate string, doc int, chunk_ids array<int>")
    chunks = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "chunk int, chunk_doc int")
    got = sorted((r.candidate, r.place, r.chunk, r.fault) for r in console.supporting_evidence(rows, chunks).collect())
    assert got == [("m", 2, 2, None), ("m", 3, 3, "other_document"), ("m", 4, 4, "unknown_chunk")]


def test_named_numbers(spark):
    df = spark.createDataFrame([("FC # 12", "R-22"), ("fc", "r 407 c"), (None, None), ("", "water")], "a string, b string")
    got = df.select(X.fault_number(F.col("a")).alias("n"), X.refrigerant(F.col("b")).alias("g")).collect()
    assert [(r.n, r.g) for r in got] == [("12", "r22"), (None, "r407c"), (None, None), (None, None)]


@pytest.mark.parametrize(("most", "last"), [(1 << 21, 0.95), (40, 0.5)])
def test_components_are_tightened_in_tasks_and_large_ones_in_rounds(spark, monkeypatch, most, last):
    """Keys with two rows, parted components, and one of more pairs than a task takes; where none is, a threshold more needs no job more."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(cluster, "TOGETHER", 3)
    monkeypatch.setattr(cluster, "PAIRS", most)
    x = np.concatenate([rng.normal(size=6) + rng.normal(scale=s, size=(n, 6)) for n, s in ((20, 0.3), (9, 0.5), (20, 0.05), (1, 1))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"k{i:03d}", "a", v.tolist()) for i, v in enumerate(x)], "k string, g string, v array<double>")
    pairs = cluster.similar_pairs(df, "k", "v", "g", 0.4).localCheckpoint()
    rows, got, rounds, cut = df.unionByName(df.where("k < 'k003'")), {}, [], cluster.cut
    monkeypatch.setattr(cluster, "cut", lambda d: rounds.append(1) or cut(d))
    for r in cluster.tightened(rows, pairs, "k", 0.4, 5, last=last).collect():
        got.setdefault(r.cluster, []).append(int(r.k[1:]))
    assert most == 40 or len(rounds) < 6

    def plain(keys, threshold):
        found = {}
        for k, c in zip(keys, cluster.greedy_complete_linkage(keys, x[keys] @ x[keys].T, threshold), strict=True):
            found.setdefault(c, []).append(k)
        size = lambda m: sum(1 + (k < 3) for k in m)
        return [y for m in found.values() for y in ([m] if size(m) <= 5 or threshold >= last else plain(m, round(threshold + 0.05, 10)))]

    want = plain(list(range(50)), 0.4)
    assert sorted(sorted(m) for m in got.values()) == sorted(sorted([*m, *(k for k in m if k < 3)]) for m in want) and max(map(len, want)) > 5


def test_a_threshold_that_no_link_reaches_ends_a_cluster():
    links = [(i, j, 0.5) for i in range(20) for j in range(i + 1, 20)]
    rows = pd.DataFrame([*((i, i, 1.0) for i in range(20)), *links], columns=["a", "b", "similarity"])
    assert cluster._tightened_in(rows, 0.5, 15, 0.05, 0.95).cluster.tolist() == list(range(20))
    assert cluster._tightened_in(rows, 0.5, 20, 0.05, 0.95).cluster.tolist() == [0] * 20
