import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekiln.operators import cluster, substrings
from lorekiln.operators.ordered import ranked
from lorekiln.operators.substrings import SCALES, holding


def test_ranks_and_sums_within_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "b", None]), i, rng.randrange(9)) for i in range(800)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, c long").repartition(7)
    got = {r.k: (r.at, r.used) for r in ranked(df, ["g"], ["k"], "at", "c").collect()}
    want, seen = {}, {}
    for g, k, c in sorted(rows, key=lambda r: r[1]):
        n, s = seen.get(g, (0, 0))
        want[k] = (n, s)
        seen[g] = (n + 1, s + c)
    assert got == want
    assert ranked(df.limit(0), ["g"], ["k"]).count() == 0


@pytest.mark.parametrize("scales", [SCALES, ((3, 2, 2), (1, 1, 1))])
def test_strings_are_found_wherever_they_stand(spark, monkeypatch, scales):
    monkeypatch.setattr("lorekiln.operators.substrings.SCALES", scales)
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("ab cé\n") for _ in range(n))
    texts = [(i, i % 4, make(rng.choice([0, 2, 30, 200]))) for i in range(60)] + [(99, 0, None)]
    strings = []
    for j in range(120):
        _, d, t = rng.choice(texts)
        n = rng.choice([1, 2, 3, 6, 7, 14, 15, 30, 31, 60])
        at = rng.randrange(max(1, len(t or "") - n))
        strings.append((j, d if j % 3 else 1, (t or "")[at : at + n] if j % 5 else make(n)))
    strings += [(500, 1, None), (501, 1, ""), (502, None, "a")]
    tf, sf = spark.createDataFrame(texts, "k long, d long, text string"), spark.createDataFrame(strings, "j long, d long, string string")
    got = sorted((r.k, r.j) for r in holding(tf, sf.drop("d"), ["k"]).collect())
    assert got == sorted((k, j) for k, _, t in texts for j, _, s in strings if s and t and s in t)
    own = sorted((r.k, r.j) for r in holding(tf, sf, ["k"], within=("d",)).collect())
    assert own == sorted((k, j) for k, d, t in texts for j, e, s in strings if s and t and s in t and d == e)
    assert holding(tf, sf.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize(("block", "least"), [(2048, 0.2), (7, 0.2), (7, 0.6), (30, -0.3)])
def test_complete_linkage_in_rounds_is_greedy_in_row_order(spark, block, least):
    rng = np.random.default_rng(block)
    x = np.concatenate([rng.normal(size=(60, 4)), rng.normal(size=(30, 4)) * 0.1 + 3])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys = sorted(rng.choice(1000, len(x), replace=False).tolist())
    sim = x @ x.T
    pairs = [(keys[i], keys[j]) for i in range(len(x)) for j in range(i + 1, len(x)) if sim[i, j] >= least]
    df = spark.createDataFrame([(a, b) if a % 2 else (b, a) for a, b in pairs], "a long, b long")
    got = {r.key: r.cluster for r in cluster.complete_linkage(df, block).collect()}
    greedy = cluster.greedy_complete_linkage(keys, sim, least)
    assert got == {k: keys[c] for k, c in zip(keys, greedy, strict=True) if k in {x for p in pairs for x in p}}


def test_seven_hundred_equal_rows_are_one_cluster_and_no_pairs_none(spark):
    n = spark.range(700)
    pairs = n.select(F.col("id").alias("a")).join(n.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    assert {r.cluster for r in cluster.complete_linkage(pairs, 256).collect()} == {0}
    assert cluster.complete_linkage(pairs.limit(0)).count() == 0


def test_complete_linkage_of_names(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "a string, b string")
    assert {r.key: r.cluster for r in cluster.complete_linkage(df, 2).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


@pytest.mark.parametrize("window", [16, 1 << 19])
def test_scans_find_strings_of_any_length(monkeypatch, window):
    monkeypatch.setattr(substrings, "WINDOW", window)
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abé\n") for _ in range(n))
    texts = [None, "", *(make(rng.choice([1, 7, 8, 9, 40, 200])) for _ in range(60))]
    strings = sorted({make(1), *(t[i : i + n] for t in texts[2:] for n in (1, 2, 5, 7, 8, 9, 15, 16, 17, 31, 70) for i in [rng.randrange(len(t))]), *(make(12) for _ in range(9))} - {""})
    row, which = substrings.scanner(strings)(pa.array(["x", *texts]).slice(1))
    assert sorted(zip(row.tolist(), which.tolist(), strict=True)) == [(i, j) for i, t in enumerate(texts) for j, s in enumerate(strings) if t and s in t]
    assert not len(substrings.scanner([])(pa.array(texts))[0]) and not len(substrings.scanner(strings)(pa.array([], pa.string()))[0])


def test_many_strings_meet_texts_by_seeds_and_few_in_a_scan_or_by_their_key(spark, monkeypatch):
    """The same rows, those of repeated strings too, and no row for each seed of a text where strings are few."""
    texts = spark.createDataFrame([(i, i % 3, f"the number {i} stands in this text of {i % 7} words") for i in range(50)], "k long, d long, text string")
    strings = spark.createDataFrame([(j, j % 3, s) for j, s in enumerate(["number 1", "stands in this text", "t", "of 3 words", "of 3 words", "none"] * 3)], "j long, d long, string string")
    held = lambda within: holding(texts, strings if within else strings.drop("d"), ["k"], within=within)
    rows = lambda df: sorted((r.k, r.j, r.string) for r in df.collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    want = {w: rows(held(w)) for w in ((), ("d",))}
    assert all("_seed" not in plan(held(w)) for w in want) and len(want["d",]) > 50
    monkeypatch.setattr(substrings, "SENT", 2)
    for most in (0, 5):
        monkeypatch.setattr(substrings, "PER_KEY", most)
        assert all("_seed" in plan(held(w)) and rows(held(w)) == want[w] for w in want)
