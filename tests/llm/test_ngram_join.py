import itertools
import random
import re

import pytest

from lorekiln.llm import ngram_join as nj

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_set(text, k=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset([text or ""])


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {rows[i][0]: (links[i], rows[find(i)][0]) for i in range(len(rows))}


@pytest.mark.parametrize("block", [7, 256])
def test_links_and_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    rng = random.Random(3)
    texts = [None, "", "!!!", "one two", "ONE two.", "One, Two", "x" * 100]
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    for _ in range(40):  # one large group of near copies
        t = list(base)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(base)] * 12
    for _ in range(20):  # related, at all similarities
        t = list(base)
        for _ in range(rng.randrange(4, 40)):
            t[rng.randrange(len(t))] = "q"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, rep string, n double")
    got = {r.doc_id: (r.n_links, r.component_id) for r in nj.ngram_jaccard_join(df).collect()}
    assert got == brute(rows)


def test_one_of_each_stays_and_edge_cases(spark):
    rows = [(5, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (9, None), (8, "")]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, kept_id int, k1 string")
    kept = nj.keep_one_of_each(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [2, 8] and sum(r.doc_id is None for r in kept) == 1
    assert nj.keep_one_of_each(df.limit(0)).count() == 0


def test_rows_of_one_id_or_none_are_linked_by_their_own_texts(spark):
    rng = random.Random(5)
    long = [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(4)]
    near = lambda t: t.replace(t.split()[30], "zz", 1)
    rows = [(2, long[0]), (2, long[1]), (3, near(long[1])), (None, long[2]), (7, near(long[2])), (None, long[3]), (4, long[0]), (2, long[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_links, str(r.component_id)) for r in nj.ngram_jaccard_join(df, threshold=0.7).collect())
    assert got == sorted([("2", 2, "2"), ("2", 1, "2"), ("3", 1, "2"), ("None", 1, "7"), ("7", 1, "7"), ("None", 0, "None"), ("4", 2, "2"), ("2", 2, "2")])
    kept = [(r.doc_id, r.text) for r in nj.keep_one_of_each(df, threshold=0.7).collect()]
    assert sorted(kept, key=str) == sorted([(2, long[0]), (2, long[1]), (None, long[2]), (7, near(long[2])), (None, long[3])], key=str)


@pytest.mark.parametrize("words", [30, 300, 3000])
def test_bytes_of_unrelated_texts_agree_by_chance_only_and_pairs_at_0_4_are_pruned(words):
    rng = random.Random(words)
    sig = lambda texts: [list(b) for b in nj._signatures(texts, 5)["sig"].to_pylist()]
    apart = sig([" ".join(f"w{rng.randrange(10**7)}" for _ in range(words)) for _ in range(20)])
    same = [sum(x == y for x, y in zip(a, b, strict=True)) / 160 for a, b in itertools.combinations(apart, 2)]
    assert sum(same) / len(same) < 0.01
    least, pruned = nj.least_matches(160, nj.THRESHOLD, nj.TOLERANCE), 0
    for _ in range(20):
        base = [f"w{rng.randrange(10**7)}" for _ in range(words)]
        other = base[: int(words * 0.57)] + [f"x{rng.randrange(10**7)}" for _ in range(words - int(words * 0.57))]  # Jaccard of some 0.4
        a, b = sig([" ".join(base), " ".join(other)])
        pruned += sum(x == y for x, y in zip(a, b, strict=True)) < least
    assert pruned >= 18


def test_pruning_keeps_pairs_at_the_threshold():
    least = nj.least_matches(160, 0.8, 1e-6)
    assert 80 < least < 128  # far below the 128 expected matches of a pair at 0.8
    assert nj.least_matches(32, 0.8, 1e-6) < 20
