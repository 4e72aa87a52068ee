import random

import numpy as np
import pytest

from lorekiln.llm import decontaminate as dc


def best_distance(item, text):
    """Edit distance of the item to the nearest stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != t)))
        row = new
    return min(row)


def planted(rng, items, rate):
    docs = []
    for words in items:
        v = list(words)
        for _ in range(int(rate * len(words))):
            kind, p = rng.choice("sid"), rng.randrange(len(v))
            if kind == "s":
                v[p] = f"z{rng.randrange(99)}"
            elif kind == "i":
                v.insert(p, "y")
            else:
                v.pop(p)
        pad = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60))]
        cut = rng.randrange(len(pad) + 1)
        docs.append(pad[:cut] + v + pad[cut:])
    return docs


def test_search_agrees_with_brute_force():
    rng = random.Random(2)
    items = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 40))] for _ in range(40)]
    docs = planted(rng, items, 0.0) + planted(rng, items, 0.1) + planted(rng, items, 0.2) + planted(rng, items, 0.45)
    found = dc.Items(list(range(40)), [" ".join(x) for x in items], 0.2).search([" ".join(d) for d in docs])
    want = missed = 0
    for d, hits in zip(docs, found, strict=True):
        for i, item in enumerate(items):
            far = best_distance(item, d)
            if i in hits:
                assert hits[i][0] == far <= int(0.2 * len(item))
            elif far <= int(0.2 * len(item)):
                missed += 1
            want += far <= int(0.2 * len(item))
    assert want >= 100 and missed <= 0.05 * want


def test_edited_items_beside_items_of_their_size():
    rng = random.Random(3)
    for n in (20, 45):
        items = [[f"w{rng.randrange(5000)}" for _ in range(n)] for _ in range(60)]
        edited = []
        for words in items:
            v = list(words)
            for p in rng.sample(range(n), n // 5):
                v[p] = f"z{rng.randrange(999)}"
            edited.append(v)
        search = dc.Items(list(range(60)), [" ".join(x) for x in items], 0.2).search
        between = search([" ".join(items[i - 1] + edited[i] + items[i - 2]) for i in range(60)])
        behind = search([" ".join(x) for i in range(60) for x in (items[i - 1], edited[i], items[i - 2])])
        for i in range(60):
            assert best_distance(items[i], items[i - 1] + edited[i] + items[i - 2]) == n // 5
        assert sum(f.get(i, (None,))[0] == n // 5 for i, f in enumerate(between)) >= 57
        assert sum(f.get(i, (None,))[0] == n // 5 for i, f in enumerate(behind[1::3])) >= 57
        assert all(set(f) == {(i - 1) % 60} for i, f in enumerate(behind[::3]))


def test_walk_keeps_near_texts_near():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**60, (200, 40)).astype(np.uint64)
    b = a.copy()
    b[:, 7] += np.uint64(1)
    seeds, size = np.arange(200), np.full(200, 40)
    near = (dc.walk(a, size, seeds, 120) != dc.walk(b, size, seeds, 120)).mean()
    far = (dc.walk(a, size, seeds, 120) != dc.walk(np.roll(a, 1, 0), size, seeds, 120)).mean()
    assert near < 0.3 < far


def test_tables(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, "solo"), (None, "x y z"), (1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    rows = [(1, "so: ALPHA beta, gamma\ndelta epsilon zeta."), (2, None), (3, ""), (4, "solo"), (None, "alpha beta gamma delta epsilon zeta"), (5, "alpha beta gamma"), (1, "clean")]
    docs = spark.createDataFrame([(*r, 7, "e") for r in rows], "doc_id long, text string, item_ids int, `odd name` string")
    got = dc.find_leaks(docs, bench).collect()
    assert len(got) == len(rows)
    assert [(r.doc_id, list(r.item_ids)) for r in got if r.contaminated] in ([(1, [1]), (None, [1])], [(None, [1]), (1, [1])])
    clean = dc.drop_leaks(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["1", "2", "3", "4", "5"]
    assert dc.find_leaks(docs, bench.limit(0)).where("contaminated").count() == 0
    assert dc.find_leaks(docs.limit(0), bench).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEM_BLOCK_WORDS", 3)
    bench = spark.createDataFrame([(i, " ".join(f"b{i}x{j}" for j in range(9))) for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, bench.collect()[2].text + " mid " + bench.collect()[5].text), (2, "none")], "doc_id long, text string")
    got = {r.doc_id: sorted(r.item_ids) for r in dc.find_leaks(docs, bench).collect()}
    assert got == {1: [2, 5], 2: []}
    assert [r.doc_id for r in dc.drop_leaks(docs, bench).collect()] == [2]


@pytest.mark.parametrize("words", [3, 1_000_000])
def test_rows_of_one_id_or_none_are_judged_by_their_own_texts(spark, monkeypatch, words):
    monkeypatch.setattr(dc, "ITEM_BLOCK_WORDS", words)
    bench = spark.createDataFrame([(i, " ".join(f"b{i}x{j}" for j in range(9))) for i in range(4)], "item_id long, text string")
    leak = [r.text for r in bench.orderBy("item_id").collect()]
    rows = [(1, leak[0]), (1, "clean"), (None, "clean"), (None, leak[1] + " " + leak[3]), (1, leak[2]), (2, "x " * 200_000 + leak[2])]
    got = sorted((str(r.doc_id), sorted(r.item_ids)) for r in dc.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    assert got == sorted([("1", [0]), ("1", []), ("None", []), ("None", [1, 3]), ("1", [2]), ("2", [2])])


@pytest.mark.parametrize("vocabulary", [20, 50, 5000])
def test_items_of_few_words_and_small_vocabularies_are_found_at_the_full_reach(vocabulary):
    rng = random.Random(vocabulary)
    found = total = 0
    for n in (5, 10, 20):
        items = [[f"v{rng.randrange(vocabulary)}" for _ in range(n)] for _ in range(60)]
        texts = []
        for item in items:
            v = list(item)
            for p in rng.sample(range(n), n // 5):
                v[p] = f"z{rng.randrange(999)}"
            texts.append(" ".join(["lead"] * 7 + v + ["tail"] * 7))
        got = dc.Items(list(range(60)), [" ".join(x) for x in items], 0.2).search(texts)
        found += sum(i in f for i, f in enumerate(got))
        total += 60
    assert found >= 0.99 * total


def test_a_reach_of_half_an_item_is_refused(spark):
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    with pytest.raises(ValueError):
        dc.find_leaks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench, max_edits=0.5)
