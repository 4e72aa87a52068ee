import itertools
import random

import numpy as np

from lorekiln.llm import toxicity as tox


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    crf = tox.Crf(move=rng.normal(size=(2, 2)))
    bounds = np.array([0, 4, 4, 5, 11])
    e = rng.normal(size=11)
    ahead, back = tox.chain(crf, e, bounds)
    got = tox._sigmoid(ahead + back)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        total, one = 0.0, np.zeros(b - a)
        for states in itertools.product((0, 1), repeat=b - a):
            s = sum(e[a + t] * y for t, y in enumerate(states)) + sum(crf.move[x, y] for x, y in zip(states, states[1:], strict=False))
            total += np.exp(s)
            one += np.exp(s) * np.array(states)
        if b > a:
            assert np.allclose(got[a:b], one / total)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lor", "men", "tis", "ran")]
    texts, labels = [], []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["Vileword", "zorgon" + rng.choice(["ic", "al", "ish", "eth"])]))
        texts.append(" ".join(words) + ".")
        labels.append(int(toxic))
    return texts, labels


def test_held_out_accuracy_and_spans():
    texts, labels = corpus(600, 1)
    crf = tox.fit(texts, labels)
    fresh, truth = corpus(200, 2)
    out = tox.score_texts(crf, fresh + ["", None, "é Vileword x"])
    score = out["score"].to_numpy()
    assert ((score[:200] >= 0.5) == np.array(truth)).mean() > 0.98
    assert (score[200:202] < 0.5).all() and score[202] >= 0.5
    assert out["span_starts"][202].as_py()[0] <= 2 and out["span_ends"][202].as_py()[0] >= 10  # offsets count characters
    right = wrong = 0
    for i in range(200):
        for a, b in zip(out["span_starts"][i].as_py(), out["span_ends"][i].as_py(), strict=True):
            hit = any(w in fresh[i][a:b].lower() for w in ("vileword", "zorgon"))
            right, wrong = right + hit, wrong + (not hit)
    assert right > 50 and wrong < 0.05 * right


def test_tables(spark):
    texts, labels = corpus(400, 3)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)] + [(None, texts[0], "x", 1.0), (7000, None, None, None), (5, texts[5], "x", 1.0)], "doc_id long, text string, toxic string, score double")
    known = spark.createDataFrame([(i, y, None) for i, y in enumerate(labels)] + [(3, 1 - labels[3], None), (None, 1, None), (9, None, None)], "doc_id long, toxic int, text string")
    crf = tox.learn(docs, known)
    got = tox.score_documents(docs, crf).collect()
    assert len(got) == 403
    right = [(r.predicted == labels[r.doc_id]) for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert len(right) > 40 and sum(right) > 0.95 * len(right)
    kept = tox.drop_toxic(docs, crf)
    assert kept.columns == docs.columns and kept.where("doc_id = 7000").count() == 1
    assert kept.count() == sum(r.score < 0.5 for r in got)
    one_kind = tox.learn(docs, known.where("toxic = 0"))
    assert {r.score for r in tox.score_documents(docs, one_kind).collect()} == {0.0}
    assert tox.score_documents(docs.limit(0), tox.learn(docs.limit(0), known)).count() == 0


def test_the_whole_query_matches_a_plain_forward_backward(spark, tmp_path):
    import zlib

    from lorekiln.llm import registry

    texts, labels = corpus(300, 9)
    rows = [(i, t) for i, t in enumerate(texts)] + [(300, None), (301, ""), (302, "clean words " * 4000 + "Vileword"), (5, "Vileword zorgonic"), (None, texts[0])]
    known = [(i, y) for i, y in enumerate(labels)] + [(7, 1 - labels[7]), (None, 1), (999, 1)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(known, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    first = {}
    for i, t in rows:
        if i is not None and t is not None:
            first[i] = min(t, first.get(i, t))
    taught = [(i, first[i], y) for i, y in enumerate(labels) if not out(i) and i != 7 and len(first[i]) <= tox.FIT_CHARS]
    crf = tox.fit([t for _, t, _ in taught], [y for *_, y in taught])
    move = np.exp(crf.move)

    def plain(text):
        buf = np.frombuffer((text or "").encode() + b"\n", np.uint8)
        feats, _, _, bounds = tox.features(tox.tv.FOLD[buf], np.array([0, len(buf)]))
        e = np.exp(tox.emissions(crf, feats))
        n = bounds[-1]
        ahead, back = np.ones((n, 2)), np.ones((n, 2))
        for t in range(n):
            v = (ahead[t - 1] @ move if t else np.ones(2)) * np.array([1.0, e[t]])
            ahead[t] = v / v.sum()
        for t in range(n - 2, -1, -1):
            v = move @ (back[t + 1] * np.array([1.0, e[t + 1]]))
            back[t] = v / v.sum()
        both = ahead * back
        p = both[:, 1] / both.sum(1) if n else np.zeros(0)
        most = min(max(p.max(), 1e-6), 1 - 1e-6) if n else 1e-6
        x = np.array([1.0, np.log(most / (1 - most)), np.log1p(sum(v for v in p if v >= 0.2))])
        return 1 / (1 + np.exp(-x @ crf.calibration))

    got = sorted((str(r.doc_id), r.score, r.held_out, r.predicted) for r in registry.op5_toxicity(spark, str(tmp_path)).collect())
    want = sorted((str(i), plain(t), out(i)) for i, t in rows)
    assert [(a, h) for a, _, h, _ in got] == [(a, h) for a, _, h in want]
    assert np.allclose([s for _, s, *_ in got], [s for _, s, _ in want], atol=1e-6)
    assert all(p == int(s >= 0.5) for _, s, _, p in got)
