import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorekiln.llm import ctw_lm as ctw


def grams(texts, depth):
    out = Counter()
    for _, buf, bounds in ctw.framed(texts, depth):
        out.update(ctw.grams_of(buf, depth)[ctw.coded(buf, bounds, depth)].tolist())
    return out


def bits_of(byte):
    return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]


class PlainTree:
    """Context-tree weighting as its definition says, a node at a time."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.below = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            data = b"\n" * depth + (text or "").encode() + b"\xff"
            for i in range(depth, len(data)):
                for d in range(depth + 1):
                    for code, bit in bits_of(data[i]):
                        self.counts[data[i - d : i], code][bit] += 1
                        if d < depth:
                            self.below[data[i - d : i], code].add(data[i - d - 1 : i])
        self.known: dict = {}

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, ctx, code):
        if (ctx, code) not in self.known:
            own = self.kt(*self.counts.get((ctx, code), (0, 0)))
            if len(ctx) < self.depth:
                deep = sum(self.weighted(c, code) for c in self.below.get((ctx, code), ()))
                own = max(own, deep) + math.log1p(math.exp(-abs(own - deep))) - math.log(2)
            self.known[ctx, code] = own
        return self.known[ctx, code]

    def log10(self, text):
        data, total = b"\n" * self.depth + (text or "").encode() + b"\xff", 0.0
        for i in range(self.depth, len(data)):
            for code, bit in bits_of(data[i]):
                q = 0.5
                for d in range(self.depth, -1, -1):
                    ctx = data[i - d : i]
                    n = self.counts.get((ctx, code), (0, 0))
                    stop = 1.0 if d == self.depth else math.exp(self.kt(*n) - math.log(2) - self.weighted(ctx, code))
                    q = stop * (n[bit] + 0.5) / (sum(n) + 1) + (1 - stop) * q
                total += math.log10(q)
        return total


def scores(texts, known, depth):
    """Score texts by a tree over known, with all of it weighed at once."""
    train, every = grams(known, depth), grams([*known, *texts], depth)
    key = np.array(sorted(every), np.uint64)
    q, _ = ctw.subtree(key, np.array([train[k] for k in key.tolist()]), depth, 0)
    value = dict(zip(key.tolist(), np.log10(q).sum(0), strict=True))
    return [sum(value[k] * n for k, n in grams([t], depth).items()) for t in texts]


def test_weighting_matches_a_plain_recursion():
    known = ["abracadabra abra", "the cat sat on the mat", ""]
    texts = [*known, "cat abra", "zzz", "ünï"]
    for depth in (1, 2, 4):
        plain = PlainTree(known, depth)
        assert scores(texts, known, depth) == pytest.approx([plain.log10(t) for t in texts], rel=1e-9)


def test_bytes_of_a_context_sum_to_one():
    depth, known = 3, grams(["the cat sat on the mat", "the hat", ""], 3)
    for context in (b"eht", b"ac ", b"zzz", b"\n\n\n"):  # the latest byte leads
        base = int.from_bytes(context, "big") << 8
        key = np.array(sorted({*known, *(base | b for b in range(256))}), np.uint64)
        q, _ = ctw.subtree(key, np.array([known.get(k, 0) for k in key.tolist()]), depth, 0)
        assert q.prod(0)[(key >= base) & (key < base + 256)].sum() == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize("split", [1, 2, 3])
def test_table_of_grams_is_the_whole_tree(spark, monkeypatch, split):
    monkeypatch.setattr(ctw, "TOGETHER", 40)
    depth, known, more = 4, ["the cat sat on the mat and ate", "", "the hat"], ["cats hate rats"]
    train, every = grams(known, depth), grams([*known, *more], depth)
    key = np.array(sorted(every), np.uint64)
    q, _ = ctw.subtree(key, np.array([train[k] for k in key.tolist()]), depth, 0)
    rows = spark.createDataFrame([(k, train[k], every[k]) for k in every], "key long, n long, seen long")
    got = {r.key: (r.value, r.seen) for r in ctw.gram_probabilities(rows, depth, split).collect()}
    assert set(got) == set(every) and all(got[k][1] == every[k] for k in every)
    assert [got[k][0] for k in key.tolist()] == pytest.approx(np.log10(q).sum(0).tolist(), rel=1e-5)


def test_lookup_and_gamma():
    keys = np.random.default_rng(0).integers(0, 2**60, 5000).astype(np.uint64)
    keys = np.unique(keys)
    table = ctw.Lookup(keys, np.arange(len(keys)))
    found, value = table.get(np.concatenate([keys, keys + np.uint64(1)]))
    assert found[: len(keys)].all() and (value[: len(keys)] == np.arange(len(keys))).all()
    assert found[len(keys) :].sum() == np.isin(keys + np.uint64(1), keys).sum()
    x = np.array([0.5, 1.0, 3.5, 100.25, 1e6])
    assert np.allclose(ctw._lgamma(x), [math.lgamma(v) for v in x])


@pytest.mark.parametrize("hot_grams", [0, 40, 1 << 20])
def test_tables_match_brute_force(spark, monkeypatch, hot_grams):
    monkeypatch.setattr(ctw, "HOT_TOKENS", 5)
    monkeypatch.setattr(ctw, "HOT_GRAMS", hot_grams)
    rows = [(i, f"The cat {i % 7} sat on\tthe mat number {i} again and again") for i in range(60)]
    rows += [(100, None), (101, ""), (None, "the cat"), (102, "ünïcode Ünïcode \x00 end"), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n int, key string")
    got = ctw.score_corpus(docs, depth=3).collect()
    assert len(got) == len(rows)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    plain = PlainTree([t for i, t in rows if not held(i)], 3)
    text_of = {(str(i), t): plain.log10(t) for i, t in rows}
    assert sorted((str(r.doc_id), r.score) for r in got) == [(i, pytest.approx(s, rel=1e-5)) for i, s in sorted((str(i), text_of[str(i), t]) for i, t in rows)]
    by_id = {r.doc_id: r for r in got}
    assert by_id[100].score == by_id[101].score
    assert by_id[7].bits_per_byte < min(3, by_id[102].bits_per_byte)
    untaught = [i for i, _ in rows if held(i)][0]
    lone = ctw.score_corpus(docs.where(f"doc_id = {untaught}")).collect()[0]
    assert lone.n_known == 0 and lone.train_tokens == 0 and lone.bits_per_byte > 7.9
    assert ctw.score_corpus(docs.limit(0)).count() == 0
