import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from lorekiln.llm import collocations as co


def brute(rows, least, longest, top, covered):
    counts = {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        c = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                c.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in counts.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cands = {p: v for p, v in c.items() if len(p) > 1 and v >= least}
        gone = set()
        for q, f in cands.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    if 100 * f >= covered * cands[q[i : i + size]]:
                        gone.add(q[i : i + size])
        found = []
        for p, a in cands.items():
            if p not in gone:
                score, _, l, r = min((co.SCALE * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, f[2].decode(), -f[1], f[3], f[4], n, -f[0]) for i, f in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "the", "new", "York", "new-york", "été", "東京", "a", "b", "1.5", "x'y"] + [f"w{i}" for i in range(12)]
    rows = []
    for _ in range(120):
        parts = [rng.choice([*words, "new york city", "a a a", "w1 w2 w3 w4"]) for _ in range(rng.randrange(60))]
        rows.append(("".join(p + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", "!"]) for p in parts), rng.choice(["en", "fr", None, "und", ""])))
    return rows + [(None, "en"), ("", "en"), ("...", "xx"), ("solo", "yy"), ("long words " * 20_000, "fr")]


@pytest.mark.parametrize(("longest", "block"), [(3, 16 << 20), (3, 700), (2, 900), (4, 700), (5, 16 << 20)])
def test_phrases_match_counting_everything(spark, monkeypatch, longest, block):
    monkeypatch.setattr(co, "BLOCK_BYTES", block)
    monkeypatch.setattr(co.tv, "CHUNK", 300)
    rows = corpus(longest)
    df = spark.createDataFrame([(t, g, "clash", 1) for t, g in rows], "text string, lang string, word string, id int").repartition(3)
    got = sorted(map(tuple, co.mine_phrases(df, min_count=4, max_words=longest, top=60).collect()))
    assert got == brute(rows, 4, longest, 60, 50)


def test_query_sql_agrees_with_brute_force_and_the_operator(spark, tmp_path):
    rows = corpus(77)
    con = duckdb.connect()
    con.register("documents", pa.table({"text": [t for t, _ in rows], "lang": [g for _, g in rows]}))
    want = sorted(con.sql(co.COLLOCATION_SQL).fetchall())
    assert want == brute(rows, 10, 3, 2000, 50)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, co.mine_phrases(df).collect())) == want


def test_counts_beyond_64_bits_and_few_rows(spark):
    a, part = 3 * 10**12, 4 * 10**12
    rows = spark.createDataFrame([(1, a, "en", ["u", "v"], [part], [part + 1])], "id long, a long, lang string, words array<string>, pre array<long>, suf array<long>")
    assert co._scored(rows).collect()[0].score == 10**6 * a * a // (part * (part + 1))
    assert co.mine_phrases(spark.createDataFrame([], "text string, lang string")).count() == 0
    with pytest.raises(ValueError):
        co.mine_phrases(rows, max_words=1)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(co.tv, "span_hashes", lambda buf, starts, ends: (ends - starts).astype("uint64"))
    (sequence, lang, words, count), = co.block_words([(["aa bb aa", "cc bb"], ["en", "fr"])])
    seen = Counter(dict(zip(zip(lang.to_pylist(), words.to_pylist(), strict=True), count.tolist(), strict=True)))
    assert seen == Counter({("en", "aa"): 2, ("en", "bb"): 1, ("fr", "cc"): 1, ("fr", "bb"): 1})
    assert [words.to_pylist()[i & ~co.BREAK] for i in sequence] == ["aa", "bb", "aa", "cc", "bb"]
