import itertools
import random
import re

from lorekiln.llm import filter_audit as fa

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def brute(docs, labels):
    fails = []
    for doc_id, lang, text in docs:
        t = text or ""
        words = [w for w in BLANK.split(t) if w]
        f = set()
        if len(words) < 100:
            f.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, _, x in docs):
            f.add("E")
        fails.append((lang or "", f, any(i == doc_id and q == 1 for i, q, _ in labels if i is not None), any(i == doc_id and x == 1 for i, _, x in labels if i is not None)))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in itertools.permutations("ABCDE"):
            gone = [False] * len(mine)
            for step, f in enumerate(order, 1):
                c = [0] * 6
                for i, (_, bad, good, toxic) in enumerate(mine):
                    if f in bad and not gone[i]:
                        gone[i] = True
                        c[1] += 1
                        c[4] += good
                        c[5] += toxic
                    elif f in bad:
                        c[2] += 1
                    c[0] += not gone[i]
                    c[3] += bad == {f}
                shapley[f] += c[1]
                rows["".join(order), step] = c
        for (order, step), c in rows.items():
            out[part, order, step] = (*c, shapley[order[step - 1]])
    return out


def held(spark, docs, labels):
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, lang string, text string, part string, mask int")
    lf = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, lang string")
    rows = fa.filter_audit(df, lf).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*fa.COUNTS, "shapley")) for r in rows}
    assert len(rows) == len(got)
    assert got == brute(docs, labels)


def test_every_order_and_step_matches_applying_the_filters(spark):
    rng = random.Random(1)
    docs = []
    for i in range(60):
        n = rng.choice([3, 99, 100, 140])
        words = [rng.choice(["WORD", "word", "other", f"w{rng.randrange(400)}", f"ü{rng.randrange(400)}"]) for _ in range(n)]
        text = rng.choice(["", "\t", "\n "]) + rng.choice([" ", "\x0b", "  "]).join(words) + rng.choice(["", " #", "|", "\r"])
        docs.append((i, rng.choice(["en", "fr", None, ""]), text))
    docs += [(100 + i, "en", docs[0][2]) for i in range(20)] + [(7, "fr", docs[0][2]), (None, "en", docs[0][2]), (None, None, docs[0][2])]
    docs += [(200, "en", None), (201, "en", ""), (201, "en", ""), (202, "xx", "x " * 30_000), (203, "en", "É" * 120 + " A")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    held(spark, docs, labels)


def test_texts_of_one_id_and_no_rows(spark):
    held(spark, [(1, "en", "same"), (1, "en", "same"), (1, "fr", "same"), (2, "en", "same"), (2, "en", "other")], [])
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert fa.filter_audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
