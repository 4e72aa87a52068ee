import itertools

import numpy as np

from lorekiln.llm import chat_format as chat

SCHEMA = "conv_id long, turn long, role string, text string, seg int, part string"


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(4)
    model = chat.Model({("move", 0, 1): 3.0, ("2", 1, 0): 5.0})
    sizes = [3, 6, 1, 4, 6]
    emit, bounds, want = rng.normal(size=(sum(sizes), 3)), np.concatenate(([0], np.cumsum(sizes))), []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        want += max(
            itertools.product(range(3), repeat=b - a),
            key=lambda s: model.first[s[0]] + sum(emit[a + t, s[t]] for t in range(len(s))) + sum(model.move[x, y] for x, y in zip(s, s[1:], strict=False)),
        )
    free = np.full(len(sizes), -1)
    assert chat.viterbi(model, emit, bounds, free, free).tolist() == want


def test_parts():
    heads = lambda text: [(p[0], p[2]) for p in chat.parts_of(text)]
    assert heads("User: hi") == [(1, "hi")] and heads("### Assistant: yo") == [(2, "yo")]
    assert heads("<|im_start|>system\nbe kind") == [(0, "be kind")] and heads("**Human:** x") == [(1, "x")]
    assert heads("Note: not a role") == [(chat.UNKNOWN, "Note: not a role")]
    assert heads("User: a\nb\nAI: c<|im_end|>") == [(1, "a\nb"), (2, "c")]
    assert heads("\n User: a\n[/INST] b") == [(1, "a"), (2, "b")]
    assert heads("It runs.\nContext: the pump is old.") == [(chat.UNKNOWN, "It runs.\nContext: the pump is old.")]
    assert heads("so\n<|user|> x\nA: y") == [(chat.UNKNOWN, "so"), (1, "x\nA: y")]
    assert heads(None) == heads("") == [(chat.UNKNOWN, "")]
    long = "word " * 200_000
    assert heads(long) == [(chat.UNKNOWN, long.strip())]


def test_named_roles_and_texts_stay(spark):
    rows = [(i, j, ["user", "assistant"][j % 2], f"text {j}") for i in range(40) for j in range(6)]  # most take turns
    rows += [(900, 0, "user", "a"), (900, 1, "user", "b"), (901, 0, "user", "a"), (901, 1, "assistant", "b"), (901, 2, "assistant", "c")]
    rows += [(902, 1, "user", "hi"), (902, 2, "assistant", "It runs.\nContext: the pump is old."), (903, 0, "assistant", "User: said so"), (904, 0, "user", "x <|end|> y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.rendered) for r in chat.format_chats(df).collect()}
    assert len(got) == len(rows) and all(got[i, j][0] == role for i, j, role, _ in rows)
    assert "Context: the pump is old." in got[902, 2][1] and "User: said so" in got[903, 0][1]
    assert got[904, 0][1] == "<|user|>\nx <\\|end|> y\n<|end|>\n"


def test_roles_are_recovered_also_across_segments(spark, monkeypatch):
    rows = [(1, 0, None, "User: hi?\nAssistant: hello\nthere\nUser: bye"), (2, 0, "human", "x?"), (2, 1, None, "y"), (None, None, None, None), (3, 0, "gpt", ""), (3, 1, "odd name", "z")]
    rows += [(9, i, ["user", "assistant"][i % 2] if i % 3 else None, f"turn {i}") for i in range(60)]
    rows += [(4, 0, "user", "same")] * 3
    df = spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA)
    whole = chat.format_chats(df).collect()
    assert len(whole) == len(rows) + 2
    assert [(r.part, r.role) for r in sorted((r for r in whole if r.conv_id == 1), key=lambda r: r.part)] == [(0, "user"), (1, "assistant"), (2, "user")]
    assert [r.rendered for r in whole if r.conv_id == 1 and r.part == 1] == ["<|assistant|>\nhello\nthere\n<|end|>\n"]
    assert all(r.role == ["user", "assistant"][r.turn % 2] for r in whole if r.conv_id == 9)
    assert {r.role for r in whole if r.conv_id == 2 and r.turn == 1} == {"assistant"}
    monkeypatch.setattr(chat, "SEGMENT", 7)
    cut = chat.format_chats(df).collect()
    assert sorted(map(str, cut)) == sorted(map(str, whole))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_named_roles_of_the_tables(spark):
    from lorekiln.llm import registry

    out = registry.op2_chat_formatting(spark, "/root/testdata/sf0.001").collect()
    assert all(r.role == r.named_role for r in out)
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        turns = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
        hidden = turns.selectExpr("conv_id", "turn", "if(conv_id % 4 = 0, null, role) AS role", "text")
        truth = turns.where("conv_id % 4 = 0").selectExpr("conv_id", "turn", "role AS truth")
        right, n = chat.format_chats(hidden).where("part = 0").join(truth, ["conv_id", "turn"]).selectExpr("sum(int(role = truth))", "count(*)").first()
        assert right > 0.9 * n, (sf, right, n)


def plain_query(rows):
    """Counts, then the likeliest roles of each whole conversation by a plain recursion over all its parts."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, text, role))
    lists = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", t[2] is not None, t[2] or ""))
        for i, (turn, text, role) in enumerate(turns):
            named = chat.role_of(role)
            for j, (marked, tag, body, _) in enumerate(chat.parts_of(text)):
                opens = i == 0 and j == 0 and (turn is None or turn < chat.SEGMENT)
                feats = (marked, 0 if opens else 1 if j == 0 else 2, min(5, len(body).bit_length() // 2), int("?" in body[-3:]))
                told = named if j == 0 else chat.UNKNOWN if named == chat.UNKNOWN else marked
                seen = named if j == 0 and named != chat.UNKNOWN else marked if tag else chat.UNKNOWN
                lists.setdefault(conv, []).append((turn, j, feats, told, seen, role))
    counts = {}
    for parts in lists.values():
        for before, (_, j, feats, told, _, _) in zip([None, *parts], parts, strict=False):
            if told == chat.UNKNOWN:
                continue
            found = [(str(k), told, feats[k]) for k in range(1, 4)]
            found += [("0", told, feats[0])] if j == 0 else []
            found += [("first", told, 0)] if feats[1] == 0 else []
            found += [("move", before[3], told)] if before and before[3] != chat.UNKNOWN else []
            for key in found:
                counts[key] = counts.get(key, 0) + 1
    model, out = chat.Model(counts), []
    for conv, parts in lists.items():
        score = lambda p, s: sum(model.emit[k][s, p[2][k]] for k in range(4)) + (0 if p[4] in (s, chat.UNKNOWN) else chat.SURE)
        paths = {s: (model.first[s] + score(parts[0], s), [s]) for s in range(3)}
        for p in parts[1:]:
            paths = {s: max((v + model.move[r, s] + score(p, s), [*path, s]) for r, (v, path) in paths.items()) for s in range(3)}
        for s, p in zip(max(paths.values())[1], parts, strict=True):
            out.append((str(conv), str(p[0]), p[1], chat.ROLES[s], str(p[5])))
    return sorted(out)


def test_the_whole_query_matches_a_plain_recursion(spark, tmp_path):
    import random

    from lorekiln.llm import registry

    rng, rows = random.Random(12), []
    for c in range(120):
        for t in range(rng.randrange(1, 9)):
            role = ["user", "assistant"][t % 2] if rng.random() < 0.5 else rng.choice([None, "odd", "Human"])
            text = rng.choice(["", None, "why?", "so it is " * rng.randrange(1, 60), "User: hi\nAssistant: yes", "<|assistant|>\nok", "Note: it"])
            rows.append((c, t, role, text))
    rows += [(500, t, None if t % 3 else ["user", "assistant"][t % 2], f"turn {t}") for t in range(200)] + [(None, None, None, "alone")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.op2_chat_formatting(spark, str(tmp_path)).collect()
    assert sorted((str(r.conv_id), str(r.turn), r.part, r.role, str(r.named_role)) for r in got) == plain_query(rows)
