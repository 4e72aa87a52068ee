import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lorekiln.llm import packing as pk
from lorekiln.llm import registry


def brute(sizes, capacity):
    """What best-fit decreasing, piece after piece, leaves in its bins; bins with the same room are alike."""
    left, bins = [], []
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(left, (s, -1))
        room, b = left.pop(at) if at < len(left) else (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(s)
        bisect.insort(left, (room - s, b))
    return sorted(map(sum, bins))


def laid(plan, counts):
    bins = {}
    for size, rank, first, each, offset in plan.tolist():
        later = [r for s, r, *_ in plan.tolist() if s == size and r > rank]
        for j in range((min(later) if later else counts[size]) - rank):
            bins.setdefault(first + j // each, []).append((offset + j % each * size, size))
    for pieces in bins.values():
        end = 0
        for at, size in sorted(pieces):
            assert at == end
            end += size
    assert Counter(s for p in bins.values() for _, s in p) == Counter({s: n for s, n in enumerate(counts.tolist()) if n})
    return sorted(sum(s for _, s in p) for p in bins.values())


@pytest.mark.parametrize("seed", range(30))
def test_plan_by_counts_gives_the_bins_of_placing_piece_after_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 64, 100, 333])
    sizes = [rng.choice([rng.randint(1, capacity), max(1, capacity // rng.randint(1, 9))]) for _ in range(rng.choice([0, 1, 50, 900]))]
    counts = np.bincount(sizes, minlength=capacity + 1)
    assert laid(pk.plan(counts, capacity), counts) == brute(sizes, capacity)


def test_the_plan_does_not_grow_with_the_rows():
    rng = np.random.default_rng(2)
    counts = np.concatenate(([0], rng.integers(0, 1000, 2048)))
    small, large = len(pk.plan(counts)), len(pk.plan(counts * 10**6))
    assert large < 4 * small < 500_000


def test_rows_of_any_kind_are_packed(spark, monkeypatch):
    monkeypatch.setattr(pk, "RUN", 8)
    rng = random.Random(4)
    sizes = [5] * 300 + [rng.randint(1, 50) for _ in range(400)]
    df = spark.createDataFrame([(None if i % 3 else 1, s, "x") for i, s in enumerate(sizes)], "row long, size int, rank string")
    got = pk.pack_best_fit(df, "size", 50).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.size))
    assert sorted(sum(s for _, s in b) for b in bins.values()) == brute(sizes, 50) and len(got) == len(sizes)
    assert all(o == sum(s for _, s in sorted(b)[:i]) for b in bins.values() for i, (o, _) in enumerate(sorted(b)))
    with pytest.raises(ValueError):
        pk.pack_best_fit(df.withColumn("offset", df["size"]), "size", 50)
    with pytest.raises(ValueError):
        pk.pack_best_fit(df, "size", 49)
    assert pk.pack_best_fit(df.limit(0), "size", 50).count() == 0


def test_query_matches_the_library_and_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = [" ".join(f"word{rng.randrange(99)}" for _ in range(rng.choice([0, 3, 40, 400, 3000]))) for _ in range(60)]
    texts += [None, "", "same text"] + ["same text"] * 40 + ["Long, very; " * 9000]
    rows = [(i if i % 7 else None, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    lib = Tokenizer.from_file(registry.tokenizer_path())
    want = []
    for doc_id, text, _ in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        for p, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            want.append((doc_id, p, start, len(part), zlib.crc32(part.tobytes())))
    got = registry.op12_best_fit_packing(spark, str(tmp_path)).collect()
    key = lambda x: (x[0] is None, *(v or 0 for v in x))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048
    assert sorted(sum(s for _, s in b) for b in bins.values()) == brute([w[3] for w in want], 2048)


def test_sequences_hold_the_ids_of_their_pieces(spark):
    df = spark.createDataFrame([(i, "some words " * (i * 37 % 400)) for i in range(30)] + [(None, None)], "doc_id long, text string")
    packed = pk.best_fit_packing(df, registry.tokenizer_path(), keep_ids=True)
    rows = {r.sequence_id: r for r in pk.sequences(packed).collect()}
    for p in packed.collect():
        part = rows[p.sequence_id].ids[p.offset : p.offset + p.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32
    assert all(len(r.ids) <= 2048 and r.offsets[0] == 0 for r in rows.values())
