from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lorekiln.llm import mixing


@pytest.mark.parametrize("quota", [[1, 1], [3, 5, 2], [97, 1, 1, 1], [500, 250, 125, 125], [7] * 9])
def test_deviation_stays_below_a_block(quota):
    q = np.array(quota)
    owner = mixing.owners(q + 1, q.astype(float))[: q.sum()]  # no source ends within it
    for i, n in enumerate(q):
        lag = np.arange(1, len(owner) + 1) * n / q.sum() - np.cumsum(owner == i)
        assert (abs(lag) < 1).all()


def test_schedule_has_every_slot_once():
    rows = mixing.schedule(np.array([10, 3, 0, 40]), np.array([1.0, 1.0, 1.0, 0.0]), 20)
    seen = [base + s for _, _, _, base, _, _, slots in rows for s in slots]
    assert sorted(seen) == list(range(53))
    assert min(base for s, _, _, base, *_ in rows if s == 3) == 13  # weight 0 comes last


def order(rows):
    return sorted(rows, key=lambda r: r.position)


def test_prefixes_follow_the_weights(spark):
    data = [(i, "hot" if i % 3 == 0 else f"s{i % 5}", "t") for i in range(3000)] + [(None, None, None), (7, "hot", "again"), (7, "hot", "again")]
    docs = spark.createDataFrame(data, "doc_id long, source string, sid string")
    rows = order(mixing.mix_sources(docs, block_docs=8).collect())
    assert len(rows) == len(data) == len({r.position for r in rows})
    assert Counter(r.row.sid for r in rows)["again"] == 2
    n = Counter(r.source for r in rows)
    blocks, slots = {s: -(-c // 8) for s, c in n.items()}, {}
    for r in rows:
        slots.setdefault(r.slot, r.source)
        assert slots[r.slot] == r.source
    assert sorted(slots) == list(range(sum(blocks.values())))
    weight = {s: c**0.5 for s, c in n.items()}
    done, live = Counter(), dict(weight)
    since, start = 0, Counter()
    for t in range(len(slots)):
        done[slots[t]] += 1
        for s in live:
            ideal = (t + 1 - since) * weight[s] / sum(weight[x] for x in live)
            assert abs(ideal - (done[s] - start[s])) < 1 + 1e-9
        if done[slots[t]] == blocks[slots[t]]:
            live.pop(slots[t])
            since, start = t + 1, done.copy()


def test_given_weights_order_and_empty(spark):
    docs = spark.createDataFrame([(i, "a" if i < 60 else "b" if i < 80 else "c", i) for i in range(100)], "doc_id long, source string, position long")
    rows = order(mixing.mix_sources(docs, weights={"a": 3, "b": 1}, block_docs=1).collect())
    assert Counter(r.source for r in rows[:40]) == {"a": 30, "b": 10} and {r.source for r in rows[80:]} == {"c"}
    mixed = mixing.in_mixed_order(docs, weights={"a": 3, "b": 1}, block_docs=1)
    assert mixed.columns == docs.columns and [r.doc_id for r in mixed.collect()] == [r.doc_id for r in rows]
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def plain_edf(sizes, weights, block):
    """The source of each slot: of the released blocks the one due first, all anew when a source ends; weight 0 comes last by size."""
    left, out = {s: -(-n // block) for s, n in sizes.items()}, []
    for pick in (lambda s: weights[s] > 0, lambda s: not weights[s] > 0):
        share = {s: Fraction(weights[s]) if weights[s] > 0 else Fraction(left[s]) for s in left if pick(s)}
        while any(left[s] for s in share):
            live = [s for s in share if left[s]]
            total, had, t = sum(share[s] for s in live), dict.fromkeys(live, 0), 0
            while all(left[s] for s in live):
                due = [(-(-(had[s] + 1) * total // share[s]), s) for s in live if had[s] * total // share[s] <= t]
                s = min(due)[1]
                out.append(s)
                had[s] += 1
                left[s] -= 1
                t += 1
    return out


@pytest.mark.parametrize("planned", [1 << 20, 30])
def test_the_whole_table_follows_a_plain_edf(spark, monkeypatch, planned):
    monkeypatch.setattr(mixing, "PLANNED", planned)
    monkeypatch.setattr(mixing, "PERIOD", 16)
    monkeypatch.setattr(mixing, "RUN", 10)
    rows = [(i if i % 5 else None, f"s{min(i % 20, 9)}", f"t{i}") for i in range(700)] + [(3, "s1", "again")] * 9 + [(None, None, None)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = order(mixing.mix_sources(docs, block_docs=4).collect())
    assert Counter((r.doc_id, r.source, r.row.text) for r in got) == Counter(rows) and len({r.position for r in got}) == len(rows)
    assert max(Counter(r.slot for r in got).values()) == 4  # blocks keep their size however few slots are planned at once
    sizes = Counter(s for _, s, _ in rows)
    by_slot = {r.slot: r.source for r in got}
    names = sorted(sizes, key=lambda s: (-sizes[s], s is not None, s or ""))  # the order in which ties are broken
    want = plain_edf({i: sizes[s] for i, s in enumerate(names)}, {i: sizes[s] ** 0.5 for i, s in enumerate(names)}, 4)
    assert [by_slot[t] for t in range(len(by_slot))] == [names[i] for i in want]


def test_every_source_keeps_its_exact_weight(spark):
    # 1,200 sources, each with a given weight: more than were told apart; the named small ones come first
    docs = spark.createDataFrame([(i, f"s{i % 1200}") for i in range(2400)] + [(-i, f"s{i}") for i in range(1100)], "doc_id long, source string")
    rows = order(mixing.mix_sources(docs, weights={"s1150": 1, "s1199": 1}, block_docs=1).collect())
    assert len(rows) == 3500 == len({r.position for r in rows})
    assert Counter(r.source for r in rows[:4]) == {"s1150": 2, "s1199": 2}


def test_long_schedules_do_not_drift():
    # shares of 1.5 of 2,000 slots: rounded to whole parts of a period they drift with every period
    weights = np.array([1.5] * 6 + [1991.0])
    owner = mixing.owners(np.array([150] * 6 + [199_100]), weights)
    for i, w in enumerate(weights):
        lag = np.arange(1, len(owner) + 1) * w / weights.sum() - np.cumsum(owner == i)
        assert (abs(lag[:190_000]) < 1).all()


def test_irrational_weights_over_a_million_slots():
    weights = np.array([2**0.5, np.pi, np.e, 5**0.5, 0.1])
    n = 1_000_000
    owner = mixing.owners(np.ceil(weights / weights.sum() * n).astype(np.int64) + 2, weights)[:n]
    for i, w in enumerate(weights):
        lag = np.arange(1, n + 1) * (w / weights.sum()) - np.cumsum(owner == i)
        assert abs(lag).max() < 1
