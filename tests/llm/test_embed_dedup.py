import numpy as np
import pytest

from lorekiln.llm import embed_dedup as ed


def brute(rows):
    n = len(rows)
    ok = [v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0 for _, v, lab in rows]
    links, low = {r[0]: 0 for r in rows}, list(range(n))
    pairs = []
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    pairs.append((i, j))
                    links[rows[i][0]] += 1
                    links[rows[j][0]] += 1
    for _ in range(n):
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    return {rows[i][0]: (links[rows[i][0]], rows[low[i]][0]) for i in range(n)}


@pytest.mark.parametrize(("cells", "block"), [(None, 1024), (1, 1024), (12, 5)])
def test_matches_brute_force(spark, monkeypatch, cells, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(140):
        base = rng.normal(size=6) if i % 3 == 0 or not rows else np.array(rows[rng.integers(len(rows))][1])
        rows.append((i, (base + rng.normal(size=6) * 0.06).tolist(), int(i % 2)))
    rows += [(200 + i, rows[0][1], 0) for i in range(10)]
    rows += [(300, None, 0), (301, [0.0] * 6, 0), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (303, [float("nan")] * 6, 0), (304, [1.0] * 6, None), (305, [2.0, 1.0], 0), (306, [4.0, 2.0], 0), (307, [float("inf")] * 6, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.embedding_dedup(df, cells=cells).collect()}
    assert got == brute(as_float)


def test_centroids_are_fitted_on_the_test_table(spark, monkeypatch):
    from lorekiln.llm import registry

    fitted = []
    plain = ed.spherical_kmeans
    monkeypatch.setattr(ed, "spherical_kmeans", lambda x, k: fitted.append(k) or plain(x, k))
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in registry.op9_embedding_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert fitted and min(fitted) > 1
    assert got == brute([(r.vec_id, r.embedding, r.label) for r in table])


def test_vectors_of_any_size(spark):
    rows = [(1, [2e200, 0.0], 0), (2, [1.0, 0.0], 0), (3, [5e-324, 0.0], 0), (4, [0.0, 1e-200], 0), (5, [0.0, 0.0], 0), (6, [1e308, 1e308], 1), (7, [1e-308, 1e-308], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 6)}


def test_vectors_of_one_id_or_none_are_linked_by_themselves(spark, monkeypatch):
    rows = [(2, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.001, 1.0], 0), (None, [1.0, 0.001], 0), (None, [-1.0, 0.0], 0), (9, [-1.0, 0.001], 0), (None, [-1.0, -1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in ed.embedding_dedup(df).collect())
    want = [("2", 1, "2", True), ("2", 1, "2", True), ("3", 1, "2", False), ("None", 1, "2", False), ("None", 1, "9", False), ("9", 1, "9", True), ("None", 0, "None", True)]
    assert got == sorted(want)


@pytest.mark.parametrize("fitted", [0, 1, 16])
def test_lengths_with_and_without_centroids_match_brute_force(spark, monkeypatch, fitted):
    monkeypatch.setattr(ed, "FITTED", fitted)
    rng = np.random.default_rng(9)
    rows = []
    for i in range(240):
        size = 2 + i % 3
        base = rng.normal(size=size)
        rows.append((i, base.tolist(), 0))
        rows.append((1000 + i, (base + rng.normal(size=size) * 0.1).tolist(), 0))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in ed.embedding_dedup(df).collect()} == brute(rows)


def test_empty(spark):
    assert ed.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
