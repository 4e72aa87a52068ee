"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one kept per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.operators.components import components as connected_components
from lorekiln.llm import textvec as tv
from lorekiln.llm.store import cut

MAX_CELLS = 4096  # bound of the broadcast centroids: MAX_CELLS x dimensions x 8 bytes
FIT_ROWS = 8192  # bound of the sample that fits the centroids
BLOCK = 1024  # rows of one side of a cosine product
ONE_CELL = 32  # a label with fewer vectors has one cell
FITTED = 16  # vector lengths that get centroids: those with the most vectors; others have one cell a label


def unit_rows(vectors) -> np.ndarray:
    """Rows of length 1 in double precision; each is first scaled by a power of two, which is exact, so that squares neither overflow nor vanish."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k unit centroids of the unit rows x, by Lloyd's rounds on cosine."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 1e-9] = total[norm > 1e-9] / norm[norm > 1e-9, None]
    return c


def _spread(a: np.ndarray, n: int) -> np.ndarray:
    """Components of n rows under the link matrix a (both sides the same rows): each row's smallest reachable index."""
    low = np.arange(n)
    while True:
        new = np.minimum(low, np.where(a, low[None, :], n).min(1))
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new


def embedding_dedup(
    vectors: DataFrame,
    threshold: float = 0.98,
    cells: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept, n_copies for every row of vectors.

    Vectors link if their labels are equal and not null and their cosine in double precision is at
    least the threshold. Equal vectors of a label are first counted as one. Centroids are fitted on
    at most FIT_ROWS vectors (those with the smallest hash), a quarter of the square root of the largest label's vectors of them unless
    `cells` says how many; every vector is indexed. A vector lives in its nearest
    cell and is a guest in each cell whose boundary plane is nearer than half the longest chord of a link:
    of a linked pair in two cells one at least is that near, so no link is missed. A cell of a label is
    cut in blocks of BLOCK rows that meet pairwise, so a hot cell spreads over tasks; a block pair gives link counts and
    a spanning forest, never its pairs.

    Null, zero, or non-finite vectors, those that hold nulls and those with a null label link with nothing and are kept; vectors
    of any finite size compare by direction. Vectors of
    another length than the most common one compare only among themselves by length. Rows are linked by their vectors, not by their ids: rows that
    share a vec_id or have none are vectors of their own, and component_id is the smallest vec_id that any vector of the component has. Other columns are ignored; an empty table gives an empty result.
    """
    tv.bound_batches(vectors.sparkSession)
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    sound = F.col("v").isNotNull() & F.col("label").isNotNull() & F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    usable = src.where(sound)
    classes = cut(
        usable.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n_copies")).withColumns({"d": F.size("v"), "rep": F.monotonically_increasing_id()})
    )
    of_label = classes.groupBy("d", "label").agg(F.count("*").alias("n"))
    lengths = of_label.groupBy("d").agg(F.sum("n").alias("n"), F.max("n").alias("most")).orderBy(F.desc("n"), "d").limit(FITTED).collect()
    fitted: dict[int, np.ndarray] = {}
    for r in lengths:
        k = min(MAX_CELLS, cells or int(np.ceil(np.sqrt(r.most) / 4)))
        if r.most < ONE_CELL or k < 2:
            continue
        rows = classes.where(F.col("d") == r.d).orderBy(F.xxhash64("v"), "rep").limit(FIT_ROWS).select("v").collect()
        x = unit_rows([row.v for row in rows])
        fitted[r.d] = spherical_kmeans(x, min(k, len(x)))
    half_chord = float(np.sqrt(max(0.0, 2 - 2 * threshold)) / 2) + 1e-9
    shared = src.sparkSession.sparkContext.broadcast(fitted)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            homes, guests = np.zeros(len(pdf), np.int32), [[] for _ in range(len(pdf))]
            for d, at in pdf.groupby("d").indices.items():
                c = shared.value.get(d)
                at = at[pdf["of_label"].to_numpy()[at] >= ONE_CELL]
                if c is None or not len(at):
                    continue
                x = unit_rows(pdf["v"].to_numpy()[at])
                dots = x @ c.T
                home = dots.argmax(1)
                homes[at] = home
                gap = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
                near = dots[np.arange(len(at)), home][:, None] - dots <= half_chord * gap[home]
                near[np.arange(len(at)), home] = False
                for i, j in zip(*np.nonzero(near), strict=True):
                    guests[at[i]].append(int(j))
            yield pd.DataFrame({"label": pdf["label"], "d": pdf["d"], "rep": pdf["rep"], "n_copies": pdf["n_copies"], "v": pdf["v"], "home": homes, "guests": guests})

    kind = dict(src.dtypes)
    several = of_label.where(F.col("n") >= ONE_CELL).select("d", "label", F.col("n").alias("of_label"))
    placed = classes.join(several, ["d", "label"], "left").select("label", "d", "rep", "n_copies", "v", F.coalesce("of_label", F.lit(0)).alias("of_label")).mapInPandas(
        place, f"label {kind['label']}, d int, rep long, n_copies long, v {kind['v']}, home int, guests array<int>"
    )
    members = cut(placed.withColumn("cell", F.explode(F.concat(F.array("home"), "guests"))))
    counts = members.groupBy("label", "d", "cell").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    dealt = (
        members.join(counts.withColumn("blocks", blocks).drop("n"), ["label", "d", "cell"])
        .withColumn("block", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", "d", "cell", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "rep", "n_copies", "v", "home", "guests")
    )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, cell = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0]), int(pdf["cell"].iloc[0])
        x = unit_rows(pdf["v"])
        n, block, home = len(pdf), pdf["block"].to_numpy(), pdf["home"].to_numpy()
        link = x @ x.T >= threshold
        np.fill_diagonal(link, False)
        if a != b:  # pairs within a block meet where both are that block
            link &= block[:, None] != block[None, :]
        if not link.any():
            return pd.DataFrame({"rep": pdf["rep"][:0], "root": pdf["rep"][:0], "links": np.zeros(0, np.int64)})
        # a pair meets in each cell that holds both: it counts in the least of these
        has = [set(g) | {h} for g, h in zip(pdf["guests"], home, strict=True)]
        at = np.nonzero(link.any(1))[0]
        lower = sorted({c for i in at for c in has[i] if c < cell})
        if lower:
            held = np.array([[c in has[i] for c in lower] for i in at], dtype=np.float32)
            link[np.ix_(at, at)] &= held @ held.T < 0.5
        weight = pdf["n_copies"].to_numpy(np.int64)
        low = _spread(link, n)
        rep = pdf["rep"].to_numpy()
        keep = link.any(1)
        return pd.DataFrame({"rep": rep[keep], "root": rep[low][keep], "links": (link.astype(np.int64) @ weight)[keep]})

    met = cut(dealt.groupBy("label", "d", "cell", "a", "b").applyInPandas(meet, "rep long, root long, links long"))
    links = met.groupBy("rep").agg(F.sum("links").alias("others"))
    parts = connected_components(met.select(F.col("rep").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "rep")
    lowest = parts.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("lowest"))
    grouped = (
        classes.join(links, "rep", "left")
        .join(parts, "rep", "left")
        .join(lowest, "component", "left")
        .select(
            "label", "v", (F.coalesce("others", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"),
            F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("lowest")).alias("component_id"), "n_copies",
        )
    )
    fine = usable.join(grouped, ["label", "v"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_copies")
    alone = src.where(~F.coalesce(sound, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("n_copies")
    )
    return fine.unionByName(alone)


#: embedding_dedup over the view embeddings, as DuckDB SQL.
DEDUP_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m AS (SELECT vec_id, label, v, list_max(list_transform(v, lambda x: abs(x))) AS most FROM v),
s AS (SELECT vec_id, label, list_transform(v, lambda x: x / pow(2.0, floor(log2(most)))) AS v FROM m WHERE most > 0),
n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM s),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
k AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON x = vec_id LEFT JOIN k ON a = vec_id"""
