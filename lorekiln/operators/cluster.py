"""Clusters of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.operators.components import components, cut
from lorekiln.operators.ordered import ranked


def cosine(a, b):
    """Cosine of two arrays; 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot / n)


def similar_pairs(vectors: DataFrame, key: str, vector: str, group: str, least: float) -> DataFrame:
    """(a, b, similarity) of pairs of a group, by blocked products: a block of BLOCK rows meets every block of its group once."""
    block_rows = 1024
    kind = dict(vectors.dtypes)[key]
    sizes = vectors.groupBy(group).agg(F.count("*").alias("size"))
    rows = vectors.select(group, F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).join(sizes, group)
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / block_rows).cast("int")).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(group, F.least("block", "other").alias("ba"), F.greatest("block", "other").alias("bb"), "block", "key", "v")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        keys, block = pdf["key"].to_numpy(), pdf["block"].to_numpy()
        sim = x @ x.T
        ok = (sim >= least) & (keys[:, None] < keys[None, :])
        if pdf["ba"].iloc[0] != pdf["bb"].iloc[0]:
            ok &= block[:, None] != block[None, :]
        i, j = np.nonzero(ok)
        return pd.DataFrame({"a": keys[i], "b": keys[j], "similarity": sim[i, j]})

    return rows.groupBy(group, "ba", "bb").applyInPandas(meet, f"a {kind}, b {kind}, similarity double")


def single_linkage(pairs: DataFrame) -> DataFrame:
    return components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def greedy_complete_linkage(keys: list, sim: np.ndarray, threshold: float) -> list[int]:
    """Clusters by pairs in row order: a pair joins its clusters if all pairs across them reach the threshold."""
    n = len(keys)
    cluster = list(range(n))
    members = {i: [i] for i in range(n)}
    for i in range(n):
        for j in np.flatnonzero(sim[i, i + 1 :] >= threshold) + i + 1:
            a, b = cluster[i], cluster[j]
            if a != b and (sim[np.ix_(members[a], members[b])] >= threshold).all():
                for m in members.pop(b):
                    members.setdefault(a, []).append(m)
                    cluster[m] = a
    return cluster


BLOCK = 2048  # rows of a component that one task places at once


def _placed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The clusters of a block's rows: each joins the first, by leader, with whose members it all links, else it leads its own.

    Rows are tagged: 0 a row of the block; 1 a link of two of them, `other` before `key`; 2 an earlier cluster, led by `other`, all of which `key` links with.
    """
    kind, key, other = (pdf[c].to_numpy() for c in ("kind", "key", "other"))
    rows = np.sort(key[kind == 0])
    n = len(rows)
    link = np.zeros((n, n), bool)
    at = lambda x: np.searchsorted(rows, x)
    link[at(key[kind == 1]), at(other[kind == 1])] = True
    old = np.sort(np.unique(other[kind == 2]))
    fits = np.zeros((n, len(old)), bool)
    fits[at(key[kind == 2]), np.searchsorted(old, other[kind == 2])] = True
    leaders, size, cluster = list(old), np.zeros(len(old) + n, np.int64), np.zeros(n, np.int64)
    for j in range(n):
        near = np.bincount(cluster[:j][link[j, :j]], minlength=len(size))
        ok = near[: len(leaders)] == size[: len(leaders)]
        ok[: len(old)] &= fits[j]
        found = int(ok.argmax()) if ok.any() else len(leaders)
        if found == len(leaders):
            leaders.append(rows[j])
        cluster[j] = found
        size[found] += 1
    return pd.DataFrame({"key": rows, "cluster": np.array(leaders, dtype=rows.dtype)[cluster] if n else rows})


def complete_linkage(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, cluster) for every row of pairs(a, b): greedy complete linkage, pairs taken in the order of their rows; cluster is its first row.

    As a cluster only grows when all its rows link with the new one, taking pairs in order is the same as giving each row, in
    order, to the first cluster all of which it links with. Rows of a component are placed a block at a time, all components at once: links to earlier
    rows are counted by cluster, and a count that equals the cluster's size lets the row in. A task holds one block and its links, the lineage is cut after
    each round, and there are as many rounds as blocks in the largest component.
    """
    kind = dict(pairs.dtypes)["a"]
    edges = cut(pairs.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).where("i < j").distinct())
    ends = edges.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    if ends.limit(block + 1).count() <= block:  # one block holds them all: no components are needed to part them
        nodes = ends.select(F.lit(None).cast(kind).alias("component"), "node", F.lit(0).cast("long").alias("block"))
    else:
        parts = components(edges.select(F.col("i").alias("src"), F.col("j").alias("dst")))
        nodes = cut(ranked(parts, ["component"], ["node"]).select("component", "node", F.floor(F.col("rank") / block).alias("block")))
    of = lambda side: nodes.select(F.col("node").alias(side), F.col("block").alias(f"b{side}"))
    edges = cut(edges.join(of("i"), "i").join(nodes.withColumnsRenamed({"node": "j", "block": "bj"}), "j"))
    last = nodes.agg(F.max("block")).first()[0]
    done = None
    for r in range(0 if last is None else last + 1):
        tag = lambda df, t, key, other: df.select("component", F.lit(t).alias("kind"), F.col(key).alias("key"), other.cast(kind).alias("other"))
        here = edges.where(F.col("bj") == r)
        rows = tag(nodes.where(F.col("block") == r), 0, "node", F.lit(None)).unionByName(tag(here.where(F.col("bi") == r), 1, "j", F.col("i")))
        if r:
            sizes = done.groupBy("cluster").agg(F.count("*").alias("size"))
            met = here.where(F.col("bi") < r).join(done.withColumnRenamed("key", "i"), "i").groupBy("component", "j", "cluster").agg(F.count("*").alias("links"))
            rows = rows.unionByName(tag(met.join(sizes, "cluster").where("links = size"), 2, "j", F.col("cluster")))
        new = rows.groupBy("component").applyInPandas(_placed, f"key {kind}, cluster {kind}")
        done = cut(new if done is None else done.unionByName(new))
    return done if done is not None else nodes.select(F.col("node").alias("key"), F.col("node").alias("cluster"))


def split_by_facets(rows: DataFrame, cluster: str, axes: list[str]) -> DataFrame:
    """Clusters split on each axis in turn; on the first, rows without a value join if the cluster has one value alone."""
    out, keys = rows, [cluster]
    for i, axis in enumerate(axes):
        value = F.col(axis)
        if i == 0:
            kinds = out.groupBy(*keys).agg(F.countDistinct(axis).alias("kinds"), F.max(axis).alias("one"))
            out = out.join(kinds, keys)
            value = F.when(value.isNull() & (F.col("kinds") == 1), F.col("one")).otherwise(value)
            out = out.withColumn("f0", F.coalesce(value.cast("string"), F.lit("?"))).drop("kinds", "one")
        else:
            out = out.withColumn(f"f{i}", F.coalesce(value.cast("string"), F.lit("?")))
        keys.append(f"f{i}")
    return out.withColumn("facet_group", F.concat_ws("|", *keys)).drop(*keys[1:])


TOGETHER = 1 << 18  # pairs that are tightened in one task without parting them by component
PAIRS = 1 << 21  # pairs of a component, or of a cluster that is linked anew, that one task holds


def _linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cluster, as its first row, of each of n rows under greedy complete linkage by links i < j: a row joins the first cluster with all of whose rows it links."""
    order = np.lexsort((i, j))
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.diff(j, prepend=-1))
    cluster, size = np.arange(n), np.ones(n, np.int64)
    for at, to in zip(starts, np.append(starts, len(j))[1:], strict=True):
        found, links = np.unique(cluster[i[at:to]], return_counts=True)
        found = found[links == size[found]]
        if len(found):
            cluster[j[at]] = found[0]
            size[found[0]] += 1
    return cluster


def _tightened_in(pdf: pd.DataFrame, least: float, max_size: int, step: float, last: float) -> pd.DataFrame:
    """`tightened` for whole components: a row with a = b is a node that stands for `similarity` rows, any other a link."""
    a, b, similarity = (pdf[c].to_numpy() for c in ("a", "b", "similarity"))
    node = a == b
    order = np.argsort(a[node], kind="stable")
    keys, weight = a[node][order], similarity[node][order]
    i, j, similarity = np.searchsorted(keys, a[~node]), np.searchsorted(keys, b[~node]), similarity[~node]
    part, live, out, threshold = np.zeros(len(keys), np.int64), np.ones(len(keys), bool), np.arange(len(keys)), least
    while True:
        near = (similarity >= threshold) & live[i] & (part[i] == part[j])
        part = _linked(len(keys), i[near], j[near])
        settled = live & ((np.bincount(part, weight, len(keys)) <= max_size)[part] | (threshold >= last))
        out[settled] = part[settled]
        live &= ~settled
        if not live.any():
            return pd.DataFrame({"key": keys, "cluster": keys[out]})
        threshold = round(threshold + step, 10)


def tightened(rows: DataFrame, pairs: DataFrame, key: str, least: float, max_size: int = 15, step: float = 0.05, last: float = 0.95) -> DataFrame:
    """(key, cluster): clusters of complete linkage at `least`; one of more than `max_size` rows is linked anew, within itself, at a threshold
    higher by `step`, until it is small or the threshold is `last` or more. pairs are those at `least`, with their similarity.

    No link leaves its component, so a task takes whole components through all thresholds, in memory that goes with their pairs. One of more than
    PAIRS is linked by `complete_linkage`, and those of its clusters that are still too large are what the next threshold's tasks take; there are
    (last - least) / step + 1 such rounds at most.
    """
    kind, threshold = dict(pairs.dtypes)["a"], least
    weights = rows.groupBy(F.col(key).alias("a")).agg(F.count("*").cast("double").alias("weight"))
    ordered = pairs.where(F.col("similarity") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    near = cut(ordered.where("a < b").groupBy("a", "b").agg(F.max("similarity").cast("double").alias("similarity")))
    if near.limit(TOGETHER + 1).count() <= TOGETHER:
        nodes = near.select(F.explode(F.array("a", "b")).alias("a")).distinct().withColumn("part", F.lit(0).cast("long"))
    else:
        nodes = components(near.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("a"), F.xxhash64("component").alias("part"))
    done = None
    while True:
        nodes = cut(nodes.join(weights, "a", "left").select("part", "a", F.coalesce("weight", F.lit(0.0)).alias("weight")))
        near = cut(near.join(nodes.select("a", "part"), "a").select("part", "a", "b", "similarity"))
        sizes = cut(near.groupBy("part").agg(F.count("*").alias("pairs")))
        total = sizes.where(F.col("pairs") <= PAIRS).agg(F.sum("pairs")).first()[0] or 0
        large = sizes.where(F.col("pairs") > PAIRS).select("part")
        tasks = F.pmod(F.xxhash64("part"), F.lit(min(total // TOGETHER + 1, 1 << 15))).alias("task")
        held = nodes.select("part", "a", F.col("a").alias("b"), F.col("weight").alias("similarity")).unionByName(near).join(large, "part", "left_anti")
        whole = lambda start: lambda pdf: _tightened_in(pdf, start, max_size, step, last)
        small = held.select(tasks, "a", "b", "similarity").groupBy("task").applyInPandas(whole(threshold), f"key {kind}, cluster {kind}")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            break
        wide = cut(near.join(large, "part"))
        found = complete_linkage(wide.where(F.col("similarity") >= threshold).select("a", "b")).toDF("a", "cluster")
        found = cut(nodes.join(large, "part").join(found, "a", "left").select("a", F.coalesce("cluster", "a").alias("cluster"), "weight"))
        sized = found.join(found.groupBy("cluster").agg(F.sum("weight").alias("size")), "cluster")
        settled = F.lit(True) if threshold >= last else F.col("size") <= max_size
        done = done.unionByName(sized.where(settled).select(F.col("a").alias("key"), "cluster"))
        rest = cut(sized.where(~settled).select("a", "cluster"))
        if rest.isEmpty():
            break
        ends = wide.join(rest, "a").join(rest.toDF("b", "other"), "b").where("cluster = other")
        nodes, near = rest.select("a", F.xxhash64("cluster").alias("part")), ends.select("a", "b", "similarity")
        threshold = round(threshold + step, 10)
    found = done.toDF(key, "cluster")
    return rows.select(key).join(found, key, "left").withColumn("cluster", F.coalesce("cluster", key))
