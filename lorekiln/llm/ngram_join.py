"""N-gram Jaccard join with Bayesian candidate pruning.

MinHash bands propose groups of documents; within a group the MinHash values of two documents are compared a
slice at a time, and the pair is dropped as soon as the posterior probability that its
similarity reaches the threshold is below a tolerance. What remains is verified exactly on the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.llm import textvec as tv
from lorekiln.operators.components import components as connected_components
from lorekiln.llm.store import cut

K_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5  # a pair at 0.8 shares no band with probability (1 - 0.8 ** 5) ** 32 = 3e-6
SLICE = 32  # MinHash values compared between two looks at the posterior
TOLERANCE = 1e-6
BLOCK = 256  # rows of one side of a block of pairs
SALTS = 64  # tasks that the members of a group of more than BLOCK rows are dealt over where they meet its size
_RNG = np.random.default_rng(20150601)
_XOR = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among n MinHash bytes that keep P(similarity >= threshold) at the tolerance or above.

    Similarity has a uniform prior; a byte matches with probability j + (1 - j) / 256.
    """
    j = np.linspace(0, 1, 20_001)
    p = np.clip(j + (1 - j) / 256, 1e-12, 1 - 1e-12)
    for m in range(n + 1):
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(log - log.max())
        if like[j >= threshold].sum() >= tolerance * like.sum():
            return m
    return n


def _signatures(texts: list, k: int) -> dict[str, pa.Array]:
    """Of each text: a key of its shingle set, its MinHash bytes and its band keys."""
    keys, sigs, bands = [], [], []
    for first, end, buf, offsets in tv.chunks(texts):
        n = end - first
        hashes, _, _, bounds = tv.words(buf, offsets)
        sh, at = tv.shingles(hashes, bounds, k)
        some = np.flatnonzero(np.diff(at) > 0)
        mins = np.zeros((BANDS * ROWS, n), np.uint64)
        if len(some):
            for f in range(BANDS * ROWS):
                mins[f, some] = np.minimum.reduceat((sh ^ _XOR[f]) * _MUL[f], at[some])
        sig = (tv.mix(mins) >> np.uint64(56)).astype(np.uint8).T.copy()  # mixed: of many shingles the minimum's own top byte is 0
        sigs += [row.tobytes() for row in sig]
        band = np.zeros((BANDS, n), np.uint64)
        for r in range(ROWS):
            band = band * tv._P + mins[r::ROWS]
        band = tv.mix(band + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * tv._P).view(np.int64).T
        key = np.zeros((n, 2), np.uint64)
        for d in range(n):
            if at[d + 1] > at[d]:
                u = np.unique(sh[at[d] : at[d + 1]])
                key[d] = tv.mix(u).sum(), tv.mix(u + tv._P).sum()
                bands.append(band[d])
            else:  # no words: only an equal text is alike
                raw = tv.span_hashes(buf, offsets[d : d + 1], offsets[d + 1 : d + 2])
                key[d] = raw[0], ~raw[0]
                bands.append(band[d][:0])
        keys.append(key)
    key = np.concatenate(keys).view(np.int64) if keys else np.zeros((0, 2), np.int64)
    return {
        "k1": pa.array(key[:, 0]),
        "k2": pa.array(key[:, 1]),
        "sig": pa.array(sigs, pa.binary()),
        "bands": pa.array(bands, pa.list_(pa.int64())),
    }


def _pairs(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups, a bounded number at a time."""
    small: list[tuple[int, int]] = []
    size = 0
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        small.append((a, b))
        size += (b - a) * (b - a - 1) // 2
        if size >= 200_000:
            yield _some_pairs(small)
            small, size = [], 0
    if size:
        yield _some_pairs(small)


def _some_pairs(groups: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.array(groups).T
    n = np.repeat(b, b - a) - np.concatenate([np.arange(x, y) for x, y in groups]) - 1  # partners after each row
    row = np.concatenate([np.arange(x, y) for x, y in groups])
    i = np.repeat(row, n)
    start = np.concatenate(([0], np.cumsum(n)))[:-1]
    return i, i + 1 + np.arange(len(i)) - np.repeat(start, n)


def _survivors(batches: Iterator[pd.DataFrame], least: dict[int, int]) -> Iterator[pd.DataFrame]:
    """Of each bucket, a spanning forest of the pairs that pruning leaves; two blocks that meet only add what joins their own trees."""
    keys = ["key", "a", "b"]
    for pdf in tv.whole_groups(batches, keys):
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
        mixed, block = (pdf["a"] != pdf["b"]).to_numpy(), pdf["block"].to_numpy()
        ii, jj = [], []
        for i, j in _pairs(tv.group_bounds(pdf, keys)):
            match = np.zeros(len(i), np.int32)
            for n in sorted(least):
                match += (sig[i, n - SLICE : n] == sig[j, n - SLICE : n]).sum(1, dtype=np.int32)
                alive = match >= least[n]
                i, j, match = i[alive], j[alive], match[alive]
            ii.append(i)
            jj.append(j)
        if ii:
            i, j = np.concatenate(ii), np.concatenate(jj)
            own = mixed[i] & (block[i] == block[j])
            tree, low = tv.roots(len(pdf), i[own], j[own]), tv.roots(len(pdf), i, j)
            every = np.arange(len(pdf))
            rep, move = pdf["rep"].to_numpy(), np.flatnonzero((tree == every) & (low != every))
            yield pd.DataFrame({"src": rep[low[move]], "dst": rep[move]}).drop_duplicates()


def _shingle_sets(texts: list, k: int) -> dict[str, pa.Array]:
    sets: list[bytes] = []
    for first, end, buf, offsets in tv.chunks(texts):
        hashes, _, _, bounds = tv.words(buf, offsets)
        sh, at = tv.shingles(hashes, bounds, k)
        sets += [np.unique(sh[at[d] : at[d + 1]]).tobytes() for d in range(end - first)]
    return {"sh": pa.array(sets, pa.binary())}


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The numbers of common shingles of all pairs of sets."""
    if len(sets) <= 6:
        out = np.zeros((len(sets), len(sets)))
        for i in range(len(sets)):
            out[i, i] = len(sets[i])
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)))
    width = 8192
    for c in range(0, int(col[-1]) + 1, width):
        lo, hi = np.searchsorted(col, (c, c + width))
        m = np.zeros((len(sets), width), np.float32)
        m[row[lo:hi], col[lo:hi] - c] = 1
        out += m @ m.T
    return out


def _verify(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Of each block of a candidate group: links counted in documents, and a spanning forest of them."""
    keys = ["component", "a", "b"]
    for pdf in tv.whole_groups(batches, keys):
        bounds = tv.group_bounds(pdf, keys)
        rep, copies, block = pdf["rep"].to_numpy(), pdf["n"].to_numpy(np.int64), pdf["block"].to_numpy()
        mixed = (pdf["a"] != pdf["b"]).to_numpy()
        links, low = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            sets = [np.frombuffer(s, np.uint64) for s in pdf["sh"].iloc[x:y]]
            n = np.array([len(s) for s in sets], float)
            both = _overlaps(sets)
            link = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
            np.fill_diagonal(link, False)
            if mixed[x]:
                link &= block[x:y, None] != block[None, x:y]
            links[x:y] = link.astype(np.int64) @ copies[x:y]
            low[x:y] = x + tv.roots(y - x, *np.nonzero(np.triu(link)))
        some = links > 0
        yield pd.DataFrame({"rep": rep[some], "root": rep[low][some], "links": links[some]})


def _sized(rows: DataFrame, group: str) -> DataFrame:
    """rows(group, rep) with the size of their group if that is more than BLOCK, else BLOCK.

    Large groups are one row in BLOCK at most; each stands SALTS times in the join, so that its members spread.
    """
    large = rows.groupBy(group).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    salt = F.pmod(F.xxhash64("rep", F.lit(group)), F.lit(SALTS))
    spread = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = rows.withColumn("salt", salt).join(spread, [group, "salt"], "left")
    return met.withColumn("size", F.coalesce("size", F.lit(BLOCK))).drop("salt")


def _dealt(rows: DataFrame, group: str, payload: list[str]) -> DataFrame:
    """Rows of a group cut in blocks of BLOCK, each row copied to every pair of blocks that has its own; together by pair."""
    sized = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    spread = sized.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    return (
        spread.select(group, F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "rep", *payload)
        .repartition(group, "a", "b")
        .sortWithinPartitions(group, "a", "b")
    )


def ngram_jaccard_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    k: int = K_WORDS,
    tolerance: float = TOLERANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, class_id, component_id, n_links, kept for every row of docs.

    class_id is the smallest doc_id with the same set of k-word shingles, n_links the number of other rows whose
    Jaccard similarity with this one is at least the threshold, component_id the smallest doc_id reachable over
    such links, kept whether that is this row's doc_id. Words are runs of ASCII letters and digits and of characters
    beyond ASCII, A-Z lower-cased; a text with fewer than k words has one shingle of all its words, texts of any length are whole. Texts
    without words are alike only if equal; null counts as the empty text. Rows are told apart by themselves, not by their doc_id: rows that share a
    doc_id and rows without one each give a row and are linked by their own texts; smallest ids are those of the rows that have one. Other
    columns are ignored; an empty table gives an empty result.

    Documents with one shingle set are joined once, by their representative. Band buckets and candidate groups are
    cut into blocks of bounded size, so a hot one spreads over tasks, and a block gives counts and a spanning
    forest instead of its pairs. The bands miss a pair at the threshold with probability 3e-6.
    """
    signed, found = _classes_and_components(docs, threshold, k, tolerance, id_col, text_col)
    return (
        signed.select("doc_id", "k1", "k2")
        .join(found.drop("pick", "lowest"), ["k1", "k2"])
        .select("doc_id", "class_id", "component_id", "n_links", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def _row_keys(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes that tell rows of other ids or texts apart."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(doc_id, text).alias("h1"), F.xxhash64(text, doc_id).alias("h2")]


def _classes_and_components(docs: DataFrame, threshold: float, k: int, tolerance: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, ... of every row; k1, k2, pick, class_id, component_id, lowest, n_links of every class).

    pick is the class's first row by id and hash, with ids before rows without one; lowest the first pick of its component.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("*", *_row_keys(F.col("doc_id"), F.col("text")))
    least = {n: least_matches(n, threshold, tolerance) for n in range(SLICE, BANDS * ROWS + 1, SLICE)}
    signed = cut(
        tv.over_texts(src, ["doc_id", "h1", "h2"], lambda texts: _signatures(texts, k), "k1 long, k2 long, sig binary, bands array<long>")
    )
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h1", "h2"))
    classes = cut(
        signed.groupBy("k1", "k2")
        .agg(pick.alias("pick"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    in_band = classes.select("rep", F.explode("bands").alias("key"))
    crowded = in_band.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    meeting = in_band.join(crowded, "key").join(classes.select("rep", "sig"), "rep")
    candidates = _dealt(meeting, "key", ["sig"]).mapInPandas(lambda b: _survivors(b, least), "src long, dst long")
    groups = cut(connected_components(candidates).withColumnRenamed("node", "rep"))
    members = _sized(groups, "component").join(classes.select("rep", "n", "pick.h1", "pick.h2"), "rep")
    texts = src.select("h1", "h2", "text").join(members, ["h1", "h2"]).dropDuplicates(["rep"]).select("component", "size", "rep", "n", "text")
    sets = tv.over_texts(texts, ["component", "size", "rep", "n"], lambda x: _shingle_sets(x, k), "sh binary")
    met = cut(
        _dealt(sets, "component", ["n", "sh"]).mapInPandas(lambda b: _verify(b, threshold), "rep long, root long, links long")
    )
    parts = connected_components(met.select(F.col("rep").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "rep")
    first = parts.join(classes.select("rep", "pick"), "rep").groupBy("component").agg(F.min("pick").alias("lowest"))
    links = met.groupBy("rep").agg(F.sum("links").alias("others"))
    lowest = parts.join(first, "component").select("rep", "lowest")
    found = (
        classes.select("k1", "k2", "rep", "n", "pick")
        .join(links, "rep", "left")
        .join(lowest, "rep", "left")
        .withColumn("lowest", F.coalesce("lowest", "pick"))
        .select(
            "k1",
            "k2",
            "pick",
            "lowest",
            F.col("pick.doc_id").alias("class_id"),
            F.col("lowest.doc_id").alias("component_id"),
            (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        )
    )
    return signed, found


def keep_one_of_each(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    k: int = K_WORDS,
    tolerance: float = TOLERANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """docs, with all their columns, without the rows that have a near-duplicate before them: one row of each group stays.

    That is the row with the group's smallest doc_id; of rows that share it, one text, and of rows that repeat, one. Rows of other texts
    stay though their ids repeat. Rows whose doc_id is null are never dropped. Null counts as the empty text; texts of any length
    are whole; an empty table gives an empty result.
    """
    _, found = _classes_and_components(docs, threshold, k, tolerance, id_col, text_col)
    keys = found.where(F.col("pick") == F.col("lowest")).select("lowest.h1", "lowest.h2").toDF("_h1", "_h2")
    h1, h2 = _row_keys(F.col(id_col), F.col(text_col))
    known = docs.where(F.col(id_col).isNotNull()).withColumns({"_h1": h1, "_h2": h2})
    known = known.join(keys, ["_h1", "_h2"], "left_semi").dropDuplicates(["_h1", "_h2"]).drop("_h1", "_h2")
    return known.unionByName(docs.where(F.col(id_col).isNull()))
