"""Toxicity by a linear-chain conditional random field.

Two states, clean and toxic, run along a document's words. Emissions are sums of weights of a word, its first
letters and its neighbours; forward-backward marginals say how toxic each word is, and the document's score is a
logistic function of the largest marginal and of their sum.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.llm import textvec as tv

FIT_DOCS = 4000  # labelled rows that fit the model at most: those with the smallest hashes of their ids
FIT_CHARS = 32_000  # rows with longer texts are not used to fit; so the sample is bounded
SEGMENT = 128  # words of a training sequence
BITS = 20
BUCKETS = 1 << BITS
PREFIXES = (4, 5, 6)
SCORE_CHUNK = 2 << 20
FEATURES = 3 + len(PREFIXES)


@dataclass
class Crf:
    weight: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, BUCKETS), np.float32))
    bias: float = -4.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # transition weights, from and to
    calibration: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))
    default: float | None = None  # score of every document if nothing could be learned


def features(buf: np.ndarray, offsets: np.ndarray):
    """(buckets by feature and word, starts, ends, bounds) of the chunk's words."""
    starts, ends = tv.runs(tv.IS_WORD[buf])
    bounds = np.searchsorted(starts, offsets)
    sums = tv.running(buf)
    shift = np.uint64(64 - BITS)
    word = (tv.hash_of(sums, starts, ends) >> shift).astype(np.int32)
    rows = [word]
    rows += [(tv.hash_of(sums, starts, np.minimum(starts + n, ends)) >> shift).astype(np.int32) for n in PREFIXES]
    before, after = np.roll(word, 1), np.roll(word, -1)
    before[bounds[:-1][np.diff(bounds) > 0]] = 0
    after[bounds[1:][np.diff(bounds) > 0] - 1] = 0
    return np.stack([*rows, before, after]), starts, ends, bounds


def emissions(crf: Crf, feats: np.ndarray) -> np.ndarray:
    out = np.full(feats.shape[1], crf.bias, np.float32)
    for f in range(FEATURES):
        out += crf.weight[f][feats[f]]
    return out.astype(np.float64)


def chain(crf: Crf, e: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of the toxic state at each word; all sequences step together, longest first."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    first, size = bounds[:-1][order], size[order]
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")  # sequences of t + 1 words at least
    m = crf.move
    ahead, back = np.zeros_like(e), np.zeros_like(e)
    r = np.zeros(0)
    for t, n in enumerate(alive):
        at = first[:n] + t
        r = e[at] if t == 0 else e[at] + np.logaddexp(m[0, 1], m[1, 1] + r[:n]) - np.logaddexp(m[0, 0], m[1, 0] + r[:n])
        ahead[at] = r
    r = np.zeros(0)
    for t in range(len(alive) - 1, 0, -1):
        n = alive[t]
        at = first[:n] + t
        b = back[at] + e[at]
        back[at - 1] = np.logaddexp(m[1, 0], m[1, 1] + b) - np.logaddexp(m[0, 0], m[0, 1] + b)
    return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def marginals(crf: Crf, feats: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    ahead, back = chain(crf, emissions(crf, feats), bounds)
    return _sigmoid(ahead + back)


def _train(crf: Crf, feats: np.ndarray, y: np.ndarray, bounds: np.ndarray, rounds: int = 40) -> None:
    """Maximum likelihood with a Gaussian prior, by Adam on the whole sample."""
    n = len(y)
    used = [np.unique(f, return_inverse=True) for f in feats]
    w = np.zeros(sum(len(u) for u, _ in used))
    at = np.cumsum([0] + [len(u) for u, _ in used])
    x = np.concatenate([w, [crf.bias], np.zeros(4)])
    mean, square = np.zeros_like(x), np.zeros_like(x)
    inner = np.ones(n, bool)
    inner[bounds[:-1]] = False
    prev = np.flatnonzero(inner) - 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[prev], y[prev + 1]), 1)
    for step in range(1, rounds + 1):
        crf.bias, crf.move = x[-5], x[-4:].reshape(2, 2)
        e = np.full(n, crf.bias)
        for f in range(FEATURES):
            e += x[at[f] : at[f + 1]][used[f][1]]
        ahead, back = chain(crf, e, bounds)
        off = y - _sigmoid(ahead + back)
        g = np.concatenate([np.bincount(inv, off, len(u)) for u, inv in used] + [[off.sum()]])
        a, b = ahead[prev], (e + back)[prev + 1]
        joint = np.stack([np.full(len(a), crf.move[0, 0]), b + crf.move[0, 1], a + crf.move[1, 0], a + b + crf.move[1, 1]])
        joint = np.exp(joint - joint.max(0))
        expect = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        g = np.concatenate([g, (seen - expect).ravel()]) - 0.02 * x
        mean, square = 0.9 * mean + 0.1 * g, 0.97 * square + 0.03 * g * g
        x = x + 0.25 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.97**step)) + 1e-6)
    crf.bias, crf.move = float(x[-5]), x[-4:].reshape(2, 2).copy()
    for f, (u, _) in enumerate(used):
        crf.weight[f][u] = x[at[f] : at[f + 1]]


def label_words(feats: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, support: int = 4) -> np.ndarray:
    """1 for the words of toxic documents that make them so.

    Features (words and first letters) are taken in rounds: of those that stand in toxic documents far above chance,
    the ones that explain the most toxic documents not explained yet. A word that only keeps company with toxic words has nothing left to
    explain and is not marked.
    """
    docs = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(bounds))
    kinds = 1 + len(PREFIXES)
    hot_words = toxic[docs] > 0
    known, doc, feature, d0 = [], [], [], []
    at = 0
    for f in range(kinds):  # only features of toxic documents are told apart
        ids, own = np.unique(feats[f][hot_words], return_inverse=True)
        pair = np.unique(docs[hot_words].astype(np.int64) * len(ids) + own)
        doc.append((pair // max(1, len(ids))).astype(np.int32))
        feature.append((pair % max(1, len(ids)) + at).astype(np.int32))
        where = np.minimum(np.searchsorted(ids, feats[f][~hot_words]), len(ids) - 1)
        same = ids[where] == feats[f][~hot_words]
        pair = np.unique(docs[~hot_words][same].astype(np.int64) * len(ids) + where[same])
        d0.append(np.bincount(pair % max(1, len(ids)), minlength=len(ids)) + 0.5)
        known.append(ids)
        at += len(ids)
    doc, feature, d0 = np.concatenate(doc), np.concatenate(feature), np.concatenate(d0)
    base = np.log(d0 / ((1 - toxic).sum() + 1.0))
    chosen = np.zeros(at, bool)
    n1 = toxic.sum() + 1.0
    for _ in range(60):
        d1 = np.bincount(feature, minlength=at) + 0.5
        sure = np.log(d1 / n1) - base - 2.0 * np.sqrt(1 / d1 + 1 / d0) > np.log(3.0)
        sure &= (d1 >= support) & ~chosen
        if not sure.any():
            break
        take = sure & (d1 >= 0.5 * d1[sure].max())
        chosen |= take
        left = ~np.isin(doc, doc[take[feature]])
        doc, feature = doc[left], feature[left]
    marked = np.zeros(len(docs), bool)
    at = 0
    for f, ids in enumerate(known):
        marked[hot_words] |= np.isin(feats[f][hot_words], ids[chosen[at : at + len(ids)]])
        at += len(ids)
    return marked.astype(np.int64)


def _summary(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each document: 1, the log odds of its most toxic word, the log of 1 and its expected number of likely toxic words."""
    n = len(bounds) - 1
    some = np.flatnonzero(np.diff(bounds) > 0)
    most, total = np.full(n, 1e-6), np.zeros(n)
    if len(some):
        most[some] = np.clip(np.maximum.reduceat(p, bounds[some]), 1e-6, 1 - 1e-6)
        total[some] = np.add.reduceat(np.where(p >= 0.2, p, 0.0), bounds[some])
    return np.stack([np.ones(n), np.log(most / (1 - most)), np.log1p(total)], 1)


def fit(texts: list[str], toxic: list[int]) -> Crf:
    """Fit on labelled documents: mark words by how their features divide the labels, train, calibrate the score."""
    crf, y = Crf(), np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        crf.default = float(y.mean()) if len(y) else 0.0
        return crf
    parts, sizes = [], []
    for _, _, buf, offsets in tv.chunks(texts):
        part, _, _, own = features(buf, offsets)
        parts.append(part)
        sizes.append(np.diff(own))
    bounds = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    feats = np.empty((FEATURES, bounds[-1]), np.int32)
    at = 0
    while parts:
        part = parts.pop(0)
        feats[:, at : at + part.shape[1]] = part
        at += part.shape[1]
    marks = label_words(feats, bounds, y)
    keep = np.flatnonzero(y)
    clean = np.flatnonzero(y == 0)
    keep = np.sort(np.concatenate([keep, clean[:: max(1, len(clean) // (2 * len(keep)))]]))
    rows = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in keep])
    cuts = np.concatenate([np.arange(0, bounds[d + 1] - bounds[d], SEGMENT) + s for d, s in zip(keep, np.cumsum([0, *(bounds[keep + 1] - bounds[keep])[:-1]]), strict=True)])
    if len(rows):
        _train(crf, feats[:, rows], marks[rows], np.append(cuts, len(rows)))
    x = []
    for d in range(0, len(y), 256):  # some documents at a time, for the driver's memory
        own = bounds[d : d + 257]
        x.append(_summary(marginals(crf, feats[:, own[0] : own[-1]], own - own[0]), own - own[0]))
    x = np.concatenate(x)
    c = np.zeros(3)
    for _ in range(30):
        p = _sigmoid(x @ c)
        c = c + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (y - p) - 0.5 * c)
    crf.calibration = c
    return crf


def score_texts(crf: Crf, texts: list) -> dict[str, pa.Array]:
    scores, spans = [], []
    for _, _, buf, offsets in tv.chunks(texts, SCORE_CHUNK):
        if crf.default is not None:
            scores.append(np.full(len(offsets) - 1, crf.default))
            spans += [[] for _ in range(len(offsets) - 1)]
            continue
        feats, starts, ends, bounds = features(buf, offsets)
        p = marginals(crf, feats, bounds)
        scores.append(_sigmoid(_summary(p, bounds) @ crf.calibration))
        mine: list[list] = [[] for _ in range(len(offsets) - 1)]
        hot = np.flatnonzero(p >= 0.5)
        if len(hot):
            char = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))  # characters before each byte
            doc = np.searchsorted(bounds, hot, "right") - 1
            for i, d in zip(hot.tolist(), doc.tolist(), strict=True):
                a, b = int(char[starts[i]] - char[offsets[d]]), int(char[ends[i]] - char[offsets[d]])
                if mine[d] and i > 0 and mine[d][-1][2] == i - 1:
                    mine[d][-1] = (mine[d][-1][0], b, i)
                else:
                    mine[d].append((a, b, i))
        spans += mine
    whole = np.concatenate(scores) if scores else np.zeros(0)
    return {
        "score": pa.array(whole),
        "span_starts": pa.array([[s[0] for s in x] for x in spans], pa.list_(pa.int32())),
        "span_ends": pa.array([[s[1] for s in x] for x in spans], pa.list_(pa.int32())),
    }


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Crf:
    """Fit on at most FIT_DOCS labelled rows whose crc32(doc_id) mod 5 is not 0; ids that carry both labels teach nothing."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS).select("doc_id", "toxic")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") <= FIT_CHARS)
    rows = src.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in rows], [r.toxic for r in rows])


def score_documents(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, span_starts, span_ends for every row of docs.

    score is the probability that the document is labelled toxic; spans are the character offsets of runs of words
    whose marginal is 0.5 or more. Documents are read in place, without a shuffle. Null and empty texts have no
    words and get the score of a document without toxic words. If no label of one kind could be learned from, every
    score is the share of toxic labels. Very long texts are scored whole, words at equal marginals stay apart, a score of just 0.5 is predicted toxic. Rows that
    repeat, share a doc_id or have none are each scored; other columns are ignored; an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = src.sparkSession.sparkContext.broadcast(crf)
    scored = tv.over_texts(
        src, ["doc_id"], lambda texts: score_texts(shared.value, texts), "score double, span_starts array<int>, span_ends array<int>"
    )
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "span_starts",
        "span_ends",
    )


def drop_toxic(docs: DataFrame, crf: Crf, text_col: str = "text") -> DataFrame:
    """docs, with all their columns, without the rows that score 0.5 or more.

    Rows are judged by their own whole texts, whatever their ids: nulls as score_documents scores them, repeated rows each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def clean(batches):
        for batch in batches:
            score = score_texts(shared.value, batch.column(text_col).to_pylist())["score"].to_numpy()
            yield batch.filter(pa.array(score < 0.5))

    return docs.mapInArrow(clean, docs.schema)
