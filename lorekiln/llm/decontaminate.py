"""Benchmark decontamination: the CGK walk maps edit distance to Hamming distance, bit-sampling LSH finds windows.

Every benchmark item is laid against windows of its own number of words in every document. A window and an item are
walked by the same random walk (Chakraborty, Goldenberg, Koucky): it copies the word it stands on at each step and
moves on or waits by a random bit of that word and step, so an edit upsets it only for a while. Samples of the walked
positions are hashed; what shares a hash in any repetition is compared by exact edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekiln.llm import textvec as tv
from lorekiln.llm.store import cut

MAX_EDITS = 0.2  # edited words, as a share of the item's
SAMPLED, REPEATS = 2, 64  # neighbouring places of a walk are upset together: at 9 in 10 upset an item is still met with 0.998
MIN_WORDS = 2
ITEM_BLOCK_WORDS = 1_000_000  # bound of the items broadcast at once; a larger benchmark is scanned in blocks
GATHERED = 32 << 20  # bytes of texts that are searched together, for their windows of one size are walked together
MEET_WORDS = 1 << 17  # words of the windows that are walked at once
_SEED = np.uint64(0xA24BAED4963EE407)


def walk(rows: np.ndarray, size: np.ndarray, seeds: np.ndarray, reach: int) -> np.ndarray:
    """The first `reach` places of each row's CGK embedding: its size[i] word hashes, padded with 0, walked with seeds[i]."""
    n, width = rows.shape
    out = np.zeros((n, reach), np.uint64)
    at = np.zeros(n, np.int64)
    every, salt = np.arange(n), tv.mix(seeds.astype(np.uint64) + _SEED)
    for j in range(reach):
        live = at < size
        word = np.where(live, rows[every, np.minimum(at, width - 1)], np.uint64(0))
        out[:, j] = word
        step = tv.mix(word + salt + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at += (step >> np.uint64(63)).astype(np.int64) * live
    return out


def edit_distance(items: np.ndarray, texts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, end) of each item row and the nearest stretch of its text row's first size[i] words."""
    n, wide = texts.shape
    cols = np.arange(wide + 1, dtype=np.int32)
    row = np.zeros((n, wide + 1), np.int32)  # a stretch may begin anywhere
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (items[:, i : i + 1] != texts), out=new[:, 1:])
        new -= cols
        np.minimum.accumulate(new, axis=1, out=row)
        row += cols
    row[cols[None, :] > size[:, None]] = 1 << 30
    end = row.argmin(1)
    return row[np.arange(n), end], end


def sampled_keys(rows: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """REPEATS keys of each row: in each repetition a walk of its own, hashed at SAMPLED places from a random one on."""
    picks = np.random.default_rng(n).integers(0, 2 * n, (REPEATS, 1)) + np.arange(SAMPLED)
    out = np.zeros((REPEATS, len(rows)), np.uint64)
    for r, at in enumerate(picks):
        walked = walk(rows, size, np.full(len(rows), r), int(at[-1]) + 1)
        for j in at:
            out[r] = tv.mix(out[r] * tv._P + walked[:, j])
    return out


class Items:
    """Benchmark items ready to be searched: their word pairs, and by size their words and LSH keys."""

    def __init__(self, ids: list, texts: list, max_edits: float):
        self.max_edits = max_edits
        by_size: dict[int, list] = {}
        for first, _, buf, offsets in tv.chunks(texts):
            hashes, _, _, bounds = tv.words(buf, offsets)
            for d in range(len(bounds) - 1):
                w = hashes[bounds[d] : bounds[d + 1]]
                if len(w) >= MIN_WORDS:
                    by_size.setdefault(len(w), []).append((ids[first + d], w))
        self.sizes = {}
        grams, of, pos, sizes = [], [], [], []
        for n, items in sorted(by_size.items()):
            rows = np.stack([w for _, w in items])
            self.sizes[n] = ([i for i, _ in items], rows, sampled_keys(rows, np.full(len(rows), n), n), len(sizes))
            grams.append(tv.mix(rows[:, :-1] * tv._P + rows[:, 1:]).ravel())
            of.append(np.repeat(np.arange(len(sizes), len(sizes) + len(rows), dtype=np.int32), n - 1))
            pos.append(np.tile(np.arange(n - 1, dtype=np.int32), len(rows)))
            sizes += [n] * len(rows)
        self.size_of, self.edits_of = np.array(sizes, np.int64), np.array([self.edits(n) for n in sizes], np.int64)
        gram = np.concatenate([np.zeros(0, np.uint64), *grams])
        of, pos = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (of, pos))
        order = np.argsort(gram, kind="stable")
        self.gram, self.of, self.pos = gram[order], of[order], pos[order]
        self.bits = max(16, int(np.ceil(np.log2(len(gram) * 16 + 1))))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(gram >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def edits(self, n: int) -> int:
        return int(self.max_edits * n + 1e-9)

    def search(self, texts: list) -> list[dict]:
        """For each text, item -> (edit distance, end word) of its closest stretch."""
        found: list[dict] = [{} for _ in texts]
        held: dict[int, list] = {n: [] for n in self.sizes}
        count = dict.fromkeys(self.sizes, 0)
        for first, _, buf, offsets in tv.chunks(texts):
            h, _, _, bounds = tv.words(buf, offsets)
            if len(h) < MIN_WORDS or not self.sizes:
                continue
            gram = tv.mix(h[:-1] * tv._P + h[1:])
            at = np.flatnonzero(self.table[(gram >> np.uint64(64 - self.bits)).astype(np.int64)])
            at = at[~np.isin(at, bounds[1:-1] - 1)]  # pairs of two documents
            lo, hi = np.searchsorted(self.gram, gram[at], "left"), np.searchsorted(self.gram, gram[at], "right")
            n_of = hi - lo
            post = np.repeat(lo - np.cumsum(n_of) + n_of, n_of) + np.arange(n_of.sum())
            at, of = np.repeat(at, n_of), self.of[post]
            doc, diagonal = np.searchsorted(bounds, at, "right") - 1, at - self.pos[post]
            order = np.lexsort((diagonal, doc, of))
            of, doc, diagonal = of[order], doc[order], diagonal[order]
            # each edit spoils two pairs at most and shifts the others by one: a stretch within reach shares this many
            # pairs with its item, none of them more than e off the diagonal of its start
            n, e = self.size_of[of], self.edits_of[of]
            last = np.arange(len(of)) + np.maximum(1, n - 1 - 2 * e) - 1
            met = np.flatnonzero(last < len(of))
            to = last[met]
            ok = (of[to] == of[met]) & (doc[to] == doc[met]) & (diagonal[to] - diagonal[met] <= 2 * e[met])
            met, to = met[ok], to[ok]
            begin = np.maximum(diagonal[to] - e[met], bounds[doc[met]])
            spans = np.maximum(np.minimum(diagonal[met] + e[met], bounds[doc[met] + 1] - 1) - begin + 1, 0)
            start = np.repeat(begin - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
            starts, of = np.divmod(np.unique(start * len(self.size_of) + np.repeat(of[met], spans)), len(self.size_of))
            for n in np.unique(self.size_of[of]).tolist():
                e, mine = self.edits(n), self.size_of[of] == n
                start, item = starts[mine], of[mine] - self.sizes[n][3]
                doc = np.searchsorted(bounds, start, "right") - 1
                batch = max(16, MEET_WORDS // n)
                for x in range(0, len(start), batch):
                    s, d = start[x : x + batch], doc[x : x + batch]
                    lo, end = np.maximum(s - e, bounds[d]), np.minimum(s + n + e, bounds[d + 1])
                    stretch = h[np.minimum(lo[:, None] + np.arange(n + 2 * e), len(h) - 1)]
                    held[n].append((stretch, end - lo, s - lo, d + first, lo - bounds[d], item[x : x + batch]))
                    count[n] += len(s)
                    if count[n] >= batch:
                        self._meet(found, n, held[n])
                        held[n], count[n] = [], 0
        for n, windows in held.items():
            if windows:
                self._meet(found, n, windows)
        return found

    def _meet(self, found: list[dict], n: int, windows: list) -> None:
        """Compare each window with its item if they share a key in any repetition."""
        ids, rows, item_keys, _ = self.sizes[n]
        stretch, size, lead, doc, start, item = (np.concatenate(x) for x in zip(*windows, strict=True))
        # a window stands once for each of its items, one after the other
        new = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(start + lead) != 0)))
        win = np.take_along_axis(stretch[new], np.minimum(lead[new, None] + np.arange(n), stretch.shape[1] - 1), 1)
        keys = sampled_keys(win, np.minimum(n, size - lead)[new], n)
        met = np.flatnonzero((keys[:, np.cumsum(new) - 1] == item_keys[:, item]).any(0))
        for p in range(0, len(met), 2048):
            w = met[p : p + 2048]
            i = item[w]
            far, end = edit_distance(rows[i], stretch[w], size[w])
            for x in np.flatnonzero(far <= self.edits(n)):
                name, mine = ids[i[x]], found[doc[w[x]]]
                best = (int(far[x]), int(start[w[x]] + end[x]))
                if name not in mine or best < mine[name]:
                    mine[name] = best


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, text) of the items that can be met, and the number of blocks of about ITEM_BLOCK_WORDS words at most."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return items, int(size // (4 * ITEM_BLOCK_WORDS)) + 1


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, max_edits: float) -> Iterator[Items]:
    """The benchmark in blocks, each fetched when it is scanned."""
    if max_edits >= 0.5:
        raise ValueError("an item of which half the words may be edited need not share a word pair with its like: max_edits must be below 0.5")
    items, blocks = _blocks(benchmark, id_col, text_col)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        yield Items([r.id for r in rows], [r.text for r in rows], max_edits)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    max_edits: float = MAX_EDITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, contaminated, item_ids, distances, end_words for every row of docs.

    A document is contaminated by an item if some stretch of it is within max_edits x the item's words of it by
    word edit distance; the least distance is reported, and the word at which the (first) such stretch ends. Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.

    Item-sized windows that share too few word pairs near their diagonal with an item to be within its reach are passed over
    before the walk; by the q-gram lemma that loses nothing. Pairs are counted by document and item; every window left is
    walked, and the items it meets are compared exactly with the words around it. Items are broadcast in blocks of bounded size, documents are read in place:
    no shuffle; where there are several blocks, the rows are numbered and written to the shared folder first. Null and empty texts are clean, texts of any length
    are searched whole; items that are null or have fewer than two words match nothing; each row of docs gives a row, also where ids repeat
    or are null; other columns are ignored; an empty table gives an empty result, and no items make no row contaminated. max_edits of 0.5 or more raise ValueError.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    several = _blocks(benchmark, item_col, item_text_col)[1] > 1
    if several:
        src = cut(src.withColumn("number", F.monotonically_increasing_id()))
    keep = ["doc_id", "number"] if several else ["doc_id"]
    kind = dict(benchmark.dtypes)[item_col]
    item_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    found = None
    for items in item_blocks(benchmark, item_col, item_text_col, max_edits):
        shared = src.sparkSession.sparkContext.broadcast(items)

        def scan(texts: list, shared=shared) -> dict[str, pa.Array]:
            rows = [sorted(f.items()) for f in shared.value.search(texts)]
            column = lambda j: pa.array([[r[1][j] for r in x] for x in rows], pa.list_(pa.int32()))
            return {
                "item_ids": pa.array([[r[0] for r in x] for x in rows], pa.list_(item_type)),
                "distances": column(0),
                "end_words": column(1),
            }

        part = tv.over_texts(
            src, keep, scan, f"item_ids array<{kind}>, distances array<int>, end_words array<int>", GATHERED
        )
        found = part if found is None else found.unionByName(part)
    names = ["item_ids", "distances", "end_words"]
    if several:  # a row for each block of items
        found = found.groupBy("number").agg(F.first("doc_id").alias("doc_id"), *(F.flatten(F.collect_list(c)).alias(c) for c in names))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), *names)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, text_col: str = "text") -> DataFrame:
    """docs, with all their columns, without the contaminated rows; one pass over docs for each block of items.

    Rows are judged by their own texts whatever their ids; null texts stay.
    """
    tv.bound_batches(docs.sparkSession)
    out = docs
    for items in item_blocks(benchmark, "item_id", "text", max_edits):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in tv.gathered(batches, GATHERED):
                leaks = shared.value.search(batch.column(text_col).to_pylist())
                yield batch.filter(pa.array([not f for f in leaks], pa.bool_()))

        out = out.mapInArrow(clean, T.StructType(docs.schema.fields))
    return out
