"""Language-model scores by context-tree weighting over bytes, and a unigram baseline.

Each byte is eight binary decisions. A node of the tree is a context of the d bytes before (d from 0 to DEPTH) and the bits
of the byte so far; it predicts its next bit by the Krichevsky-Trofimov estimate of its counts. A node's weighted
probability is half its own estimate and half the product of its children's, so a text's code length mixes the estimates of all
depths by how well each did on the training texts (Willems, Shtarkov, Tjalkens).

The tree is a table. A gram, a context and the byte after it, is one number whose leading byte is the context's latest, so the grams
below a node are a range of numbers. Contexts that share their SPLIT latest bytes are weighed in one task, what they weigh is
summed upwards by groupBy, and the mixtures come back down by a join: every gram of the corpus gets its probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.llm import textvec as tv
from lorekiln.llm.store import cut, shared_folder

DEPTH = 5  # bytes of the longest context
SPLIT = 3  # latest bytes of a context that choose its task; below one of them are at most 256 ** (DEPTH - SPLIT) contexts
END = 0xFF  # ends every text; no UTF-8 text holds it
START = 0x0A  # stands before every text
HOT_GRAMS = 3 << 20  # grams whose probabilities are broadcast; the rest are joined
HOT_TOKENS = 1 << 20  # tokens whose counts are broadcast; the rest are joined
HELD = 2_000_000  # counts that a task holds before it hands them on
TAUGHT, UNTAUGHT, TOKEN = 0, 1, 2  # grams of training texts, of the others, tokens of training texts
NODE = np.dtype([("code", "u1"), ("a", "i8"), ("b", "i8"), ("w", "f8")])
TOGETHER = 1 << 18  # grams weighed at once


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0, by Stirling's series eight steps up."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - np.log(np.pi)


def squeeze(x: np.ndarray, ascending: bool = False) -> tuple[str, bytes]:
    """An array for the wire; ascending ones as differences."""
    if ascending:
        x = np.diff(x, prepend=np.zeros(1, x.dtype))
    rows = np.frombuffer(x.tobytes(), np.uint8).reshape(len(x), x.dtype.itemsize)  # like bytes together
    return x.dtype.str, zstandard.ZstdCompressor(level=3).compress(rows.T.tobytes())


def unsqueeze(data: tuple[str, bytes], ascending: bool = False) -> np.ndarray:
    kind = np.dtype(data[0])
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1]), np.uint8)
    x = np.frombuffer(flat.reshape(kind.itemsize, -1).T.tobytes(), kind)
    return np.cumsum(x, dtype=kind) if ascending else x


def grams_of(buf: np.ndarray, depth: int) -> np.ndarray:
    """For each byte from the one at `depth` on, its context (the latest byte leading) and itself as one number."""
    out = buf[depth:].astype(np.uint64)
    for back in range(1, depth + 1):
        out |= buf[depth - back : len(buf) - back].astype(np.uint64) << np.uint64(8 * (depth + 1 - back))
    return out


def framed(texts: list, depth: int, limit: int = tv.CHUNK):
    """(first, bytes, bounds) of chunks of texts, each framed by START and END; bounds are those of the bytes to code."""
    lead, part, first, size = bytes([START]) * depth, [], 0, 0
    for i, text in enumerate(texts):
        part.append(lead + tv.encode(text) + bytes([END]))
        size += len(part[-1])
        if size >= limit or i == len(texts) - 1:
            yield first, np.frombuffer(b"".join(part), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in part])))
            part, first, size = [], i + 1, 0


def coded(buf: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """Which of the bytes from the one at `depth` on are to be coded: all but those that stand before a text."""
    out = np.ones(len(buf), bool)
    for i in range(depth):
        out[bounds[:-1] + i] = False
    return out[depth:]


def _bits(byte: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of a byte's first k bits, and whether the next one is set."""
    return (np.uint64(1 << k) | (byte >> np.uint64(8 - k))).astype(np.int64), ((byte >> np.uint64(7 - k)) & np.uint64(1)) == 1


def subtree(grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Weigh whole contexts of `top` bytes: all their grams of `depth` bytes, ascending, with training counts (0 too).

    Returns the probability of each gram's bits as mixed over depths `top` and below (8 rows), and the nodes at `top`: context,
    code of the bits before, zeros, ones, log weighted probability.
    """
    eight = np.uint64(8)
    own, count = grams, n.astype(np.float64)
    path = np.arange(len(grams))  # of each gram, its gram at the present depth
    levels, under, nodes = [], None, []
    for d in range(depth, top - 1, -1):
        up = None
        if d < depth:  # without the oldest byte of the context
            own, up = np.unique((own >> np.uint64(16) << eight) | (own & np.uint64(255)), return_inverse=True)
            count, path = np.bincount(up, count, len(own)), up[path]
        p, stop, nodes, here = np.empty((8, len(own))), np.ones((8, len(own))), [], []
        for k in range(8):
            code, one = _bits(own & np.uint64(255), k)
            prefix = own >> np.uint64(8 - k)
            edge = np.ones(len(own), bool)
            edge[1:] = prefix[1:] != prefix[:-1]
            first, at = np.flatnonzero(edge), np.cumsum(edge) - 1
            total = np.bincount(at, count, len(first))
            ones = np.bincount(at, np.where(one, count, 0.0), len(first))
            alone = weighted = log_kt(total - ones, ones)
            if under is not None:
                child_first, child_weight = under[k]
                deep = np.bincount(at[up[child_first]], child_weight, len(first))
                weighted = np.logaddexp(alone, deep) - np.log(2)
                stop[k] = np.exp(np.minimum(0.0, alone - np.log(2) - weighted))[at]
            p[k] = np.where(one, ones[at] + 0.5, (total - ones)[at] + 0.5) / (total[at] + 1)
            here.append((first, weighted))
            if d == top:
                nodes.append((own[first] >> eight, code[first], (total - ones).astype(np.int64), ones.astype(np.int64), weighted))
        levels.append((path, p, stop))
        under = here
    path, q, _ = levels[0]
    for path, p, stop in levels[1:]:
        q = stop[:, path] * p[:, path] + (1 - stop[:, path]) * q
    return q, tuple(np.concatenate(x) for x in zip(*nodes, strict=True))


class Lookup:
    """Values by ascending 64-bit keys, in an open table that whole arrays are looked up in."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.sent = (squeeze(keys, True), squeeze(values))
        self._fill(keys, values)

    def __getstate__(self):
        return self.sent

    def __setstate__(self, state) -> None:
        self._fill(unsqueeze(state[0], True), unsqueeze(state[1]))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 1.5))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros(1 << self.bits, values.dtype)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._slot(keys)
        while len(left):
            open_ = self.keys[at] == np.iinfo(np.uint64).max
            slot, first = np.unique(at[open_], return_index=True)
            put = np.flatnonzero(open_)[first]
            self.keys[slot], self.values[slot] = keys[left[put]], values[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * tv._P) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, values); values are 0 where nothing is found."""
        slot = self._slot(keys)
        seen = self.keys[slot]
        found = seen == keys
        values = np.where(found, self.values[slot], self.values.dtype.type(0))
        left = np.flatnonzero(~found & (seen != np.iinfo(np.uint64).max))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[left]]
            hit = seen == keys[left]
            values[left[hit]] = self.values[slot[left[hit]]]
            found[left[hit]] = True
            left = left[~hit & (seen != np.iinfo(np.uint64).max)]
        return found, values


def _merge(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


#: The token that ends every text; no text has it, for it has a blank.
END_TOKEN = tv.span_hashes(np.frombuffer(b" end", np.uint8), np.array([0]), np.array([4]))[0]


def count_corpus(docs: DataFrame, depth: int) -> DataFrame:
    """(is_token, key, n, seen) of docs(text, held_out): training counts of grams and tokens, and how often a gram occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {TAUGHT: [], UNTAUGHT: [], TOKEN: []}
        size = dict.fromkeys(held, 0)

        def merged(kind: int):
            keys, n = _merge(*(np.concatenate(x) for x in zip(*held[kind], strict=True)))
            held[kind], size[kind] = [(keys, n)], len(keys)

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = held[kind][0]
            held[kind], size[kind] = [], 0
            for a in range(0, len(keys), 200_000):
                k, c = keys[a : a + 200_000].view(np.int64), n[a : a + 200_000]
                cols = [pa.array(np.full(len(k), kind == TOKEN)), pa.array(k), pa.array(c * (kind != UNTAUGHT)), pa.array(c)]
                yield pa.RecordBatch.from_arrays(cols, names=["is_token", "key", "n", "seen"])

        def add(kind: int, keys: np.ndarray):
            u, n = np.unique(keys, return_counts=True)
            held[kind].append((u, n.astype(np.int64)))
            size[kind] += len(u)
            if size[kind] > HELD:
                merged(kind)

        for batch in batches:
            apart = np.array(batch.column("held_out"), dtype=bool)
            for kind, rows in ((TAUGHT, ~apart), (UNTAUGHT, apart)):
                texts = batch.column("text").filter(pa.array(rows)).to_pylist()
                for _, buf, bounds in framed(texts, depth, 4 * tv.CHUNK):
                    add(kind, grams_of(buf, depth)[coded(buf, bounds, depth)])
                if kind == TAUGHT:
                    for _, _, buf, offsets in tv.chunks(texts):
                        add(TOKEN, tv.words(buf, offsets, tv.IS_TOKEN)[0])
                    add(TOKEN, np.repeat(END_TOKEN, len(texts)))
            for kind in held:
                if size[kind] > HELD:
                    yield from out(kind)
        for kind in held:
            if size[kind]:
                merged(kind)
                yield from out(kind)

    counted = docs.select("text", "held_out").mapInArrow(count, "is_token boolean, key long, n long, seen long")
    return counted.groupBy("is_token", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _whole(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns key, n and seen of key-sorted batches, some TOGETHER grams at a time, never parting keys that are alike above the shift."""
    held: list[tuple[np.ndarray, ...]] = []
    size, enough = 0, TOGETHER
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in ("key", "n", "seen")))
        size += batch.num_rows
        if size < enough:
            continue
        key, n, seen = (np.concatenate(x) for x in zip(*held, strict=True))
        stop = int(np.searchsorted(key >> shift, key[-1] >> shift))
        if stop:
            yield key[:stop], n[:stop], seen[:stop]
        held, size = [(key[stop:], n[stop:], seen[stop:])], len(key) - stop
        enough = max(TOGETHER, 2 * size)
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _mixed(nodes: DataFrame) -> DataFrame:
    """ctx, code, a, b, w, stop, p of nodes one level above nodes(ctx, code, a, b, w), whose contexts are cut already; p is the probability of a one."""
    kt = F.pandas_udf(lambda a, b: pd.Series(log_kt(a.to_numpy(float), b.to_numpy(float))), "double")
    total = nodes.groupBy("ctx", "code").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("w").alias("deep")).withColumn("alone", kt("a", "b"))
    most = F.greatest("alone", "deep")
    level = total.withColumn("w", most + F.log(F.exp(F.col("alone") - most) + F.exp(F.col("deep") - most)) - float(np.log(2)))
    return level.select(
        "ctx",
        "code",
        "a",
        "b",
        "w",
        F.least(F.lit(1.0), F.exp(F.col("alone") - float(np.log(2)) - F.col("w"))).alias("stop"),
        ((F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)).alias("p"),
    )


def gram_probabilities(grams: DataFrame, depth: int, split: int = SPLIT) -> DataFrame:
    """(key, seen, value) for every row of grams(key, n, seen), a key once: value is the log10 probability of its byte after its context.

    Every counted gram is a leaf of the tree, and one that training texts lack has counts of 0. Contexts of `split` bytes are dealt
    over tasks; levels above are groupBys, of which the lowest has 256 ** (split - 1) contexts at most and meets its
    grams in a join, those above it (65,536 nodes at most) are broadcast.
    """
    if not 0 < split <= min(SPLIT, depth):
        raise ValueError("split must be from 1 to 3, and no more than the depth")
    shift = 8 * (depth + 1 - split)
    bytes_of = lambda x: x.tobytes()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, seen in _whole(batches, shift):
            grams = key.view(np.uint64)
            q, (ctx, *node) = subtree(grams, n, depth, split)
            order = np.argsort(ctx, kind="stable")
            own = np.zeros(len(order), NODE)
            for name, x in zip(NODE.names, node, strict=True):
                own[name] = x[order]
            mine, starts = np.unique(grams >> np.uint64(shift), return_index=True)
            ends, node_at = np.append(starts[1:], len(key)), np.append(np.searchsorted(ctx[order], mine), len(own))
            q = q.T.astype(np.float32)
            for a in range(0, len(mine), 1000):
                part = range(a, min(a + 1000, len(mine)))
                cols = [pa.array([bytes_of(x[starts[i] : ends[i]]) for i in part], pa.binary()) for x in (key, seen, q)]
                cols.append(pa.array([bytes_of(own[node_at[i] : node_at[i + 1]]) for i in part], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array((mine[a : a + 1000] >> np.uint64(8)).astype(np.int64)), *cols], names=["ctx", "keys", "seen", "q", "nodes"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.frombuffer(x.as_py(), NODE) for x in batch.column("nodes")]
            node = np.concatenate([np.zeros(0, NODE), *packed])
            ctx = np.repeat(batch.column("ctx").to_numpy(), [len(x) for x in packed])
            cols = [ctx, node["code"].astype(np.int32), *(np.ascontiguousarray(node[c]) for c in ("a", "b", "w"))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["ctx", "code", "a", "b", "w"])

    spark = grams.sparkSession
    folder = shared_folder(spark, "subtrees")
    (
        grams.withColumn("g", F.shiftright("key", shift))
        .repartition("g")
        .sortWithinPartitions("key")
        .select("key", "n", "seen")
        .mapInArrow(weigh, "ctx long, keys binary, seen binary, q binary, nodes binary")
        .write.parquet(folder)
    )
    trees = spark.read.parquet(folder)
    nodes = trees.select("ctx", "nodes").mapInArrow(unpack, "ctx long, code int, a long, b long, w double")
    lowest, above = None, {}
    for d in range(split - 1, -1, -1):
        level = cut(_mixed(nodes))
        if lowest is None:
            lowest = level.groupBy("ctx").agg(F.collect_list(F.struct("code", "stop", "p")).alias("level"))  # 255 at most
        else:  # 256 contexts at most
            rows = level.select("ctx", "code", "stop", "p").toPandas()
            table = np.full((2, 256**d, 256), 0.5)
            table[:, rows["ctx"], rows["code"]] = rows["stop"], rows["p"]
            above[d] = table
        nodes = level.select(F.shiftright("ctx", 8).alias("ctx"), "code", "a", "b", "w")
    shared = spark.sparkContext.broadcast(above)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                table = np.full((2, part.num_rows, 256), 0.5)
                lists = part.column("level")
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                level = lists.flatten()
                code, stop, p = (level.field(c).to_numpy() for c in ("code", "stop", "p"))
                table[:, row, code] = stop, p
                packed = [np.frombuffer(x.as_py(), np.uint64) for x in part.column("keys")]
                key = np.concatenate(packed)
                q = np.concatenate([np.frombuffer(x.as_py(), np.float32) for x in part.column("q")]).reshape(-1, 8).astype(np.float64)
                seen = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in part.column("seen")])
                row = np.repeat(np.arange(part.num_rows), [len(x) for x in packed])
                value = np.zeros(len(key))
                for k in range(8):
                    code, one = _bits(key & np.uint64(255), k)
                    mixed = q[:, k]
                    for stop, p in ((table[0, row, code], table[1, row, code]), *((t[0, c, code], t[1, c, code]) for t, c in ((above[d], (key >> np.uint64(8 * (depth + 1 - d))).astype(np.int64)) for d in sorted(above, reverse=True)))):
                        mixed = stop * np.where(one, p, 1 - p) + (1 - stop) * mixed
                    value += np.log10(mixed)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(seen), pa.array(value)], names=["key", "seen", "value"])

    met = trees.select("ctx", "keys", "seen", "q").join(lowest, "ctx")
    return met.mapInArrow(finish, "key long, seen long, value double")


def _hottest(table: DataFrame, by: str, value: str, limit: int, kind: type) -> tuple[Lookup, bool]:
    """The value of the rows with the largest `by`, `limit` at most, and whether these are all rows.

    They are found by a histogram (64 x 8 rows at most): no task sorts or sees them all.
    """
    step = F.floor(F.log2(by) * 8)
    steps = table.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect()
    least, rows = None, 0
    for r in sorted(steps, key=lambda r: -r.step):
        if rows + r.k > limit:
            break
        least, rows = r.step, rows + r.k
    t = table.where(step >= least if least is not None else F.lit(False)).select("key", F.col(value).alias("value")).toArrow()
    key, x = t["key"].to_numpy().view(np.uint64), t["value"].to_numpy()
    order = np.argsort(key)
    return Lookup(key[order], x[order].astype(kind)), rows == sum(r.k for r in steps)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_corpus(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs.

    The model learns from the rows whose crc32(doc_id) mod 7 is not 2 and scores all; score is the log10 probability
    of the text's bytes and its end, bits_per_byte that code length by byte. base_score sums log10((c + 1) / (N + V + 1)) over
    the lower-cased (A-Z) tokens and one end. All grams and tokens of all texts are counted and weighed, none is
    dropped: the tables grow with the corpus. Those of the HOT_GRAMS and HOT_TOKENS most frequent are broadcast, each
    document's others meet theirs in a join. Tokens are told apart by 64-bit hashes.

    Null texts count as empty, rows with null ids as training rows; repeated rows are each learned from and scored. Very long texts
    are coded in one piece of their own; their rare grams are one array. Without training rows each bit has probability 1/2. Ties of
    counts fall on one side of the broadcast. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tv.bound_batches(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    folder = shared_folder(spark, "counts")
    count_corpus(src, depth).write.partitionBy("is_token").parquet(folder)
    both = spark.read.schema("key long, n long, seen long, is_token boolean").parquet(folder)
    tokens = both.where("is_token").select("key", "n")
    folder = shared_folder(spark, "probabilities")
    gram_probabilities(both.where("NOT is_token").select("key", "n", "seen"), depth, min(SPLIT, depth)).write.parquet(folder)
    grams = spark.read.schema("key long, seen long, value double").parquet(folder)
    total, kinds = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scale = float(np.log10(float(total + kinds + 1)))
    hot_tokens, every_token_is_hot = _hottest(tokens, "n", "n", HOT_TOKENS, np.int64)
    hot_grams, _ = _hottest(grams, "seen", "value", HOT_GRAMS, np.float32)
    shared = spark.sparkContext.broadcast((hot_grams, hot_tokens))

    def score(texts: list) -> dict[str, pa.Array]:
        probability, counts = shared.value
        n = len(texts)
        codes, size, known, base, count = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        rare: list = []
        rare_grams: list = []
        for first, buf, bounds in framed(texts, depth):
            own = coded(buf, bounds, depth)
            key = grams_of(buf, depth)[own]
            found, x = probability.get(key)
            text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds) - depth)  # all but the lead of each text is coded
            end = first + len(bounds) - 1
            codes[first:end] = np.bincount(text_of, x, len(bounds) - 1)
            size[first:end] = np.diff(bounds) - depth - 1
            key, text_of = key[~found].view(np.int64), text_of[~found]
            at = np.searchsorted(text_of, np.arange(len(bounds)))
            rare_grams += [key[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for first, end, buf, offsets in tv.chunks(texts):
            word, _, _, bounds = tv.words(buf, offsets, tv.IS_TOKEN)
            word = np.insert(word, bounds[1:], END_TOKEN)
            bounds = bounds + np.arange(len(bounds))
            found, c = counts.get(word)
            sum_of = lambda x: np.add.reduceat(x, bounds[:-1])
            count[first:end] = np.diff(bounds)
            known[first:end] = sum_of(found.astype(np.int64))
            base[first:end] = sum_of(np.where(found | every_token_is_hot, np.log10(c + 1.0) - scale, 0.0))
            for d in range(end - first):
                rare.append(word[bounds[d] : bounds[d + 1]][~found[bounds[d] : bounds[d + 1]]].view(np.int64) if not every_token_is_hot else [])
        return {
            "hot_score": pa.array(codes),
            "bytes": pa.array(size),
            "n_tokens": pa.array(count),
            "hot_known": pa.array(known),
            "hot_base": pa.array(base),
            "rare": pa.array(rare, pa.list_(pa.int64())),
            "rare_grams": pa.array(rare_grams, pa.list_(pa.int64())),
        }

    scored = tv.over_texts(
        src.withColumn("row", F.monotonically_increasing_id()),
        ["row", "doc_id", "held_out"],
        score,
        "hot_score double, bytes long, n_tokens long, hot_known long, hot_base double, rare array<long>, rare_grams array<long>",
    )
    folder = shared_folder(spark, "scored")
    scored.write.parquet(folder)
    scored = spark.read.parquet(folder)
    values = tokens.select(F.lit(True).alias("is_token"), "key", "n", (F.log10(F.col("n") + 1.0) - scale).alias("value")).unionByName(
        grams.select(F.lit(False).alias("is_token"), "key", F.lit(0).cast("long").alias("n"), "value")
    )
    rows = lambda name, token: scored.select("row", F.lit(token).alias("is_token"), F.explode(name).alias("key"))
    term = F.coalesce("value", F.lit(-scale)) * F.col("tf")  # a token that training texts lack
    more = (
        rows("rare", True)
        .unionByName(rows("rare_grams", False))
        .groupBy("row", "is_token", "key")
        .agg(F.count("*").alias("tf"))
        .join(values, ["is_token", "key"], "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("is_token") & (F.col("n") > 0), F.col("tf")).otherwise(0)).alias("rare_known"),
            F.sum(F.when(F.col("is_token"), term)).alias("rare_base"),
            F.sum(F.when(~F.col("is_token"), term)).alias("rare_score"),
        )
    )
    whole = F.col("hot_score") + F.coalesce("rare_score", F.lit(0.0))
    return scored.join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        whole.alias("score"),
        (-whole * float(np.log2(10)) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
