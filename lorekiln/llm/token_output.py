"""Token ids in files, entropy coded by a static range asymmetric numeral system.

One frequency table, counted over all tokens, codes every block. A block holds the ids of consecutive
documents, dealt in turn to LANES interleaved states that share one stream of 32-bit words, so numpy codes a
row of lanes at once. Blocks are independent; within one, checkpoints hold the states and the place in the stream, so
parts of a block can be decoded in parallel, and a checksum covers its ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.llm import textvec as tv
from lorekiln.llm.store import cut, shared_folder

END_ID = 1
SCALE = 20  # frequencies sum to 2 ** SCALE
LOW = np.uint64(1 << 31)  # states stay in [LOW, LOW << 32)
BLOCK_IDS = 1 << 20  # ids of a block; one longer document has a block of its own
LANES = 1024
CHECKPOINT = 512  # rows of lanes between checkpoints
MAGIC = b"RANS1\0"
CACHE = 2_000_000  # pieces whose ids a worker remembers, at some 30 bytes each
LOOKED_UP = 1 << 19  # bytes of texts whose pieces are looked up at once, at some 60 bytes each
#: Kinds of bytes: 0 white space, 1 ASCII letters and digits, 2 ASCII punctuation without the apostrophe, 3 the rest.
KIND = np.full(256, 3, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[0x21:0x7F] = 2
KIND[0x30:0x3A] = KIND[0x41:0x5B] = KIND[0x61:0x7B] = 1
KIND[0x27] = 3
_TOKENIZERS: dict = {}


# ---------------------------------------------------------------- ids of texts


class Pieces:
    """Ids of pieces of text by their ascending hashes."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.ids = np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, where)."""
        where = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return np.zeros(len(keys), bool), where
        where = np.minimum(where, len(self.keys) - 1)
        return self.keys[where] == keys, where

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Add pieces whose (ascending) keys are not here yet."""
        where, at = np.searchsorted(self.keys, keys), len(self.ids) + np.cumsum(size) - size
        self.keys, self.at, self.size = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.size, where, size)
        self.ids = np.concatenate([self.ids, ids])

    def take(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(size, ids in turn) of some pieces."""
        size = self.size[where].astype(np.int64)
        total = np.cumsum(size)
        spread = np.repeat(self.at[where] - total + size, size) + np.arange(total[-1] if len(total) else 0)
        return size, self.ids[spread]


class PieceCache:
    """Ids of texts by the tokenizers library, which sees each distinct piece of text once while it is remembered.

    A text's ids are those of its pieces in turn. Pieces end at white space, and between an ASCII letter or digit and ASCII
    punctuation other than the apostrophe: places where tokenizers that drop white space and split words from
    punctuation always part too. ASCII capitals are folded, as those tokenizers fold them; a tokenizer that does neither is refused. Texts
    with "<|", which may hold special tokens, go to the library whole. Pieces are told apart by 64-bit hashes. CACHE of them are
    remembered: half of these are the latest ones, and when that half is full the other, older one is forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.new, self.old = Pieces(), Pieces()
        probe, parts = "Some words,(and more) of it: 12\n", ("some", "words", ",(", "and", "more", ")", "of", "it", ":", "12")
        if self._whole(probe) != [i for p in parts for i in self._whole(p)]:
            raise ValueError(f"{path} does not part words at white space and punctuation, or tells capitals apart")

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(size, ids in turn) of pieces: joined by blanks a few thousand at a time, and told apart by where the ids' characters stand."""
        sizes, ids = [], []
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            length = np.array([len(p) for p in part])
            starts = np.cumsum(length + 1) - length - 1
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            at = np.fromiter((a for a, _ in got.offsets), np.int64, len(got.ids))
            sizes.append(np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(part)))
            ids.append(np.array(got.ids, np.uint32))
        return np.concatenate(sizes), np.concatenate(ids)

    def remember(self, key: np.ndarray, index: np.ndarray, text_of) -> None:
        """Let the newer half know all of the (ascending) keys."""
        fresh = np.flatnonzero(~self.new.find(key)[0])
        if len(self.new.keys) + len(fresh) > CACHE // 2 and len(self.new.keys):
            self.new, self.old = Pieces(), self.new
            fresh = np.arange(len(key))
        kept, where = self.old.find(key[fresh])
        if kept.any():
            self.new.add(key[fresh[kept]], *self.old.take(where[kept]))
        fresh = fresh[~kept]
        if len(fresh):
            self.new.add(key[fresh], *self._encode([text_of(i) for i in index[fresh]]))

    def encode(self, texts: list) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for first, end, buf, offsets in tv.chunks(texts, LOOKED_UP):
            kind = KIND[buf]
            inside = kind > 0
            starts_here = inside & ~np.concatenate(([False], inside[:-1]))
            pair = kind[:-1] + kind[1:] * 4
            starts_here[1:] |= (pair == 1 + 2 * 4) | (pair == 2 + 1 * 4)
            starts = np.flatnonzero(starts_here)
            stops = np.append(starts[1:], len(buf))
            run_ends = tv.runs(inside)[1]
            ends = np.minimum(stops, run_ends[np.searchsorted(run_ends, starts, "right")]) if len(starts) else stops[:0]
            key, index, back = np.unique(tv.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
            raw = buf.tobytes()
            self.remember(key, index, lambda i: raw[starts[i] : ends[i]].decode("utf-8", "replace"))  # noqa: B023
            size, ids = self.new.take(self.new.find(key)[1][back])
            cut_at = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(starts, offsets)]
            for d in range(end - first):
                text = texts[first + d]
                if isinstance(text, str) and "<|" in text:
                    yield np.array(self._whole(tv.encode(text).decode()), np.uint32)
                else:
                    yield ids[cut_at[d] : cut_at[d + 1]]


def tokenizer(path: str) -> PieceCache:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PieceCache(path)
    return _TOKENIZERS[path]


def encode_texts(texts: list, path: str) -> dict[str, pa.Array]:
    """Of each text the number of its ids, with the end id, and the ids, packed."""
    pa.default_memory_pool().release_unused()  # what the batch before took: Arrow would keep it beside numpy's
    pack, counts, packed = zstandard.ZstdCompressor(level=1), [], []
    for ids in tokenizer(path).encode(texts):
        wide = np.append(ids, np.uint32(END_ID))
        narrow = wide.astype(np.uint16) if wide.max() < 1 << 16 else wide
        counts.append(len(wide))
        packed.append(bytes([narrow.itemsize]) + pack.compress(narrow.tobytes()))
    return {"n": pa.array(counts, pa.int64()), "ids": pa.array(packed, pa.binary())}


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint16 if data[0] == 2 else np.uint32).astype(np.uint32)


# ---------------------------------------------------------------- the coder


class Table:
    """Frequencies that sum to 2 ** SCALE, at least 1 for every id that occurs."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        if len(ids) > 1 << (SCALE - 1):
            raise ValueError(f"{len(ids)} ids; at most {1 << (SCALE - 1)}")
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(np.uint32), counts[order].astype(np.float64)
        freq = np.maximum(1, np.floor(counts * (1 << SCALE) / counts.sum())).astype(np.int64)
        over = int(freq.sum()) - (1 << SCALE)
        for i in np.argsort(-freq, kind="stable"):
            take = min(over, int(freq[i]) - 1) if over > 0 else over
            freq[i] -= take
            over -= take
            if not over:
                break
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
        self.size = int(self.ids[-1]) + 1
        self._rank: np.ndarray | None = None

    def rank(self, ids: np.ndarray) -> np.ndarray:
        if self._rank is None:
            self._rank = np.full(self.size, -1, np.int32)
            self._rank[self.ids] = np.arange(len(self.ids))
        return self._rank[ids]

    def __getstate__(self):
        return self.__dict__ | {"_rank": None}


def lanes_of(n: int) -> int:
    return 1 << min(LANES.bit_length() - 1, max(0, (n // 256).bit_length() - 1))


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """Header, checkpoints, states and words of one block of ids."""
    n, lanes = len(ids), lanes_of(len(ids))
    rows = -(-n // lanes)
    rank = table.rank(ids)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []
    count = 0
    for r in range(rows - 1, -1, -1):
        t = rank[r * lanes : (r + 1) * lanes]
        f, c, s = table.freq[t], table.start[t], state[: len(t)]
        full = s >= f << np.uint64(63 - SCALE)
        if full.any():
            out = s[full]
            words.append(out.astype(np.uint32))
            count += len(out)
            s = np.where(full, s >> np.uint64(32), s)
        q = s // f
        state[: len(t)] = (q << np.uint64(SCALE)) + (s - q * f) + c
        if r and r % CHECKPOINT == 0:
            marks.append((count, state.tobytes()))
    stream = np.concatenate([np.zeros(0, np.uint32), *words])[::-1]  # from the first word to read
    head = MAGIC + struct.pack("<HIIII", lanes, n, len(marks), count, zlib.crc32(ids.astype("<u4").tobytes()))
    body = b"".join(struct.pack("<I", count - at) + s for at, s in reversed(marks))
    return head + body + state.tobytes() + stream.astype("<u4").tobytes()


def decode_block(data: bytes, table: Table, part: int | None = None) -> np.ndarray:
    """The ids of a block, checked against its checksum; or of the part between two checkpoints alone."""
    size = struct.calcsize("<HIIII")
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a block of ids")
    lanes, n, n_marks, count, crc = struct.unpack_from("<HIIII", data, len(MAGIC))
    at, width = len(MAGIC) + size, 4 + 8 * lanes
    marks = [(struct.unpack_from("<I", data, at + i * width)[0], at + i * width + 4) for i in range(n_marks)]
    at += n_marks * width
    rows = -(-n // lanes)
    read, state_at, first, last = 0, at, 0, rows
    if part is not None:
        first, last = part * CHECKPOINT, min(rows, (part + 1) * CHECKPOINT)
        if part:
            read, state_at = marks[part - 1]
    state = np.frombuffer(data, np.uint64, lanes, state_at).copy()
    words = np.frombuffer(data, "<u4", count, at + 8 * lanes).astype(np.uint64)
    out = np.empty(min(n, last * lanes) - first * lanes, np.int32)
    mask = np.uint64((1 << SCALE) - 1)
    for r in range(first, last):
        m = min(lanes, n - r * lanes)
        s = state[:m]
        slot = s & mask
        t = table.slot[slot]
        out[(r - first) * lanes : (r - first) * lanes + m] = t
        s = table.freq[t] * (s >> np.uint64(SCALE)) + slot - table.start[t]
        need = np.flatnonzero(s < LOW)
        if len(need):
            s[need] = (s[need] << np.uint64(32)) | words[read : read + len(need)][::-1]
            read += len(need)
        state[:m] = s
    ids = table.ids[out]
    if part is None and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block of ids does not hold")
    return ids


# ---------------------------------------------------------------- on Spark


def tokenize(docs: DataFrame, path: str, order: list[Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, o0.. (the order), n, ids of every row, computed once."""
    by = [c.alias(f"o{i}") for i, c in enumerate(order)]
    src = docs.select(F.col(id_col).alias("doc_id"), *by, F.col(text_col).alias("text"))
    return cut(tv.over_texts(src, ["doc_id", *(f"o{i}" for i in range(len(by)))], lambda t: encode_texts(t, path), "n long, ids binary"))


def _added(total: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    """Counts by id, with those of some more ids."""
    more = np.bincount(np.concatenate([np.zeros(0, np.uint32), *ids]), minlength=len(total))
    more[: len(total)] += total
    return more


def count_ids(tokens: DataFrame) -> Table | None:
    """The table of all ids' counts; its rows are as many as the vocabulary at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for data in batch.column("ids"):
                held.append(unpack(data.as_py()))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    total, held, size = _added(total, held), [], 0
        total = _added(total, held)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "c"])

    rows = tokens.select("ids").mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()
    return Table(np.array([r.id for r in rows]), np.array([r.c for r in rows])) if rows else None


def write_token_files(docs: DataFrame, out_dir: str, path: str, order: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> Table | None:
    """Write every row's ids, each with the end id, to block files in out_dir in ascending order; returns the table.

    order defaults to the doc_id; ties go by the ids' number and content, null ids come first. Null texts have the end id alone; a very long text is one block
    alone; rows that repeat are each written; other columns are ignored. A partition of the files is a range of the order and names its blocks by their place in it. An empty table
    gives no table and files without rows.
    """
    order = order or [F.col(id_col)]
    tokens = tokenize(docs, path, order, id_col, text_col)
    table = count_ids(tokens)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = dict(tokens.dtypes)["doc_id"]
    by = [f"o{i}" for i in range(len(order))]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, block = TaskContext.get().partitionId(), 0, 0
        held_ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            lens = np.array([len(x) for x in held], np.uint32)
            cols = [[part], [block], [at], [len(ids)], pa.array([held_ids], pa.list_(batch.schema.field("doc_id").type)), [lens.tobytes()], [encode_block(ids, shared.value)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), None, pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([c if t is None else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["part", "block", "at", "n", "doc_ids", "lens", "data"])

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = unpack(data.as_py())
                if held and size + len(ids) > BLOCK_IDS:
                    yield flush()
                    at, block = at + size, block + 1
                    held_ids, held, size = [], [], 0
                held_ids.append(doc_id)
                held.append(ids)
                size += len(ids)
        if held:
            yield flush()

    ranged = tokens.repartitionByRange(*by).sortWithinPartitions(*by, "n", "ids")
    ranged.select("doc_id", "ids").mapInArrow(
        encode, f"part int, block int, at long, n long, doc_ids array<{kind}>, lens binary, data binary"
    ).write.parquet(out_dir)
    return table


def read_token_files(spark, out_dir: str, table: Table | None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of every document, in blocks decoded in parallel and checked; without ids these don't leave the worker."""
    blocks = spark.read.parquet(out_dir)
    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<")[:-1]
    offsets, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # as many rows as files
        offsets[r.part] = total
        total += r.n
    shared = spark.sparkContext.broadcast((table, offsets))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("part", "at", "lens", "data")}
                ids = decode_block(row["data"].as_py(), coder).astype("<u4")
                lens = np.frombuffer(row["lens"].as_py(), np.uint32).astype(np.int64)
                ends = np.cumsum(lens)
                start = ends - lens
                view = memoryview(ids).cast("B")
                cols = {
                    "doc_id": batch.column("doc_ids")[i].values,
                    "start": pa.array(start + first[row["part"].as_py()] + row["at"].as_py()),
                    "n_tokens": pa.array(lens),
                    "ids_crc32": pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)], pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.array([ids[a:b] for a, b in zip(start.tolist(), ends.tolist(), strict=True)], pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return blocks.mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def tokens_written_and_read(docs: DataFrame, path: str, order: list[Column] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of docs, read back from the files that hold its ids."""
    spark = docs.sparkSession
    out_dir = shared_folder(spark, "ids")
    table = write_token_files(docs, out_dir, path, order)
    return read_token_files(spark, out_dir, table, with_ids=False)
