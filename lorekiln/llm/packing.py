"""Best-fit decreasing packing of token pieces into sequences of one capacity.

Best-fit decreasing looks at the sizes of pieces alone, and pieces of one size, like bins with one remaining capacity, are all
the same to it. So the plan is made from the number of pieces of each size: a segment tree over remaining capacities finds the
tightest open bins in logarithmic time, and a run of equal pieces goes to a run of equal bins. This gives
the bins that placing piece after piece gives, at any number of pieces; pieces then look up the place of their rank within
their size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekiln.llm import textvec as tv
from lorekiln.llm.store import cut
from lorekiln.llm.token_output import tokenizer

CAPACITY = 2048
END_ID = 0
RUN = 1024  # pieces of one size that are ranked together, on average
_RANKS = 48  # bits of a rank in the key of the plan


class OpenBins:
    """Runs of bins by remaining capacity, under a segment tree that knows which capacities are open."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, left: int) -> None:
        at = self.leaves + left
        self.tree[at] = bool(self.runs[left])
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]

    def add(self, left: int, first: int, n: int) -> None:
        """n bins from number `first` on, each with `left` tokens free; full ones are closed."""
        if n and left:
            self.runs[left].append((first, n))
            self._mark(left)

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of an open bin that holds `need`."""
        at = self.leaves + need
        while not self.tree[at]:
            while at % 2:  # a right child: nothing beyond it below its parent
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.leaves

    def take(self, left: int) -> tuple[int, int]:
        run = self.runs[left].pop()
        self._mark(left)
        return run


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """(size, first rank, first bin, pieces a bin, offset) rows for counts[size] pieces of each size, in order of size and rank.

    The pieces of a size from a row's first rank on go to bins from its first one on, so many a bin, from the offset on. A row
    ends its run of bins or its size; as the sizes in a bin differ at most 63 times at 2,048 and a size splits runs at most
    four times, there are some half a million rows at most, however many pieces.
    """
    bins, used, rows = OpenBins(capacity), 0, []
    for size in range(capacity, 0, -1):
        n, rank = int(counts[size]), 0
        while rank < n:
            left = bins.tightest(size)
            if left is None:
                left, need = capacity, -(-(n - rank) // (capacity // size))
                bins.add(capacity, used, need)
                used += need
            first, m = bins.take(left)
            each = left // size
            put = min(n - rank, each * m)
            full, rest = divmod(put, each)
            rows.append((size, rank, first, each, capacity - left))
            bins.add(left - each * size, first, full)
            if rest:
                bins.add(left - rest * size, first + full, 1)
                full += 1
            bins.add(left, first + full, m - full)
            rank += put
    found = np.array(rows, np.int64).reshape(-1, 5)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def pack_best_fit(items: DataFrame, size_col: str = "length", capacity: int = CAPACITY, sequence_col: str = "sequence_id", offset_col: str = "offset") -> DataFrame:
    """items with two more columns: the bin of each row, and its place there, gapless from 0.

    Sizes are whole numbers from 1 to the capacity; others, nulls too, raise ValueError. The bins are those of best-fit decreasing
    over all rows; rows of equal size are interchangeable and take their places in a fixed order of their own, so rows that
    repeat each get a place. Columns of items whose names are sequence_col or offset_col are refused. An empty table gives an empty result.

    The driver holds the number of rows of each size and the plan, which the capacity bounds. A row's rank among those of its
    size is the count of earlier hash buckets of about RUN rows, plus its rank in its bucket, so a size that a third of all rows have is spread.
    """
    if {sequence_col, offset_col} & set(items.columns):
        raise ValueError(f"items already has a column {sequence_col} or {offset_col}")
    spark = items.sparkSession
    numbered = cut(items.select(F.struct(*(F.col(f"`{c}`") for c in items.columns)).alias("row"), F.col(size_col).cast("long").alias("size"), F.monotonically_increasing_id().alias("number")))
    fits = F.col("size").between(1, capacity)
    sizes = numbered.groupBy(F.when(fits, F.col("size")).otherwise(0).alias("size")).agg(F.count("*").alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        counts[r["size"]] = r.n
    if counts[0]:
        raise ValueError(f"{counts[0]} rows whose {size_col} is not from 1 to {capacity}")
    made = plan(counts, capacity)
    shared = spark.sparkContext.broadcast(((made[:, 0] << _RANKS) + made[:, 1], made))
    parts = spark.createDataFrame([(s, -(-int(n) // RUN)) for s, n in enumerate(counts) if n], "size long, parts long")
    dealt = numbered.join(F.broadcast(parts), "size").withColumn("bucket", F.pmod(F.xxhash64("number"), "parts"))  # a row for each size at most
    before = dealt.groupBy("size", "bucket").agg(F.count("*").alias("n")).select(
        "size", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    rank = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("number")) - 1 + F.col("before")
    ranked = dealt.join(before, ["size", "bucket"]).select("row", "size", rank.alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            size, rank = (batch.column(c).to_numpy() for c in ("size", "rank"))
            _, start, first, each, offset = rows[np.searchsorted(keys, (size << _RANKS) + rank, "right") - 1].T
            nth, slot = np.divmod(rank - start, each)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(first + nth), pa.array(offset + slot * size)], names=["row", "sequence", "place"])

    out = T.StructType([numbered.schema["row"], T.StructField("sequence", T.LongType()), T.StructField("place", T.LongType())])
    return ranked.mapInArrow(place, out).select("row.*", F.col("sequence").alias(sequence_col), F.col("place").alias(offset_col))


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every row's token ids, END_ID at their end, cut at the capacity.

    Null and empty texts have END_ID alone. Only what is longer than the capacity is cut; the last piece may be shorter.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, row_of, values = [], [], []
            for d, ids in enumerate(tokenizer(path).encode(batch.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                view = memoryview(ids).cast("B")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    end = min(len(ids), start + capacity)
                    rows.append((piece, start, end - start, zlib.crc32(view[4 * start : 4 * end])))
                    row_of.append(d)
                    if keep_ids:
                        values.append(ids[start:end].astype(np.int32))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4
            made = [pa.array(c, t) for c, t in zip(columns + [values] * keep_ids, types, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row_of, pa.int64())), *made], names=["doc_id", *names])

    tv.bound_batches(docs.sparkSession)
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return src.mapInArrow(pieces, schema)


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, with keep_ids=True), sequence_id, offset: every piece of every row, packed.

    Rows that share a doc_id, or have none, are each packed; very long texts are many pieces; other columns are ignored; an empty
    table gives an empty result.
    """
    return pack_best_fit(token_pieces(docs, path, capacity, **columns), capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, offsets: the sequences themselves, from pieces packed with their ids."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    whole = packed.groupBy("sequence_id").agg(rows.alias("rows"))  # as many rows as the capacity at most
    return whole.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.doc_id").alias("doc_ids"), F.col("rows.offset").alias("offsets"))
