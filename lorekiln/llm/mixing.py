"""Mixing sources to target weights by proportionate-fair scheduling.

Every source is cut into blocks. With weight w, a source's block j is released at floor(j / w), is due at
ceil((j + 1) / w), and in each slot the released block that is due first goes out: no source is ever a whole block ahead of or
behind its weight.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekiln.llm.store import shared_folder

BLOCK_DOCS = 64
PERIOD = 10_000  # slots that a row of the schedule spans at most
PLANNED = 1 << 20  # slots of the schedule that the driver holds at once; a longer one is written to the shared folder in parts
RUN = 1024  # documents of a source that are ranked together, on average


def _whole(weights: np.ndarray) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    parts = [Fraction(w) for w in weights.tolist()]
    scale = lcm(*(f.denominator for f in parts))
    return [int(f * scale) for f in parts]


def owners(blocks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The source of each slot."""
    return np.concatenate([np.zeros(0, np.int64), *owner_runs(blocks, weights, PLANNED)])


def owner_runs(blocks: np.ndarray, weights: np.ndarray, period: int) -> Iterator[np.ndarray]:
    """The source of each slot, a period at a time; all sources start anew, with their weights scaled up, when one has no blocks left.

    Since a start the block j of weight w of S is released at floor(j S / w) and due at ceil((j + 1) S / w), in whole numbers.
    Sources that have had no slot since the start wait in one list by weight, so a start costs the same for any number of them.
    """
    out = array("q")
    for chosen, by in ((weights > 0, weights), (~(weights > 0), blocks)):
        left = np.where(chosen, blocks, 0).tolist()
        w = _whole(np.where(chosen, by, 0))
        waiting = sorted((i for i, n in enumerate(left) if n), key=lambda i: (-w[i], i))
        after = list(range(1, len(waiting) + 2))  # the next place of the list that may still have blocks
        place = {i: at for at, i in enumerate(waiting)}
        total, gone = sum(w[i] for i in waiting), [False] * (len(waiting) + 1)

        def live(at: int) -> int:
            seen = []
            while at < len(waiting) and gone[at]:
                seen.append(at)
                at = after[at]
            for x in seen:
                after[x] = at
            return at

        while total:
            t, head, released, due, had = 0, live(0), [], [], {}
            while True:
                while released and released[0][0] <= t:
                    i = heapq.heappop(released)[1]
                    heapq.heappush(due, (-(-(had[i] + 1) * total // w[i]), i))
                fresh = waiting[head] if head < len(waiting) else None
                if fresh is not None and (not due or (-(-total // w[fresh]), fresh) <= due[0]):
                    i, head = fresh, live(head + 1)
                else:
                    i = heapq.heappop(due)[1]
                out.append(i)
                if len(out) == period:
                    yield np.array(out, np.int64)
                    del out[:]
                t += 1
                had[i] = had.get(i, 0) + 1
                left[i] -= 1
                if not left[i]:
                    gone[place[i]] = True
                    total -= w[i]
                    break
                heapq.heappush(released, (had[i] * total // w[i], i))
    if out:
        yield np.array(out, np.int64)


def _rows(blocks: np.ndarray, weights: np.ndarray, period: int) -> Iterator[tuple[int, int, int, int, int, int, list[int]]]:
    """The rows of schedule, one period after the other."""
    done, base = np.zeros(len(blocks), np.int64), 0
    for part in owner_runs(blocks, weights, period):
        order = np.argsort(part, kind="stable")
        for slots in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            i, n = int(part[slots[0]]), len(slots)
            yield i, int(done[i]), int(done[i]) + n, base + int(slots[0]), n, period, (slots - slots[0]).tolist()
            done[i] += n
        base += len(part)


def schedule(blocks: np.ndarray, weights: np.ndarray, period: int) -> list[tuple[int, int, int, int, int, int, list[int]]]:
    """(source, first block, end block, first slot, blocks, period, slots from the first) rows for all blocks of all sources.

    When a source has no blocks left, the others' weights are scaled up; sources of weight 0 follow when only they are
    left, by their numbers of blocks. A row spans a period at most, and the state is carried on from one to the next.
    """
    return list(_rows(blocks, weights, period))


def _planned(spark: SparkSession, every: list, blocks: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(none, name, block, slot) of every block; a part of PLANNED slots at a time is on the driver."""
    schema = "none boolean, name string, first long, base long, slots array<long>"
    held, slots_held, folder = [], 0, None
    for i, first, _, base, _, _, slots in _rows(blocks, weights, PERIOD):
        held.append((every[i].none, every[i]["name"], first, base, slots))
        slots_held += len(slots)
        if slots_held >= PLANNED:
            folder = folder or shared_folder(spark, "mixture")
            spark.createDataFrame(held, schema).write.mode("append").parquet(folder)
            held, slots_held = [], 0
    frame = spark.createDataFrame(held, schema)
    if folder:
        frame = spark.read.parquet(folder).unionByName(frame)
    return frame.select("none", "name", "first", "base", F.posexplode("slots").alias("j", "slot")).select(
        "none", "name", (F.col("first") + F.col("j")).alias("block"), (F.col("base") + F.col("slot")).alias("slot")
    )


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.5,
    block_docs: int = BLOCK_DOCS,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """(row, doc_id, source, block, slot, position) for every row of docs; row is the whole row.

    position orders the mixture: slot x block_docs + the place in the block. Within a source documents go by hashed
    id, so a block is a random part of it. weights gives sources' targets; without it a source's weight is its number of
    documents to the power of the temperature, and sources that weights does not name come last. In every prefix of
    slots in which the set of unfinished sources stays the same, each source is less than one block from its exact weight.
    Blocks hold block_docs documents at every size.

    All rows are kept. A null source is a source. Rows with equal ids or null ids are kept and are told apart by their other columns; rows that
    repeat follow each other. Texts of any length are rows like others. Every source has a weight of its own; the driver holds a number for
    each source, and schedules PLANNED slots at a time. The rank of a document in its source is the count of earlier hash buckets of the
    source, of some RUN documents each, plus its rank within its bucket: no task sees a whole source. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    whole = [F.col(f"`{c}`") for c in docs.columns]
    named = [F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name")]
    packed = docs.select(
        F.struct(*whole).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.xxhash64(F.col(id_col), *whole).alias("h"), F.xxhash64(F.lit(1), F.col(id_col), *whole).alias("h2"),
    ).select("*", *named)
    totals = packed.groupBy("none", "name").agg(F.count("*").alias("n"), F.first("source").alias("source"))
    every = totals.orderBy(F.desc("n"), F.desc("none"), "name").collect()
    sizes = np.array([r.n for r in every], np.int64)
    if weights is None:
        target = sizes.astype(float) ** temperature
    else:
        target = np.array([float(weights.get(r.source, 0.0)) for r in every])
    plan = _planned(spark, every, -(-sizes // block_docs), target)
    # as an Arrow table its size is known to the optimizer: broadcast while that is small, joined else
    parts = spark.createDataFrame(pa.table({"none": pa.array([r.none for r in every], pa.bool_()), "name": pa.array([r["name"] for r in every], pa.string()), "parts": pa.array([-(-r.n // RUN) for r in every], pa.int64())}))
    keys = ["none", "name", "bucket"]
    packed = packed.join(parts, ["none", "name"]).withColumn("bucket", F.pmod("h", "parts"))
    counts = packed.groupBy(*keys).agg(F.count("*").alias("n"))
    before = counts.select(
        *keys,
        "n",
        F.coalesce(F.sum("n").over(Window.partitionBy("none", "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    # the slots of each bucket's blocks go to its rows as one array: rows are dealt by bucket once
    first, end = F.floor(F.col("before") / block_docs), F.floor((F.col("before") + F.col("n") - 1) / block_docs)
    buckets = (
        before.withColumn("block", F.explode(F.sequence(first, end)))
        .repartition("none", "name", "block")  # else a source's blocks would stay where its window was
        .join(plan, ["none", "name", "block"])
        .groupBy(*keys, "before")
        .agg(F.sort_array(F.collect_list(F.struct("block", "slot"))).alias("slots"))
    )
    ranked = (
        packed.join(buckets, keys)
        .withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("h2", "h", "doc_id")) - 1 + F.col("before"))
        .withColumn("block", F.floor(F.col("at") / block_docs))
    )
    slot = F.expr(f"slots[int(block - floor(before / {block_docs}))].slot")
    return ranked.select("row", "doc_id", "source", "block", slot.alias("slot"), "at").select(
        "row", "doc_id", "source", "block", "slot", (F.col("slot") * block_docs + F.col("at") % block_docs).alias("position")
    )


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """docs with the same rows and columns, partitioned and sorted by the mixture: its files, written, read in their order.

    Nulls, repeated rows, long texts and empty tables are as in mix_sources; no row is dropped.
    """
    mixed = mix_sources(docs, **options).select("row", "position")
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")
