"""Words and shingles of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of ASCII letters and digits and of bytes beyond ASCII; A-Z count as a-z.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
#: Tokens are runs of bytes other than these.
IS_TOKEN = np.ones(256, bool)
IS_TOKEN[[0x20, *range(0x09, 0x0E)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}
CHUNK = 1 << 20
BATCH_BYTES = 8 << 20  # of an Arrow batch; a worker holds a few at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, inverse: bool) -> np.ndarray:
    have = _POWERS[inverse]
    if len(have) < n:
        base = np.full(max(n, 2 * len(have)), _P_INV if inverse else _P, np.uint64)
        base[0] = 1
        have = _POWERS[inverse] = np.cumprod(base)
    return have[:n]


def running(buf: np.ndarray) -> np.ndarray:
    """Sums over the bytes so far, from which hash_of takes the hash of any span."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(len(buf), False), out=sums[1:])
    return sums


def hash_of(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * _powers(len(sums), True)[starts] + (ends - starts).astype(np.uint64))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each buf[start:end], the same wherever it stands."""
    return hash_of(running(buf), starts, ends)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    flags = np.zeros(len(inside) + 2, np.int8)
    flags[1:-1] = inside
    edges = np.flatnonzero(np.diff(flags))
    return edges[::2], edges[1::2]


def encode(text: str | None) -> bytes:
    """UTF-8; None and a pandas missing value are empty, lone surrogates are replaced."""
    return text.encode("utf-8", "replace") if isinstance(text, str) else b""


def chunks(texts: Sequence[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) over texts[first:end], joined by line feeds and A-Z lower-cased; a chunk ends once it
    holds `limit` bytes, so a very long text stands in one alone."""
    part: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        part.append(encode(text))
        size += len(part[-1]) + 1
        if size >= limit or i == len(texts) - 1:
            buf = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
            yield first, i + 1, FOLD[buf], np.concatenate(([0], np.cumsum([len(p) + 1 for p in part])))
            part, first, size = [], i + 1, 0


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray = IS_WORD):
    """(hashes, starts, ends, bounds): the chunk's words; bounds[d]:bounds[d + 1] are those of its text d."""
    starts, ends = runs(inside[buf])
    return span_hashes(buf, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of all k-word shingles; a text with 1 to k - 1 words has all its words as its one shingle."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(bounds[:-1] - at[:-1], count) + np.arange(at[-1])
    size = np.repeat(np.minimum(n, k), count)
    out = np.zeros(at[-1], np.uint64)
    for j in range(k):
        has = size > j
        out[has] = out[has] * _P + hashes[first[has] + j] + np.uint64(1)
    return mix(out + size.astype(np.uint64)), at


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of key-sorted batches in frames that never split a group of equal keys."""
    rest = None
    for pdf in batches:
        if rest is not None and len(rest):
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        same = np.ones(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            same &= v == v[-1]
        start = int(np.flatnonzero(same)[0])
        rest = pdf.iloc[start:]
        if start:
            yield pdf.iloc[:start].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def group_bounds(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Bounds of the groups of equal keys in a key-sorted frame."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.concatenate((np.flatnonzero(new), [len(pdf)]))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each of n rows' smallest row reachable over the links i-j."""
    low = np.arange(n)
    while len(i):
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = np.minimum(new, new[new])
        if (new == low).all():
            break
        low = new
    return low


def bound_batches(spark: SparkSession) -> None:
    """Let this session's Arrow batches hold BATCH_BYTES at most, unless a smaller bound is set: texts differ in length by a lot."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "64m").rstrip("b").replace("k", "000").replace("m", "000000").replace("g", "000000000")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of `size` bytes or a little more; the last may be smaller."""
    held: list[pa.RecordBatch] = []
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield from whole()
            held = []
    if held:
        yield from whole()


def over_texts(df: DataFrame, keep: list[str], fn: Callable[[list], dict[str, pa.Array]], schema: str, size: int = 0) -> DataFrame:
    """df's columns keep, and what fn makes of each Arrow batch's texts (or `size` bytes of them): one value a row for each column of schema."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [c.split()[0] for c in schema.split(", ")] if schema else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, size):
            made = fn(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [made[c] for c in names], names=[*keep, *names])

    bound_batches(df.sparkSession)
    out = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ([schema] if schema else []))
    return df.select(*keep, "text").mapInArrow(run, out)
