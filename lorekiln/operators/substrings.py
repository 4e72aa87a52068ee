"""Which texts hold which strings: few strings by a scan of the texts, a few for each key by a join on the key, others as an equi-join on a few characters of each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.text import let

#: Seeds that a pattern finds: 16 characters from certain letters on. Strings that have none take the first of SCALES that they are long enough for.
MARKED = r"(?s)(?=([aeo][^aeo].{14}))"
#: (shortest string, characters of a seed, seeds that compete for a place): longer strings have longer and rarer seeds.
SCALES = ((31, 16, 16), (15, 8, 8), (7, 4, 4), (3, 2, 2), (1, 1, 1))


def seeds(text: Column, size: int, rivals: int) -> Column:
    """The distinct hashes of a text's seeds: of each `rivals` runs of `size` characters in a row the one with the least hash.

    A text that holds a string of size + rivals - 1 characters or more has all the seeds of that string.
    """
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)), lambda r: F.xxhash64(r))
    if rivals == 1:
        return F.array_distinct(runs)

    def least(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - (rivals - 1))
        return F.when(F.size(h) >= rivals, F.transform(starts, lambda i: F.array_min(F.slice(h, i, rivals))))

    return F.array_distinct(F.coalesce(let(runs, least), F.array().cast("array<long>")))


def marked_seeds(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MARKED), F.lit(1)), lambda r: F.xxhash64(r)))


#: A table of at most so many bytes and strings is sent to the tasks; keys with at most so many strings meet all their texts.
SENT_BYTES, SENT, PER_KEY = 4 << 20, 1 << 17, 256
WINDOW = 1 << 19  # bytes of text that are looked through at once


def scanner(strings: list[str]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function of an array of texts: (row, string) for each string that a text holds, by their places, every pair once.

    The first bytes of each string, eight if it has them, are looked for at every byte of the texts at once; where they stand, the others are compared eight at a time.
    """
    raw = [x.encode() for x in strings]
    size = np.array([len(x) for x in raw], np.int64)
    steps = [sorted({*range(0, n - 7, 8), n - 8}) if n > 8 else [0] for n in size.tolist()]
    code = lambda x: int.from_bytes(x[:8], "little")
    heads = np.array([code(x) for x in raw], np.uint64)
    codes = [np.array([code(x[k:]) for k in at], np.uint64) for x, at in zip(raw, steps, strict=True)]
    reach = int(size.max(initial=0)) + 8
    plans = []
    for g in sorted({min(n, 8) for n in size.tolist()}):
        mine = np.flatnonzero(np.minimum(size, 8) == g)
        mine = mine[np.argsort(heads[mine], kind="stable")]
        head, first, n = np.unique(heads[mine], return_index=True, return_counts=True)
        plans.append((np.uint64((1 << 8 * g) - 1), mine, head, first, n))
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)

    def found(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if len(texts) else offsets
        tables = []
        for _, _, head, _, _ in plans:
            table = np.zeros(1 << 20, bool)
            table[head * mix >> shift] = True
            tables.append(table)
        out = [np.zeros(0, np.int64)]
        for start in range(0, len(data), WINDOW):
            part = data[start : start + WINDOW + reach]
            here = min(WINDOW, len(data) - start)
            part = np.concatenate([part, np.zeros(8 - len(part) % 8 + 8, np.uint8)])
            grams = np.empty(len(part) - 8, np.uint64)  # the eight bytes from each byte on
            for k in range(8):
                grams[k::8] = part[k : k + len(grams)].view("<u8")[: len(grams[k::8])]
            for (mask, mine, head, first, n), table in zip(plans, tables, strict=True):
                own = grams[:here] & mask
                at = np.flatnonzero(table[own * mix >> shift])
                place = np.searchsorted(head, own[at])
                known = head[np.minimum(place, len(head) - 1)] == own[at]
                at, place = at[known], place[known]
                which = np.repeat(first[place] - np.concatenate([[0], np.cumsum(n[place])[:-1]]), n[place]) + np.arange(n[place].sum()) if len(at) else at
                at, which = np.repeat(at, n[place]), mine[which]
                row = np.searchsorted(offsets, at + start, "right") - 1
                inside = at + start + size[which] <= offsets[row + 1]
                at, which, row = at[inside], which[inside], row[inside]
                long = size[which] > 8
                pairs = np.unique(row[~long] * len(raw) + which[~long])
                out.append(pairs)
                at, which, row = at[long], which[long], row[long]
                step = 1
                while len(at):
                    left = np.array([len(steps[w]) for w in which.tolist()]) > step
                    out.append(np.unique(row[~left] * len(raw) + which[~left]))
                    at, which, row = at[left], which[left], row[left]
                    same = grams[at + np.array([steps[w][step] for w in which.tolist()], np.int64)] == np.array([codes[w][step] for w in which.tolist()], np.uint64)
                    at, which, row = at[same], which[same], row[same]
                    step += 1
        pairs = np.unique(np.concatenate(out))
        return pairs // max(len(raw), 1), pairs % max(len(raw), 1)

    return found


def few(strings: DataFrame, string: str) -> list[str] | None:
    """The distinct strings, without null and empty ones, or None if they are too many or too long to be sent to the tasks."""
    asked = strings.where(F.coalesce(F.length(string), F.lit(0)) > 0).select(F.col(string).alias("s")).distinct()
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("s")), F.lit(0))).first()
    return sorted(r.s for r in asked.collect()) if n <= SENT and size <= SENT_BYTES else None


def holding(texts: DataFrame, strings: DataFrame, keep: list[str], text: str = "text", string: str = "string", within: tuple[str, ...] = ()) -> DataFrame:
    """keep, within and the columns of strings for every row of texts(keep..., within..., text) that holds a string, by characters.

    A few strings are sent to the tasks, which look for all of them at once; of strings within a key, those of a key that has PER_KEY of them at most meet
    that key's texts in a join on the key. Of all others, neither side need be small. within names columns of both sides that must be equal
    and not null. Strings repeat as their rows do; null and empty ones are in no text. keep names a row of texts: rows that share it count as one.
    """
    known = strings.where(F.coalesce(F.length(string), F.lit(0)) > 0)
    names = [*keep, *(c for c in within if c not in keep)]
    if not within:
        sent = few(known, string)
        if sent is None:
            return _by_seeds(texts, known, names, text, string, within)
        scanned = _scanned(texts.select(*names, F.col(text).alias("_text")), sent).distinct()
        return scanned.join(known.withColumnRenamed(string, "_string"), "_string").withColumnRenamed("_string", string)
    many = known.groupBy(*within).agg(F.count("*").alias("_n")).where(F.col("_n") > PER_KEY).drop("_n")
    if many.isEmpty():
        return _within(texts, known, names, text, string, within)
    light, heavy = known.join(many, list(within), "left_anti"), known.join(many, list(within), "left_semi")
    return _within(texts, light, names, text, string, within).unionByName(_by_seeds(texts, heavy, names, text, string, within))


def _scanned(texts: DataFrame, strings: list[str]) -> DataFrame:
    """The columns of texts and `_string` in place of `_text` for each string that a text holds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, table = scanner(strings), pa.array(strings, pa.string())
        for b in batches:
            row, which = found(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*(c.take(row) for c in b.columns[:-1]), table.take(which)], names=[*b.schema.names[:-1], "_string"])

    schema = texts.drop("_text").withColumn("_string", F.lit("")).schema
    return texts.mapInArrow(scan, schema)


def _within(texts: DataFrame, known: DataFrame, names: list[str], text: str, string: str, within: tuple[str, ...]) -> DataFrame:
    """Texts and strings of one key met in pairs; both sides are dealt by the key once, and what is counted afterwards stays where it is."""
    asked = known.repartition(*within).groupBy(*known.columns).agg(F.count("*").alias("_times"))
    asked = asked.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(within)})
    same = F.contains("_text", string)
    for i, c in enumerate(within):
        same &= F.col(c) == F.col(f"_{i}")
    met = texts.select(*names, F.col(text).alias("_text")).join(asked, same)
    rest = [c for c in known.columns if c not in within]
    held = met.select(*names, *rest, "_times").distinct()
    return held.withColumn("_times", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))).drop("_times")


def _by_seeds(texts: DataFrame, known: DataFrame, names: list[str], text: str, string: str, within: tuple[str, ...]) -> DataFrame:
    """A string meets texts by one of its seeds, the one that the fewest strings share, and is then looked for in them; so no text meets all strings."""
    scale = F.lit(None).cast("int")
    for i, (least, _, _) in reversed(list(enumerate(SCALES))):
        scale = F.when(F.length(string) >= least, i).otherwise(scale)
    known = known.withColumn("_scale", F.when(F.col(string).rlike(MARKED), len(SCALES)).otherwise(scale))
    used = sorted(r["_scale"] for r in known.select("_scale").distinct().collect())  # six at most
    asked = known.select(*within, F.col(string).alias("_string"), "_scale").distinct()
    met = None
    for i in used:
        of = marked_seeds if i == len(SCALES) else lambda text, size=SCALES[i][1], rivals=SCALES[i][2]: seeds(text, size, rivals)
        mine = asked.where(F.col("_scale") == i).select(*within, "_string", F.explode(of(F.col("_string"))).alias("_seed"))
        shared = mine.groupBy(*within, "_seed").agg(F.count("*").alias("_n"))
        rarest = mine.join(shared, [*within, "_seed"]).groupBy(*within, "_string").agg(F.min_by("_seed", F.struct("_n", "_seed")).alias("_seed"))
        found = texts.select(*names, F.explode(of(F.col(text))).alias("_seed")).join(rarest, [*within, "_seed"]).select(*names, "_string")
        met = found if met is None else met.unionByName(found)
    if met is None:
        met = texts.select(*names, F.lit("").alias("_string")).limit(0)
    held = met.distinct().join(texts.select(*names, F.col(text).alias("_text")), names).where(F.contains("_text", "_string")).select(*names, "_string").distinct()
    return held.join(known.drop("_scale").withColumnRenamed(string, "_string"), [*within, "_string"]).withColumnRenamed("_string", string)
