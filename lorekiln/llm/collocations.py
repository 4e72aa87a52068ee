"""Phrase collocations by hierarchical pair naming.

A phrase of k words is the pair of its first and its last k - 1 words. Words that are frequent enough get a global id;
at each level two neighbouring ids in a text that overlap in all but one word make a pair, pairs are counted everywhere, and the frequent ones
get ids of their own, which replace them in the texts. As every part of a frequent phrase is frequent, none is missed. An id's two
parents lead to the counts of all its beginnings and ends, and tell which phrases a longer one covers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekiln.llm import textvec as tv
from lorekiln.llm.store import shared_folder

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
COVERED = 50  # per cent of a phrase's places at which a longer one stands
SCALE = 1_000_000
NO_LANG = "und"
BLOCK_BYTES = 16 << 20  # of texts whose words are counted together; a longer text stands alone
NAME_BITS, SEQ_BITS = 27, 14  # of an entry in its block, and of a block in its task
BREAK = np.uint32(1 << 31)  # marks the last word of a piece
FANS = (1024, 32, 1)  # groups in which the best phrases of a language are found, one after the other
#: Bytes by kind: 0 the blanks, 1 what ends a piece, 2 of words.
KIND = np.full(256, 2, np.uint8)
KIND[[0x20, 0x09]] = 0
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 1


# ---------------------------------------------------------------- inside tasks


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places start .. start + size - 1 in turn."""
    total = np.cumsum(sizes)
    return np.repeat(starts - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)


def _told_apart(keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, index) of the distinct (language, word)s; equal hashes are held against the words themselves."""
    _, first, index = np.unique(keys, return_index=True, return_inverse=True)
    one = first[index]
    same = (sizes == sizes[one]).all() and (lang == lang[one]).all()
    if same and np.array_equal(buf[_spread(starts, sizes)], buf[_spread(starts[one], sizes)]):
        return first, index
    raw = buf.tobytes()
    words = np.array([f"{g} {raw[s : s + n].hex()}" for g, s, n in zip(lang.tolist(), starts.tolist(), sizes.tolist(), strict=True)])
    return np.unique(words, return_index=True, return_inverse=True)[1:]


class Vocabulary:
    """Words of a part of a block: their hashes, bytes, sizes, languages and counts, and the sequence of their numbers."""

    def __init__(self, sequence, keys, data, sizes, lang, count):
        self.sequence, self.keys, self.data, self.sizes, self.lang, self.count = sequence, keys, data, sizes, lang, count

    @classmethod
    def of(cls, buf: np.ndarray, offsets: np.ndarray, lang_of_text: np.ndarray) -> Vocabulary | None:
        kind = KIND[buf]
        starts, ends = tv.runs(kind == 2)
        if not len(starts):
            return None
        sizes, lang = ends - starts, lang_of_text[np.searchsorted(offsets, starts, "right") - 1]
        keys = tv.mix(tv.span_hashes(buf, starts, ends) + lang.astype(np.uint64) * tv._P)
        at, index = _told_apart(keys, buf, starts, sizes, lang)
        sequence = index.astype(np.uint32)
        sequence[:-1][np.diff(np.cumsum(kind == 1, dtype=np.int32)[starts]) > 0] |= BREAK
        sequence[-1] |= BREAK
        return cls(sequence, keys[at], buf[_spread(starts[at], sizes[at])], sizes[at], lang[at], np.bincount(index))

    @classmethod
    def joined(cls, parts: list[Vocabulary]) -> Vocabulary:
        keys, data, sizes, lang, count = (np.concatenate([getattr(p, c) for p in parts]) for c in ("keys", "data", "sizes", "lang", "count"))
        starts = np.cumsum(sizes) - sizes
        at, index = _told_apart(keys, data, starts, sizes, lang)
        base = np.cumsum([0, *(len(p.keys) for p in parts)])
        number = index.astype(np.uint32)
        sequence = np.concatenate([number[b + (p.sequence & ~BREAK)] | (p.sequence & BREAK) for b, p in zip(base[:-1], parts, strict=True)])
        total = np.bincount(index, weights=count, minlength=len(at)).astype(np.int64)
        return cls(sequence, keys[at], data[_spread(starts[at], sizes[at])], sizes[at], lang[at], total)

    def words(self) -> pa.Array:
        offset = np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int32)
        return pa.StringArray.from_buffers(len(self.sizes), pa.py_buffer(offset), pa.py_buffer(np.ascontiguousarray(self.data)))


def block_words(batches: Iterable[tuple[list, list]]) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]]:
    """(sequence of local words, language, word and count of each) of blocks of (texts, languages), A-Z lower-cased; BREAK marks the ends of pieces."""
    number: dict[str, int] = {}
    parts: list[Vocabulary] = []
    size = 0

    def block() -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
        v = Vocabulary.joined(parts)
        lang = pa.DictionaryArray.from_arrays(pa.array(v.lang, pa.int32()), pa.array(list(number), pa.string())).cast(pa.string())
        return v.sequence, lang, v.words(), v.count

    for texts, langs in batches:
        of_text = np.array([number.setdefault(NO_LANG if g is None else g, len(number)) for g in langs], np.int64)
        for first, end, buf, offsets in tv.chunks(texts, tv.CHUNK):
            if (v := Vocabulary.of(buf, offsets, of_text[first:end])) is not None:
                parts.append(v)
            size += len(buf)
            if size >= BLOCK_BYTES and parts:
                yield block()
                parts, size = [], 0
    if parts:
        yield block()


def neighbours(sequence: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the pairs of neighbouring names; levels hold the ascending keys of the named entries of each level so far.

    A key is local: that of a word its number, that of a pair the ranks of its parents among the keys of their level.
    """
    at, rank = np.arange(len(sequence)), sequence & ~BREAK
    open_ = sequence < BREAK
    for depth, keys in enumerate(levels):
        if depth:
            at, rank = _paired(at, rank, open_, depth)
        found = np.minimum(np.searchsorted(keys, rank), max(len(keys) - 1, 0))
        known = keys[found] == rank if len(keys) else np.zeros(len(rank), bool)
        at, rank = at[known], found[known]
    return _paired(at, rank, open_, len(levels))


def _paired(at: np.ndarray, rank: np.ndarray, open_: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of entries of `size` words the pairs that begin one word apart with no end of a piece inside."""
    both = (np.diff(at) == 1) & open_[at[:-1] + size - 1] if len(at) else np.zeros(0, bool)
    return at[:-1][both], (rank[:-1][both].astype(np.int64) << 32) | rank[1:][both].astype(np.int64)


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the packed sequence of each block, then a row for each of its distinct words."""
    pack, part, made = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
    texts = ((b.column("text").to_pylist(), b.column("lang").to_pylist()) for b in batches)
    for sequence, lang, words, count in block_words(texts):
        if made >> SEQ_BITS or len(words) >> NAME_BITS:
            raise ValueError(f"more than {1 << SEQ_BITS} blocks in a partition or {1 << NAME_BITS} words in a block")
        block, n = part << SEQ_BITS | made, len(words)
        made += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([pack.compress(sequence.tobytes())], pa.binary())],
            names=["block", "i", "lang", "word", "n", "data"],
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.array(np.arange(n)), lang, words, pa.array(count.astype(np.int64)), pa.nulls(n, pa.binary())],
            names=["block", "i", "lang", "word", "n", "data"],
        )


def _pairs(left: pa.Table, right: pa.Table, depth: int) -> pa.Table:
    """The distinct pairs of a block: a name of their own, the local key, the parents' ids and the number of places."""
    schema = pa.schema([(c, pa.int64()) for c in ("name", "key", "a", "b", "n")])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    sequence = np.frombuffer(zstandard.ZstdDecompressor().decompress(left.column("data")[0].as_py()), np.uint32)
    level, key, ids = (right.column(c).to_numpy() for c in ("level", "key", "id"))
    order = np.lexsort((key, level))
    level, key, ids = level[order], key[order], ids[order]
    levels = [key[level == d] for d in range(min(level), depth)]
    if min(level) > 1:  # pairs of words are keyed by the words themselves
        levels.insert(0, np.arange(int((sequence & ~BREAK).max()) + 1))
    _, keys = neighbours(sequence, levels)
    keys, n = np.unique(keys, return_counts=True)
    if len(keys) >> NAME_BITS:
        raise ValueError(f"more than {1 << NAME_BITS} pairs in a block")
    ids = ids[level == depth - 1]
    block = left.column("block")[0].as_py()
    if depth == 2:  # ranks among the block's frequent words become the words' numbers, so that later levels need no words
        a, b = keys >> 32, keys & 0xFFFFFFFF
        words = levels[-1]
        keys = words[a] << 32 | words[b]
    else:
        a, b = keys >> 32, keys & 0xFFFFFFFF
    return pa.Table.from_arrays([pa.array(x) for x in ((block << NAME_BITS) + np.arange(len(keys)), keys, ids[a], ids[b], n.astype(np.int64))], schema=schema)


def _pairs_of(depth: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda left, right: _pairs(left, right, depth)


# ---------------------------------------------------------------- on Spark


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Files of shuffles go when the query that made them has ended, instead of with the driver's garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _written(df: DataFrame, name: str) -> DataFrame:
    """df from a new table in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    with _shuffles_removed(spark):
        df.write.parquet(folder)
    return spark.read.parquet(folder)


def _named(rows: DataFrame, keys: list[str], name, least: int, keep: list[str]) -> DataFrame:
    """rows of entries that occur `least` times in all, with f, their global id (their least name), and whether this row is that of the id.

    A key has a row for each block at most.
    """
    w = Window.partitionBy(*keys)
    found = rows.withColumn("name", name).select("*", F.sum("n").over(w).alias("f"), F.min("name").over(w).alias("id")).where(F.col("f") >= least)
    own = F.col("name") == F.col("id")
    return found.select("id", *keep, *(F.when(own, F.col(c)).alias(c) for c in [*keys, "f"] if c != "h"))


def phrase_candidates(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(words, phrases): n words of each lang, and every phrase of 2 to max_words words that occurs min_count times in a lang.

    phrases has id (its own among phrases of its size), a, lang, words, pre, suf, left and right: pre[k - 1] counts its first k words, suf[k - 1] its last k, left and right are the ids of
    its first and last words but one.
    """
    if min_count < 1 or max_words < 2:
        raise ValueError("a phrase has two words and one place at least")
    tv.bound_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    store = _written(texts.mapInArrow(_read_blocks, "block long, i long, lang string, word string, n long, data binary"), "words")
    local = store.where("word IS NOT NULL").select("block", "i", "lang", "word", "n")
    data = store.where("data IS NOT NULL").select("block", "data")
    totals = local.groupBy("lang").agg(F.sum("n").alias("n"))
    name = F.shiftleft("block", NAME_BITS) + F.col("i")
    named = _written(_named(local.withColumn("h", F.xxhash64("lang", "word")), ["h", "lang", "word"], name, min_count, ["block", "i"]), "word-names")
    known = named.where("f IS NOT NULL").select("id", F.col("f").alias("a"), "lang", F.array("word").alias("words"), F.array().cast("array<long>").alias("pre"), F.array().cast("array<long>").alias("suf"))
    names = named.select("block", F.lit(1).alias("level"), F.col("i").alias("key"), "id")
    levels = []
    for depth in range(2, max_words + 1):
        pairs = data.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(_pairs_of(depth), "name long, key long, a long, b long, n long")
        if depth < max_words:
            block = F.shiftright("name", NAME_BITS).alias("block")
            named = _written(_named(pairs, ["a", "b"], F.col("name"), min_count, ["name", "key"]), f"names-{depth}")
            more = named.select(block, F.lit(depth).alias("level"), "key", "id")
            names = more if depth == 2 else names.unionByName(more)
            counted = named.where("f IS NOT NULL").select("id", "a", "b", "f")
        else:
            counted = pairs.groupBy("a", "b").agg(F.sum("n").alias("f"), F.min("name").alias("id")).where(F.col("f") >= min_count)
        p, q, c = known.alias("p"), known.alias("q"), counted.alias("c")
        known = _written(
            c.join(p, F.col("c.a") == F.col("p.id")).join(q, F.col("c.b") == F.col("q.id")).select(
                "c.id", F.col("c.f").alias("a"), "p.lang",
                F.concat("p.words", F.slice("q.words", -1, 1)).alias("words"),
                F.concat("p.pre", F.array("p.a")).alias("pre"), F.concat("q.suf", F.array("q.a")).alias("suf"),
                F.col("c.a").alias("left"), F.col("c.b").alias("right"),
            ), f"phrases-{depth}",
        )
        levels.append(known)
    phrases = levels[0]
    for more in levels[1:]:
        phrases = phrases.unionByName(more)
    return totals, phrases


def _scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the lowest-scoring cut; whole numbers of 38 digits throughout."""
    wide = lambda c: c.cast("decimal(13,0)")
    cuts = F.transform(F.sequence(F.lit(1), F.size("pre")), lambda k: F.struct(F.element_at("pre", k).alias("l"), F.element_at("suf", F.size("suf") + 1 - k).alias("r"), k.alias("k")))
    each = phrases.withColumn("cut", F.explode(cuts)).withColumns({"l": F.col("cut.l"), "r": F.col("cut.r")})
    squared = (wide(F.col("a")) * wide(F.col("a"))) * F.lit(SCALE).cast("decimal(7,0)")
    each = each.withColumn("product", wide(F.col("l")) * wide(F.col("r"))).withColumn("squared", squared)
    each = each.withColumn("score", F.expr("squared div product"))
    low = F.min(F.struct("score", "cut.k", "l", "r")).alias("low")
    best = each.groupBy("id", "lang", "a", "words").agg(low)
    return best.select("id", "lang", F.array_join("words", " ").alias("phrase"), "a", "low.l", "low.r", "low.score")


def _best(rows: DataFrame, top: int) -> DataFrame:
    """Each lang's first rows, found in ever fewer groups, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(FANS[0])))
    for fan in FANS:
        w = Window.partitionBy("lang", "salt").orderBy(*order)
        rows = rows.withColumn("salt", F.col("salt") % fan).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return rows.drop("salt")


def mine_phrases(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    covered: int = COVERED,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language by score, a (both descending) and phrase.

    Texts, A-Z lower-cased, are split into pieces at .,;:!? and line ends, pieces into words at blanks and tabs. a counts all places of a
    phrase, l and r those of the parts of its lowest-scoring cut (the first of several), n the language's words; score is
    floor(1,000,000 a a / (l r)), exact. Phrases inside a longer one that stands at `covered` per cent of their places or more are
    dropped. Null texts are empty, a null language is `und`; texts may be of any length, rows that repeat all count, ids and other
    columns are ignored, and an empty table gives no rows.

    Texts become sequences of local word numbers in blocks, which with their vocabulary are the only rows that move: a word or pair has a row for each
    block that has it. Counts, ids and lookups are joins and windows over those rows.
    """
    totals, phrases = phrase_candidates(docs, min_count, max_words, text_col, lang_col)
    phrases = phrases.withColumn("size", F.size("words"))  # ids are told apart by the size of their phrases
    cover = inner = phrases.where("size > 2").select((F.col("size") - 1).alias("size"), "a", F.explode(F.array("left", "right")).alias("id")).withColumnRenamed("a", "cover")
    for _ in range(max_words - 3):  # what a longer phrase's parents hold is inside it too
        inner = inner.join(phrases.where("size > 2"), ["id", "size"]).select((F.col("size") - 1).alias("size"), "cover", F.explode(F.array("left", "right")).alias("id"))
        cover = cover.unionByName(inner)
    cover = cover.groupBy("id", "size").agg(F.max("cover").alias("cover"))
    kept = phrases.join(cover, ["id", "size"], "left").where(F.col("cover").isNull() | (100 * F.col("cover") < covered * F.col("a")))
    best = _best(_scored(kept), top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATION_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] AS ws FROM p),
g1 AS (SELECT lang, x AS ph, count(*) AS f FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY ALL),
g2 AS (SELECT lang, x.a AS a1, x.b AS a2, count(*) AS f FROM (SELECT lang, unnest([{'a': ws[i], 'b': ws[i + 1]} for i in range(1, len(ws))]) AS x FROM w) GROUP BY ALL),
g3 AS (SELECT lang, x.a AS a1, x.b AS a2, x.c AS a3, count(*) AS f
       FROM (SELECT lang, unnest([{'a': ws[i], 'b': ws[i + 1], 'c': ws[i + 2]} for i in range(1, len(ws) - 1)]) AS x FROM w) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT g2.lang, a1 || ' ' || a2 AS phrase, g2.f AS a, x.f AS l, y.f AS r, 1 AS k
      FROM g2 JOIN g1 x ON x.lang = g2.lang AND x.ph = a1 JOIN g1 y ON y.lang = g2.lang AND y.ph = a2
      WHERE g2.f >= 10 AND NOT EXISTS (SELECT 1 FROM g3 WHERE g3.lang = g2.lang AND 100 * g3.f >= 50 * g2.f
                                       AND ((g3.a1 = g2.a1 AND g3.a2 = g2.a2) OR (g3.a2 = g2.a1 AND g3.a3 = g2.a2)))
      UNION ALL
      SELECT g3.lang, g3.a1 || ' ' || g3.a2 || ' ' || a3, g3.f, x.f, y.f, 1
      FROM g3 JOIN g1 x ON x.lang = g3.lang AND x.ph = g3.a1 JOIN g2 y ON y.lang = g3.lang AND y.a1 = g3.a2 AND y.a2 = g3.a3
      UNION ALL
      SELECT g3.lang, g3.a1 || ' ' || g3.a2 || ' ' || a3, g3.f, x.f, y.f, 2
      FROM g3 JOIN g2 x ON x.lang = g3.lang AND x.a1 = g3.a1 AND x.a2 = g3.a2 JOIN g1 y ON y.lang = g3.lang AND y.ph = g3.a3),
s AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""
