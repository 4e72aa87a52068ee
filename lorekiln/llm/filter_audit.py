"""Audit of the interplay of filters by lattice edges.

Filters applied in some order walk a path through the lattice of subsets of filters: each step goes from the
subset that is already applied to that subset and one filter more. What a step does depends on that edge alone,
so documents are counted for the 80 edges of five filters once, and the 600 steps of all 120 orders look their edges up.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
DUPLICATE = "E"
SALTS = 1024  # rows without an id are spread over so many keys
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failing(text: Column) -> dict[str, Column]:
    """Whether a text fails each of the filters that look at it alone; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    inner = F.btrim(text, F.lit(BLANKS))
    words = F.split(inner, r"[\x20\x09-\x0D]+")
    n = F.when(inner == "", 0).otherwise(F.size(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": n < 100,
        "B": (inner != "") & (100 * F.size(F.array_distinct(words)) < 80 * n),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents of each part that fail just the filters whose bits are set in mask.

    Texts are told apart by SHA-256. Of the rows with one text those whose doc_id is above the smallest fail E; rows without doc_id
    neither fail it nor make others fail. Copies are counted by text, part and labels before
    their smallest ids meet, so a text that a third of all rows share is a few rows there.
    """
    text = F.coalesce("text", F.lit(""))
    mask = sum((F.when(c, 1 << FILTERS.index(k)).otherwise(0) for k, c in failing(F.col("text")).items()), F.lit(0))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("long")
    rows = docs.select("doc_id", salt.alias("salt"), F.coalesce("lang", F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    noted = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    marked = rows.join(noted.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").fillna(False, ["good", "toxic"])
    alike = ["digest", "part", "mask", "good", "toxic"]
    by_id = marked.groupBy("doc_id", "salt", *alike).agg(F.count("*").alias("n"))  # lies by doc_id already
    has_id = F.col("doc_id").isNotNull()
    groups = by_id.groupBy(*alike).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(~has_id, F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"),
    )
    lowest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    # a digest has a row for each part and label only
    own = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(0)
    split = groups.withColumn("lowest", lowest).select(
        "part", "good", "toxic", "mask", F.inline(F.array(F.struct(F.lit(0).alias("copy"), own.alias("c")), F.struct(F.lit(1).alias("copy"), (F.col("n") - own).alias("c"))))
    )
    whole = (F.col("mask") + F.col("copy") * (1 << FILTERS.index(DUPLICATE))).alias("mask")
    return split.groupBy("part", whole, "good", "toxic").agg(F.sum("c").alias("n"))


def lattice_edges(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, applied, filter, COUNTS..., shapley): what each filter does after each subset of the others, from failure_counts.

    shapley is the filter's removed summed over all orders: an edge from s of k filters lies on s! (k - 1 - s)! of them.
    """
    k = len(filters)
    edges = [(s, f) for s in range(1 << k) for f in range(k) if not s >> f & 1]
    every = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())).alias("orders")) for s, f in edges))
    met = counts.select("*", F.inline(every))
    bit = F.expr("1 << filter")
    alive, fails = F.col("mask").bitwiseAND(F.col("applied")) == 0, F.col("mask").bitwiseAND(bit) != 0
    hits = (alive & ~fails, alive & fails, ~alive & fails, F.col("mask") == bit, alive & fails & F.col("good"), alive & fails & F.col("toxic"))
    sums = [F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long").alias(name) for name, c in zip(COUNTS, hits, strict=True)]
    found = met.groupBy("part", "applied", "filter", "orders").agg(*sums)
    shapley = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter"))
    return found.withColumn("shapley", shapley.cast("long")).drop("orders")


def order_steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter_order, step, applied, filter): each step of each order as an edge; 600 rows for five filters."""
    rows = [
        ("".join(filters[f] for f in order), i + 1, sum(1 << f for f in order[:i]), order[i])
        for order in permutations(range(len(filters)))
        for i in range(len(filters))
    ]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, COUNTS..., shapley: one row for each language, order of the five filters and step, zeros included.

    Filters fail: A texts of under 100 words; B fewer than 80 distinct words in 100; C more than 10 capitals A-Z in 100 code points;
    D one of #$%&*|; E texts of a smaller doc_id, anywhere in the table, removed or not. Words are runs of characters other
    than the blanks from tab to carriage return and the space. labels(doc_id, quality, toxic) may lack documents;
    of repeated rows any 1 counts, and labels of no document count nothing. A null text is empty, a null language the part of
    the empty string. Rows that share a doc_id each count, and none of them is a smaller one of the others; rows without
    doc_id have no labels and never fail E. Very long texts are one row like any other. Other columns are ignored; an empty table
    gives no rows.

    Documents are counted by the set of filters that they fail and go to the edges as counts, so what follows the count is some
    thousand rows for each language.
    """
    edges = lattice_edges(failure_counts(docs.select("doc_id", "lang", "text"), labels.select("doc_id", "quality", "toxic")))
    steps = F.broadcast(order_steps(docs.sparkSession))  # 600 rows at any size
    return edges.join(steps, ["applied", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x for x in regexp_split_to_array(t, '[\x20\x09-\x0D]+') if x <> ''] AS ws FROM d),
f AS (SELECT doc_id, part, (len(ws) < 100)::INT AS a, (100 * len(list_distinct(ws)) < 80 * len(ws))::INT AS b,
             (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT AS c,
             regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a || '' || b || c || d || e AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
      FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT p.k || q.k || r.k || s.k || t.k AS filter_order FROM x p, x q, x r, x s, x t
      WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
st AS (SELECT filter_order, i::INT AS step, filter_order[i] AS k, filter_order[1:i - 1] AS done FROM o, range(1, 6) u(i)),
j AS (SELECT part, filter_order, step, k, n, good, toxic, fails[ord(k) - 64] = '1' AS bad, fails,
             len([y for y in range(1, step) if fails[ord(done[y]) - 64] = '1']) = 0 AS alive FROM m, st),
r AS (SELECT part, filter_order, step, k,
             sum(CASE WHEN alive AND NOT bad THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN alive AND bad THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN NOT alive AND bad THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN bad AND length(replace(fails, '0', '')) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN alive AND bad AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN alive AND bad AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
      FROM j GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r
"""
