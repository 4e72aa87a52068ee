"""License scans by diagonal voting, in DataFrame functions only.

A document and a license template are two word sequences. Every rolling word k-gram of every
document joins the template positions that hold the same k-gram; a hit at document word p and
template word t votes for the diagonal p - t. All votes of one undisturbed copy fall on one diagonal,
and a copy with a few words put in or left out on neighbouring ones.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases that count wherever their words stand consecutively, with their labels.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: License notices that the vote looks for, with their labels.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms", "gpl"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("mozilla public license version 2 0", "mpl-2.0"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_TEMPLATE_GRAMS = 100_000  # bound of the broadcast template table


def _values(base, templates, k: int) -> str:
    """The template positions as SQL VALUES rows: gram, template, position, its length, label, is it a base phrase."""
    rows = ["('', -1, 0, 0, '', false)"]  # each document's own row
    for tid, (phrase, label, is_base) in enumerate([(*p, True) for p in base] + [(*t, False) for t in templates]):
        words = re.findall(WORD, phrase.lower())
        if len(words) < k:
            raise ValueError(f"a template needs {k} words at least: {phrase!r}")
        for t in range(len(words) - k + 1):
            gram, safe = " ".join(words[t : t + k]), label.replace("'", "''")
            rows.append(f"('{gram}', {tid}, {t}, {len(words)}, '{safe}', {str(is_base).lower()})")
    if len(rows) > MAX_TEMPLATE_GRAMS:
        raise ValueError(f"{len(rows)} template grams; the broadcast bound is {MAX_TEMPLATE_GRAMS}")
    return ", ".join(rows)


def template_table(spark: SparkSession, base, templates, k: int) -> DataFrame:
    return spark.sql(
        f"SELECT xxhash64(gram) AS gram_hash, * FROM VALUES {_values(base, templates, k)} "
        "AS t(gram, tid, tpos, tlen, label, is_base)"
    )


def license_scan(
    docs: DataFrame,
    base: Sequence[tuple[str, str]] = BASE_PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    k: int = 2,
    band: int = 2,
    min_coverage: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(documents, spans) of all license wording in docs.

    documents: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.
    spans: doc_id, label, start_word, end_word, coverage for each verified span.

    Words are the runs of characters outside ASCII punctuation and space, A-Z lower-cased. A base phrase
    counts at every diagonal on which all its k-grams vote. Other templates: diagonals at most `band`
    apart merge, the words that the merged votes cover are compared with the template, and a span is
    verified if they are min_coverage of it; score is the best coverage of any template.
    The grams' hashes join and their words are compared too, so a hash collision gives no vote.

    Null and empty texts have no words and give zero counts, null places, empty labels and score 0.
    Every row gives a row, also rows that share an id or have none; very long texts are as others, and equal coverages count once. Other
    columns are ignored; an empty table gives an empty result. One pass over the
    texts, one broadcast join with the (bounded) templates; only votes and one row a document are shuffled.
    """
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words = src.select(
        "row",
        "doc_id",
        F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("w"),
    )
    if k == 2:
        grams = F.expr("transform(slice(w, 1, size(w) - 1), (x, i) -> concat(x, ' ', w[i + 1]))")
    else:
        grams = F.expr(f"transform(slice(w, 1, size(w) - {k - 1}), (x, i) -> array_join(slice(w, i + 1, {k}), ' '))")
    grams = F.when(F.size("w") >= k, F.concat(F.array(F.lit("")), grams)).otherwise(F.array(F.lit("")))
    rolled = words.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode(grams).alias("at", "gram"))
    t = template_table(src.sparkSession, base, templates, k)
    votes = rolled.withColumn("gram_hash", F.xxhash64("gram")).join(F.broadcast(t), ["gram_hash", "gram"])
    pos = F.col("at").cast("long") - 1
    diagonals = votes.groupBy(
        "row",
        "doc_id",
        "tid",
        F.when(F.col("tid") < 0, 0).otherwise(pos - F.col("tpos")).alias("diag"),
    ).agg(
        F.max("n_words").alias("n_words"),
        F.collect_set("tpos").alias("tpos"),
        F.max("tlen").alias("tlen"),
        F.max("label").alias("label"),
        F.max("is_base").alias("is_base"),
    )
    near = Window.partitionBy("row", "doc_id", "tid").orderBy("diag")
    banded = diagonals.withColumn(
        "opens", F.when(F.col("diag") - F.lag("diag").over(near) <= band, 0).otherwise(1)
    ).withColumn("span", F.sum("opens").over(near))
    place = F.col("is_base") & (F.size("tpos") == F.col("tlen") - (k - 1))
    spans = (
        banded.groupBy("row", "doc_id", "tid", "span")
        .agg(
            F.max("n_words").alias("n_words"),
            F.max("tlen").alias("tlen"),
            F.max("label").alias("label"),
            F.max("is_base").alias("is_base"),
            F.sum(place.cast("long")).alias("places"),
            F.min(F.when(place, F.col("diag"))).alias("first_place"),
            F.max(F.when(place, F.col("diag"))).alias("last_place"),
            F.min(F.col("diag") + F.array_min("tpos")).alias("start_word"),
            F.max(F.col("diag") + F.array_max("tpos") + k - 1).alias("end_word"),
            F.flatten(F.collect_list("tpos")).alias("hit"),
        )
        .withColumn("covered", F.expr(f"size(array_distinct(flatten(transform(hit, p -> sequence(p, p + {k - 1})))))"))
        .withColumn("coverage", F.when(F.col("tid") >= 0, F.col("covered") / F.col("tlen")).otherwise(0.0))
    )
    label = F.when(F.when(F.col("is_base"), F.col("places") > 0).otherwise(F.col("coverage") >= min_coverage) & (F.col("tid") >= 0), F.col("label"))
    scored = spans.withColumn("found", label)
    documents = scored.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.sum("places").alias("n_base"),
        F.min("first_place").alias("first_word"),
        F.max("last_place").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("found")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("found")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    ).drop("row")
    verified = scored.where("found IS NOT NULL").select(
        "doc_id", F.col("found").alias("label"), "start_word", "end_word", "coverage"
    )
    return documents, verified


def license_sql(base=BASE_PHRASES, templates=TEMPLATES, band: int = 2, min_coverage: float = 0.8) -> str:
    """license_scan's documents for k = 2, as DuckDB SQL over the view documents."""
    return f"""
WITH t AS (SELECT * FROM (VALUES {_values(base, templates, 2)}) AS v(gram, tid, tpos, tlen, label, is_base) WHERE tid >= 0),
w AS (SELECT row_number() OVER () AS doc_id, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
n AS (SELECT doc_id, id, len(w) AS n_words FROM w),
g AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w),
hits AS (SELECT DISTINCT doc_id, tid, i - 1 - tpos AS diag, tpos, tlen, label, is_base FROM g JOIN t ON gram = w[i] || ' ' || w[i + 1]),
d AS (SELECT doc_id, tid, diag, count(*) AS votes, tlen, label, is_base FROM hits GROUP BY ALL),
b AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, tid ORDER BY diag) AS span FROM (
  SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, tid ORDER BY diag) <= {band} THEN 0 ELSE 1 END AS opens FROM d)),
c AS (SELECT doc_id, tid, span, count(DISTINCT x) AS covered FROM (
  SELECT doc_id, tid, span, unnest([tpos, tpos + 1]) AS x FROM b JOIN hits USING (doc_id, tid, diag)) GROUP BY ALL),
s AS (SELECT b.doc_id, b.tid, span, tlen, label, is_base, covered / tlen AS coverage,
  count(*) FILTER (WHERE is_base AND votes = tlen - 1) AS places,
  min(diag) FILTER (WHERE is_base AND votes = tlen - 1) AS first_place,
  max(diag) FILTER (WHERE is_base AND votes = tlen - 1) AS last_place
  FROM b JOIN c USING (doc_id, tid, span) GROUP BY ALL),
f AS (SELECT *, CASE WHEN (is_base AND places > 0) OR (NOT is_base AND coverage >= {min_coverage}) THEN label END AS found FROM s)
SELECT any_value(id) AS doc_id, max(n_words)::BIGINT AS n_words, coalesce(sum(places), 0)::BIGINT AS n_base,
  min(first_place)::BIGINT AS first_word, max(last_place)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT CASE WHEN is_base THEN found END, ',' ORDER BY CASE WHEN is_base THEN found END), '') AS base_labels,
  coalesce(string_agg(DISTINCT found, ',' ORDER BY found), '') AS labels,
  coalesce(max(coverage), 0.0)::DOUBLE AS score
FROM n LEFT JOIN f USING (doc_id) GROUP BY n.doc_id"""
