"""Queries of the reviewer's console, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekiln.catalog import _any, _pairs, query
from lorekiln.catalog_knowledge import _pick, _picked
from lorekiln.functions import text as X
from lorekiln.operators import cluster, console
from lorekiln.plans import tables as T

# ---------------------------------------------------------------- packs

_EXCERPTS = ("冷却水供水温度设定值应当在二十五摄氏度以下并且由控制器每隔五分钟重新计算", "plain text", None, "阀门\n开度", "", "two words of a longer passage that a reader sees only in part, as it is cut after eighty characters")
_BLANK_TITLES = (" own title ", None, "", "  ")


def _shown(column: str, limit: int) -> str:
    t = f"trim(replace(coalesce({column}, ''), chr(10), ' '))"
    return f"CASE WHEN length({t}) <= {limit} THEN {t} ELSE {t}[1:{limit}] || '...' END"


@query(f"""WITH e AS (SELECT l_orderkey AS doc, l_linenumber AS chunk, l_returnflag AS kind, l_partkey, l_suppkey, {_picked(_BLANK_TITLES, 'l_partkey % 4')} AS title, {_picked(_BLANK_TITLES, 'l_suppkey % 4')} AS summary, {_picked(_EXCERPTS, 'l_partkey % 6')} AS excerpt FROM lineitem),
a AS (SELECT l_orderkey AS doc, l_linenumber AS chunk, l_returnflag AS kind, arg_max(c_name, c_custkey) AS t, arg_max(CASE WHEN c_acctbal > 2000 THEN c_mktsegment ELSE '' END, c_custkey) AS s FROM lineitem JOIN customer ON l_orderkey = c_custkey GROUP BY ALL)
SELECT doc, chunk, l_partkey, l_suppkey, coalesce(nullif(trim(title), ''), nullif(t, ''), CASE WHEN regexp_matches(coalesce(excerpt, ''), '[一-鿿]') THEN {_shown('excerpt', 28)} ELSE 'key' || l_partkey END) AS title,
coalesce(nullif(trim(summary), ''), nullif(s, ''), {_shown('excerpt', 80)}) AS summary, t IS NOT NULL AS traced FROM e LEFT JOIN a USING (doc, chunk, kind)""")
def review_center(spark, sf_dir):
    li = T.read(spark, sf_dir, "lineitem")
    trace = [F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("chunk"), F.col("l_returnflag").alias("kind")]
    entries = li.select(
        *trace, "l_partkey", "l_suppkey", _pick(_BLANK_TITLES, F.col("l_partkey") % 4).alias("title"), _pick(_BLANK_TITLES, F.col("l_suppkey") % 4).alias("summary"),
        _pick(_EXCERPTS, F.col("l_partkey") % 6).alias("excerpt"), F.concat(F.lit("key"), "l_partkey").alias("key_candidate"),
    )
    c = T.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("title"), F.when(F.col("c_acctbal") > 2000, F.col("c_mktsegment")).otherwise("").alias("summary"))
    assets = li.join(c, F.col("l_orderkey") == F.col("c_custkey")).select(*trace, F.col("c_custkey").alias("asset"), "title", "summary")
    return console.review_center(entries, assets).select("doc", "chunk", "l_partkey", "l_suppkey", "title", "summary", "traced")


_STATES = ("approved", "accepted", "rejected", "review_ready", "other", None)


@query(f"""SELECT s AS state, CASE WHEN s IN ('approved', 'accepted') THEN 'accepted' WHEN s IN ('rejected', 'review_ready') THEN s ELSE 'pending' END AS shown, count(*) AS n FROM (SELECT {_picked(_STATES, 'o_orderkey % 6')} AS s FROM orders) GROUP BY 1, 2""")
def review_states(spark, sf_dir):
    s = T.read(spark, sf_dir, "orders").select(_pick(_STATES, F.col("o_orderkey") % 6).alias("state"))
    return s.groupBy("state", console.review_state(F.col("state")).alias("shown")).agg(F.count("*").alias("n"))


_DECISION = "CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'pending' END"


@query(f"""WITH s AS (SELECT o_custkey AS pack, min(o_orderkey) AS doc, min(o_orderpriority) AS class_id FROM orders WHERE o_custkey % 11 <> 0 GROUP BY 1),
e AS (SELECT o_custkey AS pack, o_orderkey AS candidate, {_DECISION} AS decision, CASE WHEN o_orderkey % 9 <> 0 THEN 't' ELSE ' ' END AS title, CASE WHEN o_orderkey % 10 <> 0 THEN 's' END AS summary FROM orders),
n AS (SELECT o_custkey AS pack, min(o_orderkey) + (o_custkey % 7 = 0)::INT AS doc, min(o_orderpriority) || CASE WHEN o_custkey % 5 = 0 THEN '!' ELSE '' END AS class_id FROM orders GROUP BY o_custkey),
moved AS (SELECT DISTINCT pack FROM e WHERE candidate % 50 = 0), unfinished AS (SELECT DISTINCT pack FROM e WHERE candidate % 50 <> 0 AND decision = 'accepted' AND (trim(title) = '' OR summary IS NULL))
SELECT n.pack, CASE WHEN s.pack IS NULL THEN 'unknown_pack' WHEN n.doc <> s.doc THEN 'doc_changed' WHEN n.class_id <> s.class_id THEN 'class_id_changed' WHEN n.pack IN (FROM moved) THEN 'candidates_changed' WHEN n.pack IN (FROM unfinished) THEN 'unfinished_entry' END AS fault FROM n LEFT JOIN s USING (pack)""")
def pack_edits(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "pack")
    own = o.groupBy("pack").agg(F.min("o_orderkey").alias("doc"), F.min("o_orderpriority").alias("class_id"))
    edited = own.withColumns({
        "doc": F.col("doc") + F.when(F.col("pack") % 7 == 0, 1).otherwise(0), "class_id": F.concat("class_id", F.when(F.col("pack") % 5 == 0, "!").otherwise("")),
    })
    key = F.col("o_orderkey")
    entries = o.select("pack", key.alias("candidate"), F.expr(_DECISION).alias("decision"), F.when(key % 9 != 0, "t").otherwise(" ").alias("title"), F.when(key % 10 != 0, "s").alias("summary"))
    return console.pack_edits(own.where("pack % 11 <> 0"), edited, ["doc", "class_id"], entries, entries.where("candidate % 50 <> 0"))


@query(f"""WITH g AS (SELECT o_custkey AS pack, count(*) FILTER (d = 'accepted') AS n_accepted, count(DISTINCT o_orderpriority) FILTER (d = 'accepted') AS kinds, max(o_orderpriority) FILTER (d = 'accepted') AS one FROM (SELECT *, {_DECISION} AS d FROM orders) GROUP BY 1)
SELECT pack, n_accepted, CASE WHEN kinds = 1 THEN one END AS class_id, CASE WHEN n_accepted = 0 THEN 'no_accepted' WHEN kinds <> 1 THEN 'several_classes' END AS fault FROM g""")
def accepted_identity(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders")
    return console.accepted_identity(o.select(F.col("o_custkey").alias("pack"), F.expr(_DECISION).alias("decision"), F.col("o_orderpriority").alias("class_id")))


@query("""WITH c AS (SELECT l_orderkey AS candidate, l_partkey AS chunk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem)
SELECT candidate, place, chunk, CASE WHEN p_partkey IS NULL THEN 'unknown_chunk' WHEN p_size % 2 <> candidate % 2 THEN 'other_document' END AS fault FROM c LEFT JOIN (SELECT * FROM part WHERE p_size > 3) ON chunk = p_partkey WHERE place > 1""")
def supporting_evidence(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    e = T.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("candidate")).agg(F.transform(parts, lambda x: x["l_partkey"]).alias("chunk_ids"))
    chunks = T.read(spark, sf_dir, "part").where("p_size > 3").select(F.col("p_partkey").alias("chunk"), (F.col("p_size") % 2).alias("chunk_doc"))
    return console.supporting_evidence(e.withColumn("doc", F.col("candidate") % 2), chunks)


# ---------------------------------------------------------------- documents


@query("""WITH n AS (SELECT user_id AS doc, count(*) AS n FROM events GROUP BY 1), t AS (SELECT l_orderkey AS doc, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
k AS (SELECT l_orderkey AS doc, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS c, count(DISTINCT l_partkey) AS n_linked FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1)
SELECT o_orderkey AS doc, CASE WHEN n.n > 0 THEN 'chunked' WHEN o_orderstatus = 'F' THEN 'parsed' ELSE 'imported' END AS status, coalesce(t.c, k.c, '') AS classes, coalesce(n_linked, 0)::BIGINT AS n_linked
FROM orders LEFT JOIN n ON n.doc = o_orderkey LEFT JOIN t ON t.doc = o_orderkey LEFT JOIN k ON k.doc = o_orderkey""")
def document_console(spark, sf_dir):
    li = T.read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc")
    o = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderstatus") == "F", "parsed").alias("parse_status"))
    links = li.where("l_returnflag = 'A'").join(T.read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("doc", F.col("l_partkey").alias("asset"), F.col("p_type").alias("class_id"))
    return console.document_console(o, T.read(spark, sf_dir, "events").withColumnRenamed("user_id", "doc"), li.where("l_returnflag = 'R'").select("doc", F.col("l_linestatus").alias("class_id")), links)


@query("""WITH l AS (SELECT p_type AS class_id, max(CASE WHEN p_size = 50 THEN p_name ELSE ' ' END) AS en, max(CASE WHEN p_size > 30 THEN p_brand END) AS first_label FROM part GROUP BY 1)
SELECT DISTINCT p_brand AS domain, p_type AS class_id, coalesce(nullif(trim(en), ''), first_label, p_type) AS label FROM part JOIN l ON p_type = class_id""")
def class_labels(spark, sf_dir):
    p = T.read(spark, sf_dir, "part")
    en = F.max(F.when(F.col("p_size") == 50, F.col("p_name")).otherwise(" ")).alias("en")
    labels = p.groupBy(F.col("p_type").alias("class_id")).agg(en, F.max(F.when(F.col("p_size") > 30, F.col("p_brand"))).alias("primary_label"))
    return console.class_labels(p.select(F.col("p_brand").alias("domain"), F.col("p_type").alias("class_id")), labels, "en")


_FILES = ("GB 50019.docx", "manual.pdf", "设备标准.DOC", "notes.docx", None, "gbt.pdf")
_EXTS = (".docx", "pdf", ".DOC", "docx", None, ".pdf")
_QUALITIES = ("unknown", "good", "", None, "Unknown")
_COUNTS = ("49.9", "50", "x", None, "", "120.5", "7")


@query(f"""WITH d AS (SELECT doc_id AS doc, lower(coalesce({_picked(_FILES, 'doc_id % 6')}, '')) AS f, ltrim(lower(coalesce({_picked(_EXTS, 'doc_id % 6')}, '')), '.') AS x, lower(coalesce({_picked(_QUALITIES, 'doc_id % 5')}, '')) AS q, try_cast({_picked(_COUNTS, 'doc_id % 7')} AS DOUBLE) AS pages FROM documents WHERE n_chars % 3 <> 0)
SELECT doc, x IN ('doc', 'docx') AND {_any('f', ('gb', '标准'))} AS gb_word, q IN ('unknown', '') AND floor(coalesce(pages, 0)) >= 50 AS unknown_large FROM d""")
def review_queue(spark, sf_dir):
    i = F.col("doc_id")
    return console.review_queue(T.read(spark, sf_dir, "documents").select(
        i.alias("doc"), _pick(_FILES, i % 6).alias("file_name"), _pick(_EXTS, i % 6).alias("file_ext"), _pick(_QUALITIES, i % 5).alias("text_quality"),
        _pick(_COUNTS, i % 7).alias("page_count"), F.when(F.col("n_chars") % 3 != 0, "MANUAL_REVIEW").otherwise("ACCEPT").alias("decision"),
    ))


# ---------------------------------------------------------------- objects

_LAYER_NAMES = ("supply temperature", "7", "温度", None, " x1y ", "")
_LEAF = {"c": "o_orderkey % 3 = 0", "d": "s_nationkey < 15"}


@query(f"""WITH c AS (SELECT o_orderkey, {_picked(_LAYER_NAMES, 'o_custkey % 6')} AS name, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE '' END AS summary, o_orderpriority AS authority FROM orders WHERE {_LEAF['c']}), d AS (SELECT s_suppkey, s_name AS name, '' AS summary, NULL AS authority FROM supplier WHERE {_LEAF['d']}),
e AS (SELECT l_partkey, l_orderkey, CASE WHEN l_linenumber > 2 THEN l_returnflag ELSE '' END AS quote, CASE WHEN c.o_orderkey IS NULL THEN d.name ELSE c.name END AS name, CASE WHEN c.o_orderkey IS NULL THEN d.summary ELSE c.summary END AS summary, c.authority FROM lineitem LEFT JOIN c ON l_orderkey = o_orderkey LEFT JOIN d ON l_suppkey = s_suppkey),
j AS (SELECT p_partkey, l_orderkey, quote, summary, authority, p_brand, CASE WHEN length(trim(name)) >= 2 AND (regexp_matches(trim(name), '[一-鿿]{{2,}}') OR regexp_matches(trim(name), '[A-Za-z].*[A-Za-z]')) THEN trim(name) ELSE p_name END AS title FROM part LEFT JOIN e ON l_partkey = p_partkey)
SELECT p_partkey AS ko_id, l_orderkey AS chunk_id, title, coalesce(nullif(quote, ''), nullif(summary, ''), title) AS summary, coalesce(authority, p_brand) AS authority FROM j""")
def object_candidates(spark, sf_dir):
    layer = lambda name, summary, authority: F.struct(name.alias("name"), summary.alias("summary"), authority.alias("authority")).alias("layer")
    told = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).otherwise("")
    by_chunk = T.read(spark, sf_dir, "orders").where(_LEAF["c"]).select(F.col("o_orderkey").alias("chunk_id"), layer(_pick(_LAYER_NAMES, F.col("o_custkey") % 6), told, F.col("o_orderpriority")))
    by_doc = T.read(spark, sf_dir, "supplier").where(_LEAF["d"]).select(F.col("s_suppkey").alias("doc_id"), layer(F.col("s_name"), F.lit(""), F.lit(None).cast("string")))
    quote = F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).otherwise("").alias("quote")
    evidence = T.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ko_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("doc_id"), quote)
    objects = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ko_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("authority"))
    return console.object_candidates(objects, evidence, by_chunk, by_doc)


_NOTES = ("see FC#12 and FC 3", "fc 007 fault", "abcFC 4", "R-407C at 5 bar", "uses R 134a or R22", "ISOBUTANE", "Refrigerant 740", "liquid oxygen", None, "none")
_GAS = "CASE " + " ".join(f"WHEN {_any('dense', words)} THEN '{name}'" for name, words in X.REFRIGERANTS.items()) + " END"


@query(f"""SELECT o_orderkey, nullif(regexp_extract(t, '(?i)\\bFC\\s*#?\\s*(\\d+)\\b', 1), '') AS fault_no, {_GAS} AS gas FROM (SELECT o_orderkey, t, lower(replace(replace(coalesce(t, ''), '-', ''), ' ', '')) AS dense FROM (SELECT o_orderkey, {_picked(_NOTES, 'o_orderkey % 10')} AS t FROM orders))""")
def named_numbers(spark, sf_dir):
    t = _pick(_NOTES, F.col("o_orderkey") % 10)
    return T.read(spark, sf_dir, "orders").select("o_orderkey", X.fault_number(t).alias("fault_no"), X.refrigerant(t).alias("gas"))


@query()
def tightened_clusters(spark, sf_dir):
    """Clusters of at most 15 vectors where a threshold below 0.95 tells them apart (the tests hold it against the recursion)."""
    return cluster.tightened(T.read(spark, sf_dir, "embeddings"), _pairs(spark, sf_dir, 0.4), "vec_id", 0.4)
